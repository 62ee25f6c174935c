"""Default parameters. They define the results."""

from __future__ import annotations

# Cohorts: upper tenure bound in days (inclusive), last one open.
COHORTS = ("new_user", "established", "mature")
NEW_USER_MAX_TENURE = 30
ESTABLISHED_MAX_TENURE = 180

# Value tiers by monthly charges (upper bounds exclusive).
TIERS = ("smb", "mid_market", "enterprise")
SMB_MAX_CHARGE = 800
MID_MARKET_MAX_CHARGE = 5000
TIER_WEIGHTS = {"smb": 1.0, "mid_market": 3.0, "enterprise": 10.0}
DEFAULT_WEIGHT = 1.0

# Contract type -> (months, renewal period in days).
CONTRACT_MONTHS = {"Month-to-month": 1, "One year": 12, "Two year": 24}
CONTRACT_PERIOD_DAYS = {"Month-to-month": 30, "One year": 365, "Two year": 730}
DEFAULT_CONTRACT_MONTHS = 1
LTV_MONTHS = 12
LTV_MARGIN = 1.2

# Category encodings and the code for unknown values.
COHORT_CODES = ({"new_user": 0, "established": 1, "mature": 2}, 1)
TIER_CODES = ({"smb": 0, "mid_market": 1, "enterprise": 2}, 0)
CONTRACT_CODES = ({"Month-to-month": 0, "One year": 1, "Two year": 2}, 0)

# Feature windows.
WINDOWS = (7, 14, 30)
WEEK = 7
TOTAL_FEATURES = 15
NEVER = 999
HORIZON_DAYS = 30
FIRST_WEEK_DAYS = 7

# Feature windows of the cohort variant (days).
COHORT_WINDOWS = {
    "new_user": (7, 14),
    "established": (7, 14, 30),
    "mature": (14, 30, 60),
}
DEFAULT_COHORT = "established"

# Declared observation window and label horizon per cohort (days).
COHORT_OBSERVATION = {"new_user": 14, "established": 30, "mature": 60}
COHORT_HORIZON = {"new_user": 30, "established": 30, "mature": 90}

# Evaluation.
THRESHOLDS = tuple(round(0.1 * i, 1) for i in range(1, 10))
FINE_THRESHOLDS = tuple(round(0.1 + 0.01 * i, 2) for i in range(81))
COST_FALSE_POSITIVE = 1.0
COST_FALSE_NEGATIVE = 10.0
INTERVENTION_COST = 50.0
SAVE_RATE = 0.40

# Leakage audit.
CORR_CRITICAL = 0.95
CORR_WARNING = 0.8
NAME_PATTERNS = {
    "churn": "Feature name contains 'churn' - may leak target",
    "cancel": "Feature name contains 'cancel' - may be target-derived",
    "_future": "Feature name suggests future data",
    "_next": "Feature name suggests future data",
    "will_": "Feature name suggests future knowledge",
    "after_": "Feature name suggests post-prediction data",
}
DATE_PATTERNS = ("_date", "_at", "timestamp", "_time")

# Monitoring: metric -> (direction in which it is bad, warning, critical).
MONITOR_THRESHOLDS = {
    "feature_freshness_hours": ("above", 18.0, 24.0),
    "missing_rate_pct": ("above", 2.0, 5.0),
    "psi": ("above", 0.1, 0.2),
    "auc_pr": ("below", 0.5, 0.45),
    "intervention_rate": ("below", 0.70, 0.60),
    "save_rate": ("below", 0.35, 0.25),
}
KS_THRESHOLD = 0.1

# Texts of monitoring alerts.
ALERT_DRIFT = "Feature drift detected (PSI > 0.2)"
ALERT_MISSING = "Missing rate spike detected (>3%)"
ALERT_BELOW = "Model performance below threshold (AUC-PR < 0.45)"
ALERT_DEGRADING = "Model performance degrading (AUC-PR < 0.5)"
