"""Column expressions: every one stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenuria import defaults as D


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(value) -> Column:
    """A date literal from a `datetime.date` or ISO string; columns pass through."""
    return value if isinstance(value, Column) else F.expr(f"DATE '{value}'")


def mapped(key: Column | str, values: Mapping[str, object], default=None) -> Column:
    """Literal lookup as a CASE chain, `default` for unknown or NULL keys."""
    key, out = col(key), None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def ratio(num: Column | str, den: Column | str, empty: float | None = 0.0) -> Column:
    """num / den in double, `empty` where the denominator is 0 or NULL (ANSI safe)."""
    num, den = col(num).cast("double"), col(den).cast("double")
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))


# -- customers ---------------------------------------------------------------


def tenure_days(signup, churn, as_of) -> Column:
    return F.datediff(F.coalesce(col(churn), day(as_of)), col(signup))


def cohort_of(tenure) -> Column:
    tenure = col(tenure)
    return (
        F.when(tenure <= D.NEW_USER_MAX_TENURE, "new_user")
        .when(tenure <= D.ESTABLISHED_MAX_TENURE, "established")
        .otherwise("mature")
    )


def ltv_tier(monthly, smb_max=D.SMB_MAX_CHARGE, mid_max=D.MID_MARKET_MAX_CHARGE) -> Column:
    monthly = col(monthly)
    return F.when(monthly < smb_max, "smb").when(monthly < mid_max, "mid_market").otherwise("enterprise")


def contract_months(contract) -> Column:
    return mapped(contract, D.CONTRACT_MONTHS, D.DEFAULT_CONTRACT_MONTHS)


def ltv_flat(monthly) -> Column:
    """Decimal arithmetic: money in, money out."""
    return (col(monthly).cast("decimal(10,2)") * F.expr("14.4BD")).cast("decimal(12,2)")


def ltv_tenure(monthly, contract, tenure) -> Column:
    months = col(tenure).cast("double") / 30.0 + contract_months(contract)
    return col(monthly).cast("double") * F.greatest(F.lit(float(D.LTV_MONTHS)), months) * D.LTV_MARGIN


def total_charges(monthly, tenure) -> Column:
    return col(monthly).cast("double") * col(tenure) / 30.0


def has_internet(service) -> Column:
    return F.coalesce(col(service) != "No", F.lit(False))


def internet_type(service) -> Column:
    return F.nullif(col(service), F.lit("No"))


def n_addons(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.when(F.col(c) == "Yes", 1).otherwise(0)
    return total


def sample_weight(tier) -> Column:
    return mapped(tier, D.TIER_WEIGHTS, D.DEFAULT_WEIGHT)


def days_to_renewal(contract, tenure, unknown_period: int | None = None) -> Column:
    """Days left in the current period; a whole multiple gives the full period.

    Unknown contracts give NULL, or are treated as `unknown_period` long.
    """
    period = mapped(contract, D.CONTRACT_PERIOD_DAYS, unknown_period)
    return period - col(tenure) % period


def contract_value(monthly, renewal_days) -> Column:
    return col(monthly).cast("double") * col(renewal_days) / 30.0


def churned_within(churn_date, prediction_date, horizon: int | Column) -> Column:
    """churn in (P, P + horizon]; never NULL."""
    ahead = F.datediff(col(churn_date), day(prediction_date))
    return F.coalesce((ahead > 0) & (ahead <= horizon), F.lit(False))


def yes_no(c) -> Column:
    """'Yes' / 'No' -> boolean; anything else -> NULL."""
    return mapped(c, {"Yes": True, "No": False})


# -- activity ----------------------------------------------------------------


def velocity(current, previous) -> Column:
    """Relative change; 1.0 when something follows nothing, 0.0 when both are 0."""
    current, previous = col(current).cast("double"), col(previous).cast("double")
    return (
        F.when(previous > 0, (current - previous) / previous)
        .when(current > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def trend_normalised(w1, w2, w3, w4) -> Column:
    """(newer half - older half) / (total + 1), 0 when the older half is empty; w1 is newest."""
    w1, w2, w3, w4 = (col(w).cast("double") for w in (w1, w2, w3, w4))
    return F.when(w3 + w4 > 0, (w1 + w2 - w3 - w4) / (w1 + w2 + w3 + w4 + 1.0)).otherwise(F.lit(0.0))


def trend_slope(values: Sequence[Column | str]) -> Column:
    """Least-squares slope over equally spaced values, oldest first; 0 for fewer than two."""
    n = len(values)
    if n < 2:
        return F.lit(0.0)
    mean = (n - 1) / 2.0
    spread = sum((i - mean) ** 2 for i in range(n))
    total = F.lit(0.0)
    for i, v in enumerate(values):
        total = total + (i - mean) * col(v).cast("double")
    return total / spread


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation over pairs without NULL or NaN; NULL when a side is constant.

    Built from moments because corr() divides by zero on a constant side under ANSI.
    """
    null = F.lit(None).cast("double")
    a, b = F.nanvl(a.cast("double"), null), F.nanvl(b.cast("double"), null)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y), None))


# -- scores ------------------------------------------------------------------


def encoded(c, codes: tuple[Mapping[str, int], int]) -> Column:
    return mapped(c, *codes)


def risk_level(p) -> Column:
    p = col(p)
    return F.when(p >= 0.7, "critical").when(p >= 0.5, "high").when(p >= 0.3, "medium").otherwise("low")


def tie_order(key) -> Column:
    """A uniform, portable total order over ids, used to break score ties.

    Being a hash it is evenly spread whatever the ids look like, so equal-width
    buckets of it are balanced without looking at the data first.
    """
    keys = [key] if isinstance(key, (str, Column)) else list(key)
    if len(keys) == 1:
        return F.md5(col(keys[0]).cast("string"))
    return F.md5(F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]))
