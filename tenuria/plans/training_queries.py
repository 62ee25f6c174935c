"""Registered queries: training frame, models, scoring, tree contributions, streams."""

from __future__ import annotations

import operator
from functools import reduce
from uuid import uuid4

from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators import boosting, explain, metrics, training, tree_contributions
from tenuria.plans.inputs import A_SNAPSHOTS, account_gold, activity_tables, scored
from tenuria.plans.insight_queries import velocity_check
from tenuria.plans.model_queries import FOLDS, ROW_KEY, metric_ctes
from tenuria.plans.registry import Check, query
from tenuria.session import settle, shared_dir
from tenuria.streaming import alerts, daily

STOP = "1998-09-01"
CUT = "1999-01-01"
# The last snapshot of each fold's training period stops its boosting.
STOP_DAYS = 30


def _settled(spark, d):
    """The training frame, computed once for the fits and scores of a query."""
    frame, names = training.training_frame(account_gold(spark, d, A_SNAPSHOTS))
    return settle(frame), names


def _model(frame, names):
    """Boosted trees that stop early on the last months before the cut."""
    early = F.col("prediction_date") < C.day(STOP)
    return boosting.fit_many(_before(frame), names, [boosting.Fit(early, ~early)], ROW_KEY)[0]


def _before(frame):
    return frame.where(F.col("prediction_date") < C.day(CUT))


def _after(frame):
    return frame.where(F.col("prediction_date") >= C.day(CUT))


_FEATURES = (
    "days_to_first_login onboarding_completion_pct first_week_logins logins_30d logins_90d logins_180d features_used_30d features_used_180d "
    "feature_adoption_pct session_minutes_30d session_minutes_180d avg_session_duration days_since_last_login days_since_last_feature_use "
    "login_velocity_wow feature_velocity_wow login_trend_4w tickets_180d avg_sentiment_180d escalation_rate_180d days_to_renewal "
    "contract_value_remaining tenure_days estimated_ltv"
).split()
_CODES = """CASE cohort WHEN 'new_user' THEN 0 WHEN 'mature' THEN 2 ELSE 1 END AS cohort_encoded,
    CASE ltv_tier WHEN 'mid_market' THEN 1 WHEN 'enterprise' THEN 2 ELSE 0 END AS ltv_tier_encoded,
    CASE contract_type WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 ELSE 0 END AS contract_type_encoded"""


@query(
    "training_frame",
    Check(
        "SELECT customer_id, prediction_date, cohort, ltv_tier, churn_date, churned_in_window::INT AS label, sample_weight AS weight, "
        + ", ".join(f"COALESCE({f}, 0) AS {f}" for f in _FEATURES) + f", {_CODES} FROM a_train",
        "customer_id label", "weight cohort_encoded ltv_tier_encoded contract_type_encoded " + " ".join(_FEATURES),
        "prediction_date cohort ltv_tier churn_date"),
)
def training_frame(spark, d):
    return training.training_frame(account_gold(spark, d, A_SNAPSHOTS))[0]


@query(
    "class_weights",
    Check("SELECT n / (2.0::DOUBLE * (n - p)) AS weight_0, n / (2.0::DOUBLE * p) AS weight_1, (n - p) / CAST(p AS DOUBLE) AS scale_pos_weight "
          "FROM (SELECT COUNT(*) AS n, SUM(label) AS p FROM a_scored_all)", "", "weight_0 weight_1 scale_pos_weight"),
)
def class_weights(spark, d):
    return training.class_weights(scored(spark, d, A_SNAPSHOTS))


@query(
    "row_weights",
    Check("SELECT customer_id, prediction_date, CASE ltv_tier WHEN 'smb' THEN 1 WHEN 'mid_market' THEN 3 ELSE 10 END * CASE WHEN label = 1 THEN s ELSE 1 END AS row_weight "
          "FROM a_scored_all, (SELECT (COUNT(*) - SUM(label)) / CAST(SUM(label) AS DOUBLE) AS s FROM a_scored_all)",
          "customer_id", "row_weight", "prediction_date"),
)
def row_weights(spark, d):
    rows = scored(spark, d, A_SNAPSHOTS).withColumn("weight", C.sample_weight("ltv_tier"))
    return training.with_row_weights(rows, training.positive_scale(rows)).select("customer_id", "prediction_date", "row_weight")


# Scores of a model have no SQL. The queries return what SQL can state of them: the rows they cover, and whether their figures hold.


def _facts(scored):
    """Per split: rows, positives, scores inside [0, 1]; and whether training churners score higher on average."""
    split = F.when(F.col("prediction_date") < C.day(STOP), "train").when(F.col("prediction_date") < C.day(CUT), "stop").otherwise("held")
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.col("score")))
    agg = scored.groupBy(split.alias("split")).agg(
        F.count("*").alias("n"), F.sum("label").alias("n_positive"), F.count_if(F.col("score").between(0, 1)).alias("n_in_range"), (mean(1) > mean(0)).alias("s"))
    return agg.select("split", "n", "n_positive", "n_in_range", F.when(F.col("split") == "train", F.col("s")).alias("separates"))


_SPLIT = "CASE WHEN prediction_date < DATE '1998-09-01' THEN 'train' WHEN prediction_date < DATE '1999-01-01' THEN 'stop' ELSE 'held' END"
_FACTS = Check(
    f"SELECT {_SPLIT} AS split, COUNT(*) AS n, SUM(CAST(churned_in_window AS INT)) AS n_positive, COUNT(*) AS n_in_range, "
    f"CASE WHEN {_SPLIT} = 'train' THEN TRUE END AS separates FROM a_train GROUP BY 1",
    "n n_positive n_in_range", "", "split separates")


@query("train_gbt", _FACTS)
def train_gbt(spark, d):
    """500 rounds, stopped by average precision after 50 without gain, and the scores of all rows as facts."""
    frame, names = _settled(spark, d)
    return _facts(training.score(_model(frame, names), frame))


@query("train_logistic", _FACTS)
def train_logistic(spark, d):
    frame, names = _settled(spark, d)
    return _facts(training.score(training.train_logistic(_before(frame), names), frame))


@query(
    "cv_temporal",
    Check(
        "SELECT f.fold, COUNT(*) AS n_samples, AVG(CAST(churned_in_window AS DOUBLE)) AS churn_rate, TRUE AS in_range, (SELECT COUNT(*) FROM folds) AS n_folds "
        "FROM folds f JOIN a_train t ON t.prediction_date BETWEEN test_start AND test_end GROUP BY 1",
        "fold n_samples n_folds", "churn_rate", "in_range", FOLDS),
)
def cv_temporal(spark, d):
    """Five temporal folds of the whole model; each is stopped by the last snapshot of its training period."""
    frame, names = _settled(spark, d)
    folds = settle(training.cross_validate(frame, names, stop_days=STOP_DAYS))
    inside = [F.col(c).between(0, 1) for c in ("auc_roc", "auc_pr", "precision_at_10pct", "recall", "brier")]
    n = training.cv_summary(folds).select("n_folds")
    return folds.select("fold", "n_samples", "churn_rate", reduce(operator.and_, inside).alias("in_range")).join(F.broadcast(n), F.lit(True))


_NAMED = ", ".join(f"('{f}')" for f in (*_FEATURES, "cohort_encoded", "ltv_tier_encoded", "contract_type_encoded"))


@query(
    "feature_importance",
    Check(f"SELECT feature, TRUE AS in_range, CAST(1 AS DOUBLE) AS total FROM (VALUES {_NAMED}) v(feature)", "", "total", "feature in_range"),
)
def feature_importance(spark, d):
    """A share per feature; all shares add up to one."""
    frame, names = _settled(spark, d)
    shares = training.feature_importance(_model(frame, names), names, spark)
    total = shares.agg(F.sum("importance").alias("total"))
    return shares.select("feature", F.col("importance").between(0, 1).alias("in_range")).join(F.broadcast(total), F.lit(True))


_SIDE = "COUNT(*) AS n_{0}, AVG(CAST(churned_in_window AS DOUBLE)) AS churn_rate_{0}"


@query(
    "run_metrics",
    Check(
        f"SELECT * FROM (SELECT {_SIDE.format('train')} FROM a_train WHERE prediction_date < DATE '1999-01-01'), "
        f"(SELECT {_SIDE.format('validation')} FROM a_train WHERE prediction_date >= DATE '1999-01-01'), "
        "(VALUES ('run-1', 27, TRUE, TRUE)) v(run_id, n_features, in_range, is_champion)",
        "n_train n_validation n_features", "churn_rate_train churn_rate_validation", "run_id in_range is_champion"),
)
def run_metrics(spark, d):
    """A run recorded twice in the run table and read back: it counts once, and is the champion."""
    frame, names = _settled(spark, d)
    held, table = _after(frame), f"{shared_dir(spark)}/runs-{uuid4().hex}"
    row = settle(training.run_metrics("run-1", _before(frame), held, training.score(_model(frame, names), held), len(names)))
    for _ in range(2):
        training.append_run(row, table, promoted=True)
    best = training.champion(spark, table).select("run_id", F.lit(True).alias("is_champion"))
    inside = [F.col(c).between(0, 1) for c in ("auc_roc", "auc_pr", "precision_at_10pct", "recall", "brier")]
    return training.runs(spark, table).select(
        "run_id", "n_train", "churn_rate_train", "n_validation", "churn_rate_validation", "n_features", reduce(operator.and_, inside).alias("in_range")
    ).join(best, "run_id", "left")


@query(
    "batch_score",
    Check(
        "SELECT customer_id, prediction_date, TRUE AS in_range, TRUE AS level_holds, CASE ltv_tier WHEN 'smb' THEN 1 WHEN 'mid_market' THEN 3 ELSE 10 END AS priority_by_score "
        f"FROM a_train WHERE prediction_date = DATE '{A_SNAPSHOTS[-1]}'", "customer_id", "priority_by_score", "prediction_date in_range level_holds"),
)
def batch_score(spark, d):
    """The latest snapshot scored: score in range, the level's bounds hold, and priority as a multiple of the score."""
    frame, names = _settled(spark, d)
    latest = frame.where(F.col("prediction_date") == C.day(A_SNAPSHOTS[-1]))
    bounds = {"low": (0.0, 0.3), "medium": (0.3, 0.5), "high": (0.5, 0.7), "critical": (0.7, 1.1)}
    holds = reduce(operator.or_, [(F.col("risk_level") == k) & (F.col("score") >= lo) & (F.col("score") < hi) for k, (lo, hi) in bounds.items()])
    return training.batch_score(_model(frame, names), latest).select(
        "customer_id", "prediction_date", F.col("score").between(0, 1).alias("in_range"), holds.alias("level_holds"),
        (F.col("intervention_priority") / F.col("score")).alias("priority_by_score"))


@query(
    "save_load_model",
    Check("SELECT COUNT(*) AS n, COUNT(*) AS n_equal, TRUE AS same_features FROM a_train WHERE prediction_date >= DATE '1999-01-01'",
          "n n_equal", "", "same_features"),
)
def save_load_model(spark, d):
    """A model written and read back: same features in the same order, and the same score of every row."""
    frame, names = _settled(spark, d)
    model, path = _model(frame, names), f"{shared_dir(spark)}/model-{uuid4().hex}"
    training.save_model(model, path)
    loaded, features = training.load_model(path)
    scores = training.score(loaded, training.score(model, _after(frame)).withColumnRenamed("score", "before"))
    return scores.agg(F.count("*").alias("n"), F.count_if(F.col("score") == F.col("before")).alias("n_equal"), F.lit(features == names).alias("same_features"))


@query(
    "contributions",
    Check(
        "SELECT customer_id, prediction_date, feature, feature_value, TRUE AS adds_up FROM (SELECT customer_id, prediction_date, "
        + ", ".join(f"CAST(COALESCE({f}, 0) AS DOUBLE) AS {f}" for f in _FEATURES) + f", {_CODES.replace(' END AS', ' END::DOUBLE AS')} FROM a_train "
        "WHERE prediction_date >= DATE '1999-01-01') UNPIVOT (feature_value FOR feature IN (COLUMNS(* EXCLUDE (customer_id, prediction_date))))",
        "customer_id", "feature_value", "prediction_date feature adds_up"),
)
def contributions(spark, d):
    """All features of every held-out row; base and contributions add up to the model's own margin, and the margin to its score."""
    frame, names = _settled(spark, d)
    model = _model(frame, names)
    explained = tree_contributions.contributions(model, _after(frame), names, ROW_KEY)
    total = F.aggregate("contributions", F.col("base_value"), lambda acc, c: acc + c["contribution"])
    holds = (F.abs(total - F.col("margin")) < 1e-6) & F.col("score").between(0, 1)
    rows = explain.exploded(explained.withColumn("adds_up", holds), ["customer_id", "prediction_date", "adds_up"])
    return rows.drop("contribution")


@query(
    "risk_tier_bins",
    Check("SELECT risk_level, COUNT(*) AS n FROM (SELECT CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.5 THEN 'medium' WHEN score < 0.7 THEN 'high' ELSE 'critical' END AS risk_level "
          "FROM a_scored_all) GROUP BY 1", "n", "", "risk_level"),
)
def risk_tier_bins(spark, d):
    return scored(spark, d, A_SNAPSHOTS).groupBy(C.risk_level("score").alias("risk_level")).agg(F.count("*").alias("n"))


@query(
    "intervention_priority",
    Check("SELECT customer_id, score * CASE ltv_tier WHEN 'smb' THEN 1 WHEN 'mid_market' THEN 3 ELSE 10 END AS intervention_priority FROM a_scored",
          "customer_id", "intervention_priority"),
)
def intervention_priority(spark, d):
    return scored(spark, d).select("customer_id", training.priority("score", "ltv_tier").alias("intervention_priority"))


@query(
    "promotion_gate",
    Check(
        """SELECT c.auc_pr, c.precision_at_10pct, h.auc_pr AS champion_auc_pr, c.auc_pr > 0.05 AND c.precision_at_10pct > 0.05 AS passes_floors,
            c.auc_pr > h.auc_pr AS beats_champion, c.auc_pr > 0.05 AND c.precision_at_10pct > 0.05 AND c.auc_pr > h.auc_pr AS promote
        FROM pc_out c, ph_out h""",
        "", "auc_pr precision_at_10pct champion_auc_pr", "passes_floors beats_champion promote",
        (("pc_rows", "SELECT * REPLACE (0.3 * label + 0.7 * score AS score), 'all' AS segment FROM a_scored"), *metric_ctes("pc_rows", "segment", "pc"),
         ("ph_rows", "SELECT *, 'all' AS segment FROM a_scored"), *metric_ctes("ph_rows", "segment", "ph")),
    ),
)
def promotion_gate(spark, d):
    """The champion comes from the run table, where it stands twice."""
    champion = scored(spark, d)
    candidate = champion.withColumn("score", 0.3 * F.col("label") + 0.7 * F.col("score"))
    table = f"{shared_dir(spark)}/runs-{uuid4().hex}"
    stored_run = settle(metrics.evaluate(champion).withColumn("run_id", F.lit("first")))
    for _ in range(2):
        training.append_run(stored_run, table, promoted=True)
    return training.promotion_gate(metrics.evaluate(candidate), training.champion(spark, table), 0.05, 0.05)


# -- streams ------------------------------------------------------------------------


def _stream_folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid4().hex}"


def _daily_stream(spark, d):
    events = daily.read_events(spark, f"{d}/events*.parquet")
    key = F.get_json_object("event_properties", "$.k").cast("int")
    return daily.daily_engagement(events, ("view",), ("click", "purchase"), key, F.col("minutes"))


def _run(stream, spark, columns):
    """Run a stream over what is there and return what it wrote to the shared folder."""
    folder = _stream_folder(spark)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
    writer.option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(columns).parquet(f"{folder}/rows")


@query(
    "stream_daily_engagement",
    Check(
        "SELECT * FROM b_days WHERE CAST(activity_date + 1 AS TIMESTAMP) <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM events)",
        "customer_id login_count features_used unique_features", "session_duration_minutes", "activity_date"),
)
def stream_daily_engagement(spark, d):
    return _run(_daily_stream(spark, d), spark, "customer_id BIGINT, activity_date DATE, login_count BIGINT, features_used BIGINT, "
                             "unique_features INT, session_duration_minutes DOUBLE")


@query("stream_dedup", Check("SELECT DISTINCT event_id, user_id AS customer_id, event_type FROM events", "event_id customer_id", "", "event_type"))
def stream_dedup(spark, d):
    events = daily.read_events(spark, f"{d}/events*.parquet")
    repeated = events.unionByName(events.where(F.col("event_id") % 3 == 0))
    kept = daily.dedup(repeated).select("event_id", "customer_id", "event_type")
    return _run(kept, spark, "event_id BIGINT, customer_id BIGINT, event_type STRING")


@query("stream_velocity_alert", velocity_check("b_days"))
def stream_velocity_alert(spark, d):
    """Closed days stream into the stored daily table; each batch evaluates the weeks it completed."""
    folder = _stream_folder(spark)
    customers = activity_tables(spark, d).silver_customers
    on_batch = alerts.velocity_batches(f"{folder}/daily", f"{folder}/alerts", customers, "2024-01-01")
    writer = _daily_stream(spark, d).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state")
    writer.foreachBatch(on_batch).trigger(availableNow=True).start().awaitTermination()
    return alerts.latest_alerts(spark, f"{folder}/alerts")
