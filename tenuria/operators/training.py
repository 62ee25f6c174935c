"""Model preparation, training and scoring: boosted trees (boosting) and MLlib's logistic regression."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuria import defaults as D
from tenuria.functions import columns as C
from tenuria.operators import boosting, metrics, splits
from tenuria.operators.ranking import Slots
from tenuria.session import settle

EXCLUDED = frozenset(
    "customer_id prediction_date churned_in_window churn_date sample_weight cohort ltv_tier contract_type".split()
)

def encode_categoricals(df: DataFrame) -> DataFrame:
    """Add *_encoded columns for the categorical columns present."""
    codes = {"cohort": D.COHORT_CODES, "ltv_tier": D.TIER_CODES, "contract_type": D.CONTRACT_CODES}
    return df.withColumns({f"{c}_encoded": C.encoded(c, m) for c, m in codes.items() if c in df.columns})


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not identifiers, dates, label, weight or raw categories."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in EXCLUDED]


def training_frame(df: DataFrame, target: str = "churned_in_window") -> tuple[DataFrame, list[str]]:
    """Identifiers, features as doubles with NULL -> 0, label, weight; and the ordered feature list."""
    encoded = encode_categoricals(df)
    names = feature_columns(encoded)
    weight = F.coalesce(F.col("sample_weight").cast("double"), F.lit(1.0)) if "sample_weight" in df.columns else F.lit(1.0)
    keep = [c for c in ("customer_id", "prediction_date", "cohort", "ltv_tier", "churn_date") if c in df.columns]
    frame = encoded.select(
        *keep,
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names],
        F.col(target).cast("int").alias("label"),
        weight.alias("weight"),
    )
    return frame, names


#: Frames hold a row per customer and snapshot.
ROW_KEY = ("customer_id", "prediction_date")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (2 * count) per class, an absent class counting as one row; and their ratio."""
    one = F.greatest(F.count_if(F.col(label) == 1), F.lit(1))
    zero = F.greatest(F.count_if(F.col(label) == 0), F.lit(1))
    n = F.count("*").cast("double")
    agg = df.agg((n / (2 * zero)).alias("weight_0"), (n / (2 * one)).alias("weight_1"))
    return agg.withColumn("scale_pos_weight", F.col("weight_1") / F.col("weight_0"))


def with_row_weights(frame: DataFrame, scale_pos_weight: float | Column) -> DataFrame:
    """Value weight times the positive-class scale on churners."""
    scale = scale_pos_weight if isinstance(scale_pos_weight, Column) else F.lit(float(scale_pos_weight))
    return frame.withColumn("row_weight", F.col("weight") * F.when(F.col("label") == 1, scale).otherwise(F.lit(1.0)))


def positive_scale(frame: DataFrame) -> float:
    """One scalar for the driver: the positive-class weight ratio."""
    return float(class_weights(frame).first()["scale_pos_weight"])


Model = boosting.Boosted | PipelineModel


def train_gbt(frame: DataFrame, features: Sequence[str], validation: DataFrame | None = None, **params) -> boosting.Boosted:
    """Boosted trees; average precision of a validation frame stops them and cuts them to the best round. Positives weigh n0 / n1 more."""
    return boosting.fit(frame, features, validation, **params)


def train_logistic(frame: DataFrame, features: Sequence[str], **params) -> PipelineModel:
    """Linear baseline on standardised features."""
    weighted = with_row_weights(frame, positive_scale(frame))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    logistic = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="row_weight",
                                  **{"maxIter": 50, "regParam": 0.01, **params})
    return _fit(weighted, features, [scaler, logistic])


def _fit(frame: DataFrame, features: Sequence[str], stages) -> PipelineModel:
    """Fit; callers that fit many times settle the frame first (session.settle)."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, *stages]).fit(frame)


def score(model: Model, frame: DataFrame) -> DataFrame:
    """Add score = P(churn); working vector columns are dropped."""
    if isinstance(model, boosting.Boosted):
        return boosting.score(model, frame)
    out = model.transform(frame)
    drop = [c for c in ("features", "scaled", "rawPrediction", "probability", "prediction") if c in out.columns]
    return out.withColumn("score", vector_to_array("probability")[1]).drop(*drop)


def batch_score(model: Model, frame: DataFrame) -> DataFrame:
    """Scored snapshot with risk level and intervention priority (probability x tier weight)."""
    return score(model, frame).withColumns(
        {"risk_level": C.risk_level("score"), "intervention_priority": priority("score", "ltv_tier")}
    )


def priority(probability, tier) -> Column:
    return C.col(probability) * C.sample_weight(tier)


def feature_importance(model: Model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance): one row per model feature; shares of the gain of all splits, or sizes of coefficients."""
    if isinstance(model, boosting.Boosted):
        rows = [(f, share) for f, share, _ in boosting.importance(model)]
    else:
        values = abs(model.stages[-1].coefficients.toArray())
        rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(F.desc("importance"), "feature")


def cross_validate(frame: DataFrame, features: Sequence[str], n_splits: int = 5, trainer=train_gbt, slots: Slots | None = None,
                   test_days: int = 30, stop_days: int = 0, **params) -> DataFrame:
    """One row of metrics per temporal fold. With stop_days, the last days of a fold's training period stop its boosting.

    Boosted folds grow in the same jobs; another trainer fits one fold after another. All test rows are evaluated in one plan.
    """
    folds = splits.ts_folds(frame, n_splits=n_splits, test_days=test_days)
    if not folds:
        raise ValueError("the period is too short for any fold")
    d = F.col("prediction_date")
    fits, tests = [], []
    for fold in folds:
        if not fold.train_end < fold.test_start:
            raise ValueError(f"fold {fold.fold} trains on dates of its test period")
        train, early = (d >= C.day(fold.train_start)) & (d <= C.day(fold.train_end)), d <= C.day(fold.train_end - dt.timedelta(days=stop_days))
        fits.append(boosting.Fit(train & early, train & ~early) if stop_days else boosting.Fit(train))
        tests.append((d >= C.day(fold.test_start)) & (d <= C.day(fold.test_end)))
    if trainer is train_gbt:
        models = boosting.fit_many(frame, features, fits, ROW_KEY, **params)
    else:
        held = [(frame.where(f.validation),) if stop_days else () for f in fits]
        models = [trainer(frame.where(f.train), features, *v, **params) for f, v in zip(fits, held, strict=True)]
    keep = ("customer_id", "prediction_date", "label", "score")
    scored = [score(m, frame.where(t)).select(*keep, F.lit(f.fold).alias("fold")) for m, t, f in zip(models, tests, folds, strict=True)]
    return metrics.evaluate(settle(reduce(DataFrame.unionByName, scored)), ["fold"], key=ROW_KEY, slots=slots)


def cv_summary(per_fold: DataFrame, names: Sequence[str] = ("auc_pr", "precision_at_10pct", "recall")) -> DataFrame:
    """Mean and sample deviation over folds."""
    cols = []
    for n in names:
        cols += [F.avg(n).alias(f"mean_{n}"), F.stddev_samp(n).alias(f"std_{n}")]
    return per_fold.agg(F.count("*").alias("n_folds"), *cols)


def run_metrics(run_id: str, train: DataFrame, validation: DataFrame, scored: DataFrame, n_features: int, slots: Slots | None = None) -> DataFrame:
    """One row describing a run: sizes and churn rates of both sides, validation metrics."""
    def side(df, name):
        return df.agg(F.count("*").alias(f"n_{name}"), F.avg(F.col("label").cast("double")).alias(f"churn_rate_{name}"))

    values = metrics.evaluate(scored, key=ROW_KEY, slots=slots).select("auc_roc", "auc_pr", "precision_at_10pct", "recall", "brier")
    one = lambda df: df.withColumn("run_id", F.lit(run_id))
    return (
        one(side(train, "train"))
        .join(one(side(validation, "validation")), "run_id")
        .join(one(values), "run_id")
        .withColumn("n_features", F.lit(n_features))
    )


def promotion_gate(candidate: DataFrame, champion: DataFrame, min_auc_pr: float = 0.5, min_precision: float = 0.6) -> DataFrame:
    """Whether a candidate's metric row passes the floors and beats the champion's row.

    Both are one-row frames; an empty champion is beaten by anything.
    """
    best = champion.agg(F.max("auc_pr").alias("champion_auc_pr"))
    joined = candidate.select("auc_pr", "precision_at_10pct").join(F.broadcast(best), F.lit(True), "left")
    floors = (F.col("auc_pr") > min_auc_pr) & (F.col("precision_at_10pct") > min_precision)
    beats = F.col("champion_auc_pr").isNull() | (F.col("auc_pr") > F.col("champion_auc_pr"))
    return joined.withColumns({"passes_floors": floors, "beats_champion": beats, "promote": floors & beats})


# -- runs and models on disk -----------------------------------------------------------


def append_run(row: DataFrame, path: str, promoted: bool = False) -> None:
    """Append a row of metrics with its run_id to the run table at `path`; nothing there is rewritten."""
    row.withColumns({"promoted": F.lit(promoted), "recorded_at": F.current_timestamp()}).write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The run table: a run id that was recorded again counts once, with its latest row."""
    table = spark.read.option("mergeSchema", True).parquet(path)
    rest = F.struct("recorded_at", *[c for c in sorted(table.columns) if c not in ("run_id", "recorded_at")])
    return table.groupBy("run_id").agg(F.max(rest).alias("_row")).select("run_id", "_row.*")


def champion(spark: SparkSession, path: str) -> DataFrame:
    """The promoted run with the greatest auc_pr, ties to the smallest run_id; no row where none is promoted."""
    return runs(spark, path).where("promoted").orderBy(F.desc("auc_pr"), "run_id").limit(1)


def save_model(model: Model, path: str) -> None:
    """Persist a model with its ordered feature list (of a pipeline, in its assembler stage)."""
    if isinstance(model, boosting.Boosted):
        boosting.save(model, SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, boosted: bool = True) -> tuple[Model, list[str]]:
    if boosted:
        model = boosting.load(SparkSession.active(), path)
        return model, list(model.features)
    model = PipelineModel.load(path)
    return model, list(model.stages[0].getInputCols())
