"""Metrics, predictions and metric documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnaround import schema
from turnaround.operators.findings import publish_document
from turnaround.sources.storage import current, materialize

METRICS = ["r2", "rmse_log", "mae_log", "mae_hours", "rmse_hours"]


def regression_metrics(df: DataFrame, actual: str = schema.TARGET, predicted: str = "prediction") -> DataFrame:
    """Fit on the log scale (R², RMSE, MAE) and error in hours (MAE, RMSE), in one aggregate.

    R² is one minus residual over total sum of squares, not the squared correlation.
    """
    y, p = F.col(actual), F.col(predicted)
    e, h = p - y, F.expm1(p) - F.expm1(y)
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * rows)).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse_log"),
        F.avg(F.abs(e)).alias("mae_log"),
        F.avg(F.abs(h)).alias("mae_hours"),
        F.sqrt(F.avg(h * h)).alias("rmse_hours"),
    )


def predictions_table(scored: DataFrame, key: str = "unique_key", actual: str = schema.TARGET, predicted: str = "prediction") -> DataFrame:
    """Key, actual, predicted and error in hours; a positive error is an overestimate."""
    hours = scored.select(
        F.col(key), F.expm1(actual).alias("actual_hours"), F.expm1(predicted).alias("predicted_hours")
    )
    return hours.withColumn("error_hours", F.col("predicted_hours") - F.col("actual_hours"))


def tidy_metrics(metrics: DataFrame, stage: str, model: str, names: list[str] = METRICS) -> DataFrame:
    """One-row metrics as rows `(stage, model, metric, value)`."""
    return metrics.select(F.lit(stage).alias("stage"), F.lit(model).alias("model"), *names).unpivot(
        ["stage", "model"], names, "metric", "value"
    )


def merge_metrics(stored: DataFrame, update: DataFrame) -> DataFrame:
    """Stored rows with those of `update` added or replaced, per `(stage, model, metric)`."""
    keys = ["stage", "model", "metric"]
    both = stored.withColumn("_new", F.lit(0)).unionByName(update.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by("value", "_new").alias("value"))


def compare_models(tidy: DataFrame, order: list[str]) -> DataFrame:
    """Validation metrics per model, best R² first; ties go to the model listed first."""
    position = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    wide = tidy.where(F.col("stage") == "validation").groupBy("model").pivot("metric", METRICS).agg(F.first("value"))
    return wide.withColumn("position", position).orderBy(F.desc("r2"), "position")


def best_model(comparison: DataFrame) -> str:
    return comparison.orderBy(F.desc("r2"), "position").first()["model"]


_SCORES = ["r2", "mae_hours", "rmse_hours"]


def metrics_document(tidy: DataFrame, rows: int, best: str) -> DataFrame:
    """Nested metrics: rows, best model, validation per model, test and (where stored) deployed scores.

    The tidy table has a handful of rows per model, so one group assembles it.
    """
    per_model = (
        tidy.groupBy("stage", "model")
        .pivot("metric", _SCORES)
        .agg(F.first("value"))
        .withColumn("scores", F.struct(*_SCORES))
    )

    def stage(name: str, value: Column) -> Column:
        return F.when(F.col("stage") == name, value)

    deployed = F.struct("model", "r2", "mae_hours")
    return per_model.agg(
        F.lit(rows).cast("bigint").alias("rows"),
        F.lit(best).alias("best_model"),
        F.map_from_entries(F.sort_array(F.collect_list(stage("validation", F.struct("model", "scores"))))).alias("validation"),
        F.max(stage("test", F.col("scores"))).alias("test"),
        F.max(stage("deployed", deployed)).alias("deployed"),
    )


_SCORE = T.StructType([T.StructField(n, T.DoubleType()) for n in _SCORES])
METRICS_SCHEMA = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("best_model", T.StringType()),
        T.StructField("validation", T.MapType(T.StringType(), _SCORE)),
        T.StructField("test", _SCORE),
        T.StructField(
            "deployed",
            T.StructType(
                [T.StructField("model", T.StringType()), T.StructField("r2", T.DoubleType()), T.StructField("mae_hours", T.DoubleType())]
            ),
        ),
    ]
)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics document as tidy rows `(stage, model, metric, value)`."""
    document = spark.read.schema(METRICS_SCHEMA).json(current(spark, path), multiLine=True)
    return flatten_metrics(document)


def update_metrics(spark: SparkSession, path: str, update: DataFrame) -> DataFrame:
    """Read the document at `path`, merge tidy rows into it and write it back; the tidy rows it now has.

    Row count and best model stay as they are. A reader sees the old or the new document, whole.
    """
    document = spark.read.schema(METRICS_SCHEMA).json(current(spark, path), multiLine=True)
    kept = document.select("rows", "best_model").first()
    merged = merge_metrics(flatten_metrics(document), update)
    stored = materialize(metrics_document(merged, kept["rows"], kept["best_model"]), "metrics")
    publish_document(stored, path)
    return read_metrics(spark, path)


def flatten_metrics(document: DataFrame) -> DataFrame:
    def cells(stage: str, model: Column, scores: Column, names: list[str]) -> Column:
        return F.array(
            *[F.struct(F.lit(stage).alias("stage"), model.alias("model"), F.lit(n).alias("metric"), scores.getField(n).alias("value")) for n in names]
        )

    validation = F.flatten(
        F.transform(F.map_entries("validation"), lambda e: cells("validation", e["key"], e["value"], _SCORES))
    )
    test = cells("test", F.col("best_model"), F.col("test"), _SCORES)
    deployed = cells("deployed", F.col("deployed.model"), F.col("deployed"), _SCORES[:2])
    rows = F.concat(F.coalesce(validation, F.array()), F.when(F.col("test").isNotNull(), test).otherwise(F.array()),
                    F.when(F.col("deployed").isNotNull(), deployed).otherwise(F.array()))
    return document.select(F.explode(rows).alias("m")).select("m.*")


def error_band(metrics: DataFrame, stage: str = "deployed", metric: str = "mae_hours") -> float:
    """The mean absolute error a stage reported (one row), used as band width when scoring."""
    return metrics.where((F.col("stage") == stage) & (F.col("metric") == metric)).first()["value"]


def headline_metrics(tidy: DataFrame, rows: int, importance: DataFrame, feature: str = "problem_type_encoded") -> DataFrame:
    """Rows modelled, test R² and MAE, and the part of the importance that one feature holds."""
    def score(name: str) -> Column:
        return F.max(F.when((F.col("stage") == "test") & (F.col("metric") == name), F.col("value")))

    scores = tidy.agg(F.lit(rows).cast("bigint").alias("rows"), score("r2").alias("test_r2"), score("mae_hours").alias("test_mae_hours"))
    part = importance.agg(F.coalesce(F.max(F.when(F.col("feature") == feature, F.col("importance"))), F.lit(0.0)).alias("i"))
    # Both sides are one aggregate row.
    return scores.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one").select(
        "rows", "test_r2", "test_mae_hours", F.round(F.col("i") * 100, 0).alias("problem_type_pct")
    )
