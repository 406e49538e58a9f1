"""Whole jobs: export to tables, tables to model, model to answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnaround.operators import analysis, cleaning, evaluation, features, findings, modelling
from turnaround.sources import exports, storage


class LoadRefused(ValueError):
    """A load that was written but not published; `found` says why, by name and count."""

    def __init__(self, found: dict[str, int]):
        super().__init__(", ".join(f"{name}: {n}" for name, n in found.items()))
        self.found = found


def load_raw(
    spark: SparkSession, csv_folder: str, table: str, multi_line: bool = False, most_broken: int | None = None
) -> DataFrame:
    """CSV export to the raw table (full reload); broken records go to `<table>_quarantine`.

    The new version is published only if it keeps the table's rules: see `gated_publish`. With
    `most_broken` a load with more broken records is refused too.
    """
    whole, broken = exports.split_broken(exports.read_export(spark, csv_folder, multi_line))
    quarantine = storage.publish_table(broken, f"{table}_quarantine")
    if most_broken is not None and (n := quarantine.count()) > most_broken:
        raise LoadRefused({"broken records": n})
    return gated_publish(exports.conform_raw(whole), table)


def gated_publish(df: DataFrame, table: str) -> DataFrame:
    """Publishes a raw table unless keys are null or repeated or values break a column's limit.

    Rows, null keys and values over their limits are counted by the write itself; repeated keys by a
    scan of the written key column. A refused version is never seen by readers, who keep the old one.
    """
    checks = cleaning.constraint_checks(df)
    seen = Observation("load")
    counted = df.observe(
        seen, F.count("*").alias("rows"), F.count_if(F.col("unique_key").isNull()).alias("null keys"),
        *[F.count_if(bad).alias(f"limit of {name}") for name, bad in checks.items()],
    )

    def write(folder: str) -> None:
        counted.write.parquet(folder)
        found = {name: n for name, n in seen.get.items() if name != "rows" and n}
        written = df.sparkSession.read.parquet(folder)
        repeated = cleaning.duplicate_keys(written.select("unique_key")).where("unique_key is not null").count()
        if repeated:
            found["repeated keys"] = repeated
        if found:
            raise LoadRefused(found)

    return df.sparkSession.read.parquet(storage.publish(df.sparkSession, table, write))


def build_tables(raw: DataFrame, folder: str, **window) -> dict[str, DataFrame]:
    """Raw to clean, open and feature tables."""
    spark = raw.sparkSession
    paths = {name: f"{folder}/{name}" for name in ("requests_clean", "requests_open", "request_features")}
    clean = storage.publish_table(cleaning.clean_requests(raw, **window), paths["requests_clean"])
    storage.publish_table(cleaning.open_requests(raw), paths["requests_open"])
    built = features.impute_median(features.request_features(clean))
    storage.publish_table(built, paths["request_features"])
    return {name: storage.scan_table(spark, path) for name, path in paths.items()}


def train(feature_table: DataFrame, folder: str, candidates: dict[str, Estimator] | None = None) -> dict:
    """Compare candidates, refit the best, and store model, predictions and metrics."""
    inputs = modelling.model_inputs(feature_table)
    result = modelling.train_best(inputs, candidates or modelling.default_candidates())
    modelling.save_model(f"{folder}/model", result["model"], result["features"], result["encoding"])
    storage.publish_table(result["predictions"], f"{folder}/request_predictions")
    metrics = storage.materialize(result["metrics"], "metrics")
    document = evaluation.metrics_document(metrics, inputs.count(), result["best"])
    findings.publish_document(document, f"{folder}/model_metrics")
    return {**result, "metrics": metrics}


def train_small(feature_table: DataFrame, folder: str, estimator: Estimator | None = None) -> DataFrame:
    """The small model for serving: fit on 80 % and stored; its test scores are merged as `deployed`
    into the metrics document that `train` wrote beside it, and the document's tidy rows returned.

    It reads the features of the model `train` saved, in their order, whatever the table's columns."""
    saved = modelling.saved_features(feature_table.sparkSession, f"{folder}/model")
    inputs = modelling.align(modelling.model_inputs(feature_table), saved, [modelling.KEY, modelling.TARGET])
    result = modelling.final_test(inputs, modelling.SMALL_FOREST, estimator or modelling.small_forest(), saved)
    modelling.save_model(f"{folder}/deployed_model", result["model"], result["features"], result["encoding"])
    update = evaluation.tidy_metrics(
        evaluation.regression_metrics(result["scored"]), "deployed", modelling.SMALL_FOREST, ["r2", "mae_hours"]
    )
    return evaluation.update_metrics(feature_table.sparkSession, f"{folder}/model_metrics", update)


def build_charts(clean: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Every chart's table under `folder`, from one scan of the clean table."""
    tables = analysis.charts(analysis.count_questions(clean))
    return {name: storage.publish_table(table, f"{folder}/{name}") for name, table in tables.items()}


def error_tables(
    predictions: DataFrame, clean: DataFrame, segments: Sequence[str], buckets: int | None = None, **options
) -> dict[str, DataFrame]:
    """Errors per value of each segment. Both tables are laid out by key once, in `buckets` files (default:
    the session's shuffle partitions), and every segment joins them without a shuffle."""
    spark, key = clean.sparkSession, modelling.KEY
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made, known = [
        storage.write_by_key(df, storage.new_path(spark, label), key, buckets)
        for df, label in ((predictions, "predictions-by-key"), (clean.select(key, *segments), "clean-by-key"))
    ]
    return {s: analysis.error_by_segment(made, known, s, **options) for s in segments}


def publish_findings(short_requests: DataFrame, path: str, **window) -> DataFrame:
    """The findings document of an export's seven columns, written as JSON."""
    base = findings.findings_base(short_requests, **window)
    document = storage.materialize(findings.findings_document(base), "findings")
    findings.publish_document(document, path)
    return document


