"""Requests scored as they arrive. Each row is answered by itself: no state, no watermark."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from turnaround.operators.scoring import answer_requests, score_requests


def read_requests(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream over Parquet files of requests as they are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start_scoring(
    requests: DataFrame,
    model: PipelineModel,
    encoding: DataFrame,
    features: list[str],
    mae_hours: float,
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    """Answer everything available now and append the answers to a Parquet folder; a refused request
    is answered with its reasons in `errors`.

    The checkpoint records what was answered, so a restart neither loses nor repeats a request. A
    service runs the same query with a processing-time trigger.
    """
    answers = answer_requests(requests, model, encoding, features, mae_hours)
    return (
        answers.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def start_publishing(
    requests: DataFrame,
    model: PipelineModel,
    encoding: DataFrame,
    features: list[str],
    mae_hours: float,
    answers: str,
    refusals: str,
    checkpoint: str,
) -> StreamingQuery:
    """Answer everything available now into two tables, answers and refusals.

    A batch is a version, the folder `batch=<id>` of either table. A batch that was cut short is played
    again from the checkpoint and replaces its own folders, so each request ends up once, in one table;
    files of a write that did not finish are in no table. Both tables have the column `batch`.
    """

    def publish(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for table, folder in zip(score_requests(batch, model, encoding, features, mae_hours), (answers, refusals)):
                table.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
