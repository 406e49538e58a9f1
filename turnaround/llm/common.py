"""What the corpus operators share: reading, batching, set broadcasts, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnaround.sources.storage import drop, materialize

#: Rows handed to Python at once. Texts are read whole.
BATCH_ROWS = 1000
#: A batch ends early once its rows hold so many bytes, so long texts do not pile up in a worker.
BATCH_BYTES = 16 << 20
_keepers: dict[str, Callable[[], None]] = {}
_last: list[str] = []
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """`mapInArrow` with bounded batches; Python workers import the library from where the driver has it.
    Columns with a dot in their names reach `fn` under other names, in their places."""
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        try:
            yield from fn(batches)
        finally:
            give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    # The call resolves columns by name and reads a dot as field access.
    free = free_prefix(df.columns)
    return df.toDF(*[f"{free}{i}" if "." in c else c for i, c in enumerate(df.columns)]).mapInArrow(run, schema)


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """States that a module keeps something in its workers from task to task, and how to drop it."""
    _keepers[owner] = forget


def make_room(owner: str) -> None:
    """A worker keeps what one module loads: when another's turn comes, the others' is dropped. Workers
    outlive a stage, so else the caches of all stages would add up in each."""
    if _last != [owner]:
        for other, forget in _keepers.items():
            if other != owner:
                forget()
        _last[:] = [owner]
        gc.collect()


def give_back() -> None:
    """Hands memory that a task no longer uses back to the system: an idle worker keeps its caches only."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column begins with: names behind them clash with none of `columns`."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """The document id, its text (null: empty) and further named columns; other columns, whatever
    their names, play no part."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of an undirected graph: `(node, component)`, component the least node.

    `edges` holds longs `u`, `v`. Large-star and small-star steps alternate until only stars are left; a
    node's neighbours are only ever reduced to their minimum (a pre-aggregated shuffle) and joined
    back, so a hub's neighbours never gather in one task. Every round is a stored table.
    """
    current = materialize(edges.where("u <> v").selectExpr("least(u, v) u", "greatest(u, v) v").distinct(), label)
    while not _stars(current):
        # Large star: neighbours above a node are linked to the least of the node's neighbourhood.
        both = current.unionByName(current.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(least, "u").selectExpr("m u", "v").where("u <> v")
        # Small star: neighbours below a node, and the node, are linked to the least of them.
        down = large.selectExpr("v n", "u below")
        floor = down.groupBy("n").agg(F.min("below").alias("m"))
        small = down.join(floor, "n").selectExpr("m u", "explode(array(below, n)) v").where("u <> v").distinct()
        past, current = current, materialize(small, label)
        drop(past)
    return current.selectExpr("v node", "u component").unionByName(
        current.selectExpr("u node", "u component").distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges `u < v` are stars around their least nodes, which further steps leave as they are:
    a node below another is its only neighbour, and has none below itself."""
    ends = edges.selectExpr("explode(array(struct(v AS node, 1L AS below), struct(u AS node, 0L AS below))) AS e").select("e.*")
    met = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return met.agg(F.count_if((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("least") == 0)))).first()[0] == 0
