"""Approximate nearest neighbours by cross-polytope hashing, exactly reranked."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnaround.llm import common
from turnaround.sources.storage import materialize

#: Hash tables. Each turns the vectors by its own pseudo-rotation; a vector's bucket is the nearest
#: signed axis, and a query probes the quarter of all buckets nearest to it.
TABLES = 32
SEED = 20
#: The bounded sample that sets how many tables must agree: vectors, and queries among them.
SAMPLE, SAMPLE_QUERIES = 8192, 256
#: Share of the sample's true neighbours that may fall short of the agreement asked for.
MISS = 0.03
QUERY_BLOCK = 4096
_SUB, _HELD = 256, 1 << 20
_loaded: dict = {}
common.keeps(__name__, _loaded.clear)


def valid(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null, not zero, all components present and finite."""
    return F.expr(
        f"coalesce(forall({vector}, x -> x is not null and abs(x) < double('Infinity')) "
        f"and exists({vector}, x -> x <> 0), false)"
    )


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal."""
    n, d = x.shape
    h, y = 1, x
    while h < d:
        y = y.reshape(n, d // (2 * h), 2, h)
        z = np.empty_like(y)
        np.add(y[:, :, 0], y[:, :, 1], out=z[:, :, 0])
        np.subtract(y[:, :, 0], y[:, :, 1], out=z[:, :, 1])
        y = z
        h *= 2
    return y.reshape(n, d) / np.float32(d**0.5)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transform."""
    signs = np.random.RandomState(SEED + table).randint(0, 2, (3, x.shape[1])).astype(np.float32) * 2 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray) -> np.ndarray:
    """(tables, rows): the nearest signed axis, 2 i for axis i and 2 i + 1 for its opposite."""
    out = np.empty((TABLES, len(x)), np.uint16)
    for t in range(TABLES):
        y = rotate(x, t)
        axis = np.abs(y).argmax(axis=1)
        out[t] = 2 * axis + (y[np.arange(len(x)), axis] < 0)
    return out


def probes(q: np.ndarray) -> np.ndarray:
    """(tables, queries, buckets): 1 for the quarter of the buckets nearest to each query."""
    n, d = q.shape
    out = np.zeros((TABLES, n, 2 * d), np.uint8)
    for t in range(TABLES):
        y = rotate(q, t)
        signed = np.stack((y, -y), axis=2).reshape(n, 2 * d)
        near = np.argpartition(-signed, max(1, d // 2) - 1, axis=1)[:, : max(1, d // 2)]
        np.put_along_axis(out[t], near, 1, axis=1)
    return out


class Space:
    """How vectors are brought to the unit sphere. Where lengths differ, one more component takes up
    what a vector lacks of the largest length, so that nearness by angle is nearness by inner product."""

    def __init__(self, size: int, shortest: float, longest: float):
        self.size, self.longest = size, longest
        self.even = longest - shortest <= 1e-3 * longest
        self.width = 1 << max(1, int(np.ceil(np.log2(size + (not self.even)))))

    def matrix(self, vectors: list) -> np.ndarray:
        """Rows of original vectors, in double precision; shorter ones end in zeros."""
        if isinstance(vectors, pa.Array):
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(sizes) and (sizes == self.size).all():
                return flat.reshape(-1, self.size)
            vectors = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
        out = np.zeros((len(vectors), self.size))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width), np.float32)
        lengths = np.linalg.norm(x, axis=1)
        if self.even or query:
            out[:, : self.size] = x / lengths[:, None]
        else:
            out[:, : self.size] = x / self.longest
            out[:, self.size] = np.sqrt(np.maximum(0, 1 - (lengths / self.longest) ** 2))
        return out


def agreement(space: Space, sample: np.ndarray, rows: int, k: int) -> int:
    """In how many tables a query must probe a row's bucket for it to be a candidate: as many as all
    but a share MISS of the sample's neighbours reach, a neighbour being as near as the k-th of all rows."""
    if len(sample) < 2 or rows <= k + 1:
        return 0
    queries = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)
    near = sample[queries] @ sample.T
    near[np.arange(len(queries)), queries] = -np.inf
    top = min(len(sample) - 1, max(1, -(-len(sample) * k // rows)))
    found = np.argpartition(-near, top - 1, axis=1)[:, :top]
    mask, bucket = probes(space.unit(sample[queries], True)), buckets(space.unit(sample, False))
    votes = sum(mask[t][np.arange(len(queries))[:, None], bucket[t][found]].astype(int) for t in range(TABLES))
    return int(np.quantile(votes, MISS))


class _Block:
    """A block of queries and the nearest rows found so far."""

    def __init__(self, space: Space, ids: np.ndarray, vectors: np.ndarray, k: int, votes: int):
        self.ids, self.vectors, self.k, self.votes = ids, vectors, k, votes
        self.mask = probes(space.unit(vectors, True)) if votes else None
        self.floor = np.full(len(ids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def meet(self, ids: np.ndarray, x: np.ndarray, bucket: np.ndarray) -> None:
        for at in range(0, len(self.ids), _SUB):
            n = min(_SUB, len(self.ids) - at)
            agreed = np.zeros((n, len(ids)), np.uint8)
            for t in range(TABLES if self.votes else 0):
                agreed += self.mask[t, at : at + n][:, bucket[t]]
            q, r = np.nonzero(agreed >= self.votes)
            q += at
            other = self.ids[q] != ids[r]
            q, r = q[other], r[other]
            for s in range(0, len(q), 1 << 17):
                a, b = q[s : s + (1 << 17)], r[s : s + (1 << 17)]
                score = np.einsum("ij,ij->i", self.vectors[a], x[b])
                keep = score >= self.floor[a]
                self.held.append((a[keep], ids[b[keep]], score[keep]))
                self.size += int(keep.sum())
            if self.size > _HELD + 2 * self.k * len(self.ids):
                self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, i, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[q[last]] = s[last]
        self.held, self.size = [(q[keep], i[keep], s[keep])], int(keep.sum())
        return self.held[0]


def _scan(index: DataFrame, queries: DataFrame, space: Space, k: int, votes: int) -> DataFrame | None:
    """`(query_id, vec_id, score)`: per task and query the k best candidates. Queries go out in blocks
    of bounded size; every block meets all rows where they are stored."""
    spark, out = index.sparkSession, None
    n_blocks = -(-queries.count() // QUERY_BLOCK)
    for i in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i).collect()
        if not rows:
            continue
        ids, vectors = np.array([r["vec_id"] for r in rows], np.int64), space.matrix([r["embedding"] for r in rows])
        shared = spark.sparkContext.broadcast((ids, vectors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = _Block(space, *shared.value, k, votes)
            for batch in batches:
                bucket = np.frombuffer(b"".join(batch.column("buckets").to_pylist()), np.uint16).reshape(-1, TABLES).T
                block.meet(batch.column("vec_id").to_numpy(), space.matrix(batch.column("embedding")), bucket)
            q, v, s = block.trim()
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"]
            )

        part = common.map_batches(index, run, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    return out


RESULT = "query_id long, rank int, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: for each row that is a query the k rows of other ids with the
    largest inner product found, nearest first, ties to the smaller id.

    `vectors` has `vec_id` and `embedding`; `is_query` states the query set. Rows with a null id and
    vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of
    different sizes are filled up with zeros. Rows that repeat an id with equal vectors are one query,
    and candidates each; an empty table gives an empty result. Every row is in the index; the sample
    only sets the agreement. A query with fewer candidates than asked for meets all rows instead.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & valid()).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query")
    )
    norm = F.sqrt(F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)"))
    shape = rows.agg(F.count("*"), F.max(F.size("embedding")), F.min(norm), F.max(norm)).first()
    if not shape[0]:
        return spark.createDataFrame([], RESULT)
    space = Space(*shape[1:])
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    votes = agreement(space, space.matrix([r["embedding"] for r in chosen]), shape[0], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = buckets(space.unit(space.matrix(batch.column("embedding")), False)).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([row.tobytes() for row in np.ascontiguousarray(bucket)], pa.binary())],
                ["vec_id", "embedding", "is_query", "buckets"],
            )

    schema = "vec_id long, embedding array<double>, is_query boolean, buckets binary"
    index = materialize(common.map_batches(rows, run, schema), "vector-index")
    queries = index.where("is_query").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    found = _scan(index, queries, space, k, votes)
    if found is None:
        return spark.createDataFrame([], RESULT)
    best = materialize(_best(found, k), "neighbours")
    if votes:
        full = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
        rest = _scan(index, materialize(queries.join(full, "vec_id", "left_anti"), "rest"), space, k, 0)
        if rest is not None:
            best = best.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(_best(rest, k))
    return best
