"""Random forests of deep trees for regression.

A histogram for each node, as Spark's own forest gathers them, costs as much for a node of ten rows as for
one of a million. Here only nodes of many rows are split by histograms over all rows; the rows of a smaller
node are shuffled together, and a task grows everything below it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from math import exp, factorial, frexp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnaround.operators.joins import quoted
from turnaround.sources.storage import drop, materialize

#: A node of at most so many rows (drawn twice, counted twice) is grown whole by one task.
GROWN_ROWS = 1 << 19
#: Rows packed together; so many bytes of histograms are held by a task, of rows shuffled in a round.
BLOCK_ROWS, HELD_BYTES, ROUND_BYTES = 1 << 14, 64 << 20, 2 << 30
#: Rows scored together; a task scores so many by the parts of trees that come to it.
SCORED_BLOCK, SCORED_ROWS = 1 << 16, 1 << 20
#: Bytes handed to Python at once.
BATCH_BYTES = 16 << 20
#: Gains below this part of the target's squared size are rounding errors.
DUST = 1e-24
#: Gains this close are equal, and the first feature's first cut is taken: sums of the same rows in another
#: order differ that little.
TIE = 1 + 1e-9
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Chance of being drawn at most 0, 1, 2 ... times in as many draws as there are rows.
_DRAWS = np.cumsum([exp(-1) / factorial(k) for k in range(20)])

_BLOCKS = "at long, n int, key binary, y binary, codes binary, size double, total double"
_PARTS = "tree int, root int, feature array<smallint>, cut array<int>, left array<int>, value array<double>, importance array<double>"
Batches = Iterator[pa.RecordBatch]


# --- Rows: binned and packed ------------------------------------------------------------------


def _prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)


def named_rows(dataset: DataFrame, key: str, label: str, features: str) -> DataFrame:
    """Rows `key, y, x`; without the key column they are numbered as they are read."""
    return dataset.select(
        (F.xxhash64(quoted(key)) if key in dataset.columns else F.monotonically_increasing_id()).alias("key"),
        quoted(label).cast("double").alias("y"),
        vector_to_array(quoted(features)).alias("x"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def find_cuts(rows: DataFrame, bins: int) -> list[list[float]]:
    """Per feature of the vectors `x` the values that part its bins, rising: between all values it has, if
    they are `bins` at most, else at its quantiles."""

    def seen(batches: Batches) -> Batches:
        values: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for i, column in enumerate(_matrix(batch.column(0)).T):
                    if len(values.get(i, ())) <= bins:
                        values[i] = np.unique(np.concatenate([values.get(i, column[:0]), column]))[: bins + 1]
        for i, v in values.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v)], ["feature", "value"])

    found: dict[int, list[float]] = {}
    for r in rows.select("x").mapInArrow(seen, "feature int, value double").distinct().collect():
        found.setdefault(r.feature, []).append(r.value)
    cuts = {i: np.sort(v) for i, v in found.items()}
    cuts = {i: [float(c) for c in v[:-1] + np.diff(v) / 2] for i, v in cuts.items()}
    many = [i for i, v in found.items() if len(v) > bins]
    if many:
        columns = rows.select(*[F.col("x")[i].alias(f"x{i}") for i in many])
        shares = [k / bins for k in range(1, bins)]
        for i, values in zip(many, columns.approxQuantile([f"x{i}" for i in many], shares, 0.1 / bins)):
            cuts[i] = sorted(set(values))
    return [cuts[i] for i in sorted(cuts)]


def _code_type(cuts: list[list[float]]) -> type:
    return np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16


def encode(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin numbers, a row per feature: how many cuts a value is above."""
    codes = np.empty(x.T.shape, _code_type(cuts))
    for i, c in enumerate(cuts):
        codes[i] = np.searchsorted(np.asarray(c, float), x[:, i], side="left")
    return codes


class Layout:
    """Features with few bins share a column of codes, so that one count over a column serves all of them."""

    def __init__(self, bins: list[int]):
        self.bins, self.most, sizes = bins, max(256, *bins), []
        self.column, self.stride = np.zeros(len(bins), int), np.ones(len(bins), int)
        for f, b in enumerate(bins):
            c = next((c for c, s in enumerate(sizes) if s * b <= 256), len(sizes))
            if c == len(sizes):
                sizes.append(1)
            self.column[f], self.stride[f] = c, sizes[c]
            sizes[c] *= b
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(bins)])
        # Per column: which bins of its features a code stands for (None: the code is the bin), and their places
        # in a histogram.
        self.members = []
        for c, size in enumerate(sizes):
            mine = np.flatnonzero(self.column == c)
            hot = [self.bin_of(f, np.arange(size))[:, None] == np.arange(bins[f]) for f in mine if len(mine) > 1]
            places = [np.arange(self.starts[f], self.starts[f + 1]) for f in mine]
            self.members.append((np.concatenate(hot, axis=1).astype(float) if len(mine) > 1 else None, np.concatenate(places)))

    def bin_of(self, feature: int, code: np.ndarray) -> np.ndarray:
        return code // self.stride[feature] % self.bins[feature]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        columns = np.zeros((len(self.sizes), codes.shape[1]), np.uint8 if self.most <= 256 else np.uint16)
        for f, code in enumerate(codes):
            columns[self.column[f]] += (code * self.stride[f]).astype(columns.dtype)
        return columns

    def unpack(self, columns: bytes, rows: int) -> np.ndarray:
        """Codes of the features, a row each, as `pack` was given them."""
        packed = np.frombuffer(columns, np.uint8 if self.most <= 256 else np.uint16).reshape(-1, rows)
        found = np.empty((len(self.bins), rows), packed.dtype)
        for f, c in enumerate(self.column):
            found[f] = self.bin_of(f, np.arange(self.sizes[c])).astype(packed.dtype)[packed[c]]
        return found

    def sums(self, place: np.ndarray, nodes: int, columns: np.ndarray, rows: np.ndarray, values: tuple) -> np.ndarray:
        """Per value, node and bin what `rows` of the columns, at their places, sum to (None: their number)."""
        found = np.empty((len(values), nodes, self.starts[-1]))
        for column, size, (hot, bins) in zip(columns, self.sizes, self.members):
            code = place * size + column[rows]
            for k, v in enumerate(values):
                counted = np.bincount(code, v, nodes * size).reshape(nodes, size)
                found[k][:, bins] = counted if hot is None else counted @ hot
        return found


def pack(rows: DataFrame, cuts: list[list[float]], most: int | None = None) -> DataFrame:
    """Rows `key, y, x` as blocks, numbered by `at`, of up to `most` (`BLOCK_ROWS`) rows and a few more."""
    most = most or BLOCK_ROWS

    def packed(batches: Batches) -> Batches:
        held, number = [], TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            key, y, x = (np.concatenate(v) for v in zip(*held))
            values = [number, len(key), key.tobytes(), y.tobytes(), encode(x, cuts).tobytes(), float(np.abs(y).max()), float(y.sum())]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in _BLOCKS.split(", ")]
            )

        for batch in batches:
            for i in range(0, batch.num_rows, most):
                key, y, x = batch.slice(i, most).columns
                held.append((key.to_numpy(), y.to_numpy(), _matrix(x)))
                if sum(len(h[0]) for h in held) >= most:
                    yield block()
                    held, number = [], number + 1
        if held:
            yield block()

    return rows.select("key", "y", "x").mapInArrow(packed, _BLOCKS)


def chance(seed: int, tree: int, key: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 per row and tree, by a hash of key, tree and seed (SplitMix64), so the same under
    any partitioning."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1342543DE82EF95) % 2**64)
        for _ in range(2):
            z = z + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) * 2.0**-53


def draws(seed: int, tree: int, key: np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson."""
    return np.searchsorted(_DRAWS, chance(seed, tree, key), side="right").astype(np.uint8)


# --- Trees ------------------------------------------------------------------------------------


def walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The leaf of each row: rows above a node's cut go to the child behind the left one."""
    node, rows, flat = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1]), codes.ravel()
    while len(rows):
        rows = rows.take(np.flatnonzero(feature.take(node.take(rows)) >= 0))
        at = node.take(rows)
        code = flat.take(feature.take(at).astype(np.int64) * len(node) + rows)
        node[rows] = left.take(at) + (code > cut.take(at))
    return node


def _gains(c: np.ndarray, s: np.ndarray, count: np.ndarray, least: int) -> np.ndarray:
    """What squared errors fall by when `c` of `count` rows go left, whose distances from the node's mean
    sum to `s`; zero where a side is too small."""
    other = count - c
    ok = (c >= least) & (other >= least)
    return np.where(ok, s * s * count / np.where(ok, c * other, 1), 0)


def _best_dense(c: np.ndarray, s: np.ndarray, count: np.ndarray, mean: np.ndarray | None, least: int) -> tuple:
    """Greatest gain and its cut per node, from counts and sums per node and bin."""
    c, s = c.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
    g = _gains(c, s if mean is None else s - c * mean[:, None], count[:, None], least)
    cut = (g * TIE >= g.max(1, keepdims=True)).argmax(1)
    return g[np.arange(len(g)), cut], cut


def _order(code: np.ndarray, limit: int) -> np.ndarray:
    """Stable order of numbers below a limit, by 16 bits at a time, which NumPy sorts in linear time."""
    if limit > 1 << 32:
        return np.argsort(code, kind="stable")
    order = np.argsort(code.astype(np.uint16), kind="stable")
    return order if limit <= 1 << 16 else order[np.argsort((code >> 16).astype(np.uint16)[order], kind="stable")]


def _best_sorted(code: np.ndarray, bins: int, w: np.ndarray, e: np.ndarray, count: np.ndarray, least: int) -> tuple:
    """The same from rows in order of their nodes, where most bins of most nodes are empty."""
    order = _order(code, len(count) * bins)
    code, c, s = code[order], w[order].cumsum(), e[order].cumsum()
    ends = np.flatnonzero(np.append(code[1:] != code[:-1], True))
    node, c, s = code[ends] // bins, c[ends], s[ends]
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    before = np.where(first > 0, first - 1, 0)
    c = c - np.where(first > 0, c[before], 0)[node]
    s = s - np.where(first > 0, s[before], 0)[node]
    g = _gains(c, s, count[node], least)
    most = np.maximum.reduceat(g, first)
    hits = np.flatnonzero(g * TIE >= most[node])
    hits = hits[np.append(True, node[hits][1:] != node[hits][:-1])]
    return g[hits], code[ends][hits] % bins


def grow(codes: np.ndarray, w: np.ndarray, y: np.ndarray, bins: list[int], depth: int, least: int) -> tuple:
    """A tree over binned rows `codes` (a row per feature) drawn `w` times, level by level: feature (-1 in a
    leaf), cut, left child and mean per node, and the gain per feature."""
    w, floor = w.astype(float), DUST * float(np.abs(y).max()) ** 2
    layout = Layout(bins)
    columns = layout.pack(codes)
    at, made = np.zeros(len(y), np.int64), [[], [], [], []]
    importance, first, nodes = np.zeros(len(bins)), 0, 1
    for level in range(depth + 1):
        count = np.bincount(at, w, nodes)
        mean = np.bincount(at, w * y, nodes) / count
        feature, cut = np.full(nodes, -1, np.int16), np.zeros(nodes, np.int32)
        left, best = np.zeros(nodes, np.int32), np.zeros(nodes)
        if level < depth:
            # Nodes too small to split end here. While nodes are few, rows are counted by columns as they lie, then
            # kept in order of their nodes.
            large = count >= 2 * least
            kept, ids = np.flatnonzero(large[at]), np.flatnonzero(large)
            few = columns is not None and len(ids) * layout.most <= len(kept)
            if not few:
                kept, columns = kept[_order(at[kept], nodes)], None
            if not few or len(kept) < len(at):
                at, w, y, codes = at[kept], w[kept], y[kept], codes.take(kept, 1)
                columns = columns.take(kept, 1) if few else None
            place = np.zeros(nodes, np.int64)
            place[ids] = np.arange(len(ids))
            at = place[at]
            e, total, gain = w * (y - mean[ids][at]), count[ids], floor * count[ids]
            sums = layout.sums(at, len(ids), columns, slice(None), (w, e)) if few else None
            for f, b in enumerate(bins):
                if b < 2 or not len(ids):
                    continue
                if few:
                    g, c = _best_dense(*sums[:, :, layout.starts[f] : layout.starts[f + 1]], total, None, least)
                elif b == 2:  # a flag: only the rows that have it are summed
                    has = np.flatnonzero(codes[f] != 0)
                    c, s = (np.bincount(at[has], v[has], len(ids)) for v in (w, e))
                    g, c = _gains(total - c, s, total, least), np.zeros(len(ids), np.int32)
                elif len(ids) * b > 8 * len(at):
                    g, c = _best_sorted(at * b + codes[f], b, w, e, total, least)
                else:
                    code = at * b + codes[f]
                    c, s = (np.bincount(code, v, len(ids) * b).reshape(-1, b) for v in (w, e))
                    g, c = _best_dense(c, s, total, None, least)
                better = g > TIE * gain
                gain = np.where(better, g, gain)
                feature[ids[better]], cut[ids[better]], best[ids[better]] = f, c[better], g[better]
            split = feature >= 0
            left[split] = first + nodes + 2 * np.arange(split.sum())
            np.add.at(importance, feature[split], best[split])
            stays = np.flatnonzero(split[ids[at]])
            at = ids[at[stays]]
            if len(stays) < len(w):
                w, y, codes = w[stays], y[stays], codes.take(stays, 1)
                columns = columns.take(stays, 1) if few else None
            code = codes.ravel().take(feature.take(at).astype(np.int64) * len(at) + np.arange(len(at)))
            at = left.take(at) - first - nodes + (code > cut.take(at))
        for rows, new in zip(made, (feature, cut, left, mean)):
            rows.append(new)
        first, nodes = first + nodes, 2 * int((feature >= 0).sum())
        if not nodes:
            break
    return *map(np.concatenate, made), importance


class Top:
    """The upper nodes of one tree, split one level after the other on the driver's side: a few arrays."""

    def __init__(self, rows: float):
        self.feature, self.cut, self.left = [-1], [0], [0]
        self.depth, self.count = [0], [rows]
        self.mean: dict[int, float] = {}  # of nodes that cannot be split
        self.importance: dict[int, float] = {}

    def open(self, depth: int) -> list[int]:
        """Nodes with too many rows for a task that can still be split."""
        return [
            i for i, f in enumerate(self.feature)
            if f < 0 and i not in self.mean and self.count[i] > GROWN_ROWS and self.depth[i] < depth
        ]

    def split(self, node: int, feature: int, cut: int, gain: float, sizes: tuple[float, float]) -> None:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        self.importance[feature] = self.importance.get(feature, 0) + gain
        for size in sizes:
            for values, new in zip((self.feature, self.cut, self.left, self.depth, self.count), (-1, 0, 0, self.depth[node] + 1, size)):
                values.append(new)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)


def _blocks_of(batches: Batches, cuts: list[list[float]]) -> Iterator[tuple]:
    kind = _code_type(cuts)
    for batch in batches:
        for at, n, key, y, codes in zip(*(batch.column(c).to_pylist() for c in ("at", "n", "key", "y", "codes"))):
            yield at, np.frombuffer(key, np.int64), np.frombuffer(y), np.frombuffer(codes, kind).reshape(len(cuts), n)


def _drawn(blocks: Iterator[tuple], tops: dict[int, Top], seed: int | None) -> Iterator[tuple]:
    """Per block and tree the rows drawn, with the top node that each ends in."""
    arrays = {tree: top.arrays() for tree, top in tops.items()}
    for at, key, y, codes in blocks:
        for tree, top in arrays.items():
            w = np.ones(len(key), np.uint8) if seed is None else draws(seed, tree, key)
            rows = np.flatnonzero(w)
            drawn = codes.take(rows, 1)
            yield at, tree, w[rows], y[rows], drawn, walk(*top, drawn)


def split_open(blocks: DataFrame, tops: dict[int, Top], cuts: list[list[float]], middle: float, floor: float, depth: int, least: int, seed: int | None) -> bool:
    """One more level of the nodes with too many rows for one task, by histograms of all rows: counts and
    sums per node and bin are added up by task, then by tree. False if there is no such node."""
    nodes = {tree: n for tree, top in tops.items() if (n := top.open(depth))}
    if not nodes:
        return False
    bins = [len(c) + 1 for c in cuts]
    layout, starts = Layout(bins), np.concatenate([[0], np.cumsum(bins)])
    asked = {tree: tops[tree] for tree in nodes}

    def histograms(batches: Batches) -> Batches:
        held: dict[int, tuple[int, np.ndarray]] = {}

        def emptied() -> Batches:
            for tree, (at, h) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.array([tree], pa.int32()), pa.array([h.tobytes()], pa.binary())], ["at", "tree", "sums"]
                )
            held.clear()

        places = {tree: np.full(len(top.feature), -1) for tree, top in asked.items()}
        for tree, place in places.items():
            place[nodes[tree]] = np.arange(len(nodes[tree]))
        arrays = {tree: top.arrays() for tree, top in asked.items()}
        for at, key, y, codes in _blocks_of(batches, cuts):
            columns = layout.pack(codes)
            for tree, top in arrays.items():
                w = np.ones(len(key), np.uint8) if seed is None else draws(seed, tree, key)
                place = places[tree][walk(*top, codes)]
                rows = np.flatnonzero((place >= 0) & (w > 0))
                drawn = w[rows].astype(float)
                found = layout.sums(place[rows], len(nodes[tree]), columns, rows, (drawn, drawn * (y[rows] - middle)))
                if tree in held:
                    held[tree][1][:] += found
                else:
                    held[tree] = at, found
                if sum(h.nbytes for _, h in held.values()) > HELD_BYTES:
                    yield from emptied()
        yield from emptied()

    def best(key: tuple, table: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        parts = sorted(zip(table.column("at").to_pylist(), table.column("sums").to_pylist()), key=lambda p: p[0])
        h = sum(np.frombuffer(p).reshape(2, len(nodes[tree]), -1) for _, p in parts)
        count = h[0, :, : bins[0]].sum(1)
        mean = h[1, :, : bins[0]].sum(1) / count
        gain, feature, cut, lower = np.zeros(len(count)), np.full(len(count), -1), np.zeros(len(count), int), np.zeros(len(count))
        for f, b in enumerate(bins):
            if b > 1:
                c, s = h[:, :, starts[f] : starts[f + 1]]
                g, at = _best_dense(c, s, count, mean, least)
                better = g > np.maximum(TIE * gain, floor * count)
                gain, feature, cut = np.where(better, g, gain), np.where(better, f, feature), np.where(better, at, cut)
                lower = np.where(better, c.cumsum(1)[np.arange(len(c)), at], lower)
        return pa.table(
            {"tree": pa.array(np.full(len(count), tree, np.int32)), "node": pa.array(nodes[tree], pa.int32()), "feature": pa.array(feature, pa.int32()),
             "cut": pa.array(cut, pa.int32()), "gain": gain, "mean": mean + middle, "lower": lower, "upper": count - lower}
        )

    sums = blocks.mapInArrow(histograms, "at long, tree int, sums binary")
    found = sums.groupBy("tree").applyInArrow(best, "tree int, node int, feature int, cut int, gain double, mean double, lower double, upper double")
    for r in found.orderBy("tree", "node").collect():
        if r.feature < 0:
            tops[r.tree].mean[r.node] = r.mean
        else:
            tops[r.tree].split(r.node, r.feature, r.cut, r.gain, (r.lower, r.upper))
    return True


def grow_below(blocks: DataFrame, tops: dict[int, Top], cuts: list[list[float]], depth: int, least: int, seed: int | None, tasks: int) -> DataFrame:
    """The rows of each leaf of the tops, met by a shuffle, grown to the end: a row per tree and leaf.

    A node at the greatest depth or without a cut is a leaf of the tree; of its rows only sums travel."""
    bins, kind = [len(c) + 1 for c in cuts], _code_type(cuts)
    closed = {tree: [i for i, d in enumerate(top.depth) if i in top.mean or d >= depth] for tree, top in tops.items()}

    def dealt(batches: Batches) -> Batches:
        for at, tree, w, y, codes, node in _drawn(_blocks_of(batches, cuts), tops, seed):
            order = np.argsort(node, kind="stable")
            found, start = np.unique(node[order], return_index=True)
            groups = np.split(order, start[1:]) if len(found) else []
            values = []
            for root, rows in zip(found, groups):
                if int(root) in closed[tree]:
                    n = float(w[rows].sum())
                    values.append((int(root), 0, n, float((w[rows] * y[rows]).sum()), b"", b"", b""))
                else:
                    values.append((int(root), len(rows), 0.0, 0.0, w[rows].tobytes(), y[rows].tobytes(), codes.take(rows, 1).tobytes()))
            if values:
                root, n, count, total, *packed = zip(*values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(root), pa.int32()), pa.array(root, pa.int32()), pa.array([at] * len(root), pa.int64()), pa.array(n, pa.int32()),
                     pa.array(count, pa.float64()), pa.array(total, pa.float64()), *[pa.array(p, pa.binary()) for p in packed]],
                    ["tree", "root", "at", "n", "count", "total", "w", "y", "codes"],
                )

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        tree, root = (k.as_py() for k in key)
        rows = sorted(table.select(["at", "n", "count", "total", "w", "y", "codes"]).to_pylist(), key=lambda r: r["at"])
        if root in closed[tree]:
            mean = sum(r["total"] for r in rows) / sum(r["count"] for r in rows)
            made = np.array([-1], np.int16), np.zeros(1, np.int32), np.zeros(1, np.int32), np.array([mean]), np.zeros(len(bins))
        else:
            w = np.concatenate([np.frombuffer(r["w"], np.uint8) for r in rows])
            y = np.concatenate([np.frombuffer(r["y"]) for r in rows])
            codes = np.concatenate([np.frombuffer(r["codes"], kind).reshape(len(bins), r["n"]) for r in rows], axis=1)
            made = grow(codes, w, y, bins, depth - tops[tree].depth[root], least)
        types = [pa.int16(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        names = ["feature", "cut", "left", "value", "importance"]
        arrays = {n: pa.ListArray.from_arrays([0, len(m)], pa.array(m, t)) for n, m, t in zip(names, made, types)}
        return pa.table({"tree": pa.array([tree], pa.int32()), "root": pa.array([root], pa.int32()), **arrays})

    rows = blocks.mapInArrow(
        dealt, "tree int, root int, at long, n int, count double, total double, w binary, y binary, codes binary"
    )
    return rows.repartition(tasks, "tree", "root").groupBy("tree", "root").applyInArrow(grown, _PARTS)


# --- Estimator and model ----------------------------------------------------------------------


class Forest(Estimator, HasLabelCol, HasFeaturesCol, HasPredictionCol, HasSeed):
    """Mean of regression trees, each over as many draws of rows as there are rows, all features at every
    node, splits by variance between bins. Every node is split until it has `maxDepth` nodes above it, no cut
    leaves `minInstancesPerNode` draws on both sides, or its targets are equal.

    `keyCol` names rows for the draws; without such a column they are numbered as they are read."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth of a leaf", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least draws in a leaf", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "most bins per feature", TypeConverters.toInt)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether each tree draws its rows", TypeConverters.toBoolean)
    keyCol = Param(Params._dummy(), "keyCol", "column that names rows", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol="label", numTrees=200, maxDepth=20, minInstancesPerNode=5, maxBins=256, bootstrap=True, keyCol="unique_key", seed=42):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(labelCol="label", numTrees=200, maxDepth=20, minInstancesPerNode=5, maxBins=256, bootstrap=True, keyCol="unique_key", seed=42)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        spark = dataset.sparkSession
        _prepare(spark)
        trees, depth, least = (self.getOrDefault(p) for p in (self.numTrees, self.maxDepth, self.minInstancesPerNode))
        seed = self.getSeed() if self.getOrDefault(self.bootstrap) else None
        rows = named_rows(dataset, self.getOrDefault(self.keyCol), self.getLabelCol(), self.getFeaturesCol())
        cuts = find_cuts(rows, self.getOrDefault(self.maxBins))
        blocks = materialize(pack(rows, cuts), "forest-rows")
        n, size, total = blocks.agg(F.sum("n"), F.max("size"), F.sum("total")).first()
        if not n:
            raise ValueError("no rows to fit")
        each = n * (len(cuts) * np.dtype(_code_type(cuts)).itemsize + 9)
        at_once = max(1, min(trees, ROUND_BYTES // each))
        parts, tops = [], {}
        for first in range(0, trees, at_once):
            now = {tree: Top(n) for tree in range(first, min(trees, first + at_once))}
            while split_open(blocks, now, cuts, total / n, DUST * size**2, depth, least, seed):
                pass
            tasks = max(16 * spark.sparkContext.defaultParallelism, each * len(now) // HELD_BYTES)
            leaves = sum(top.feature.count(-1) for top in now.values())
            parts.append(materialize(grow_below(blocks, now, cuts, depth, least, seed, min(tasks, leaves)), "forest-trees"))
            tops |= now
        drop(blocks)
        grown = parts[0]
        for part in parts[1:]:
            grown = grown.unionByName(part)
        return self._copyValues(
            ForestModel(grown, cuts, [[[int(v) for v in a] for a in tops[t].arrays()] for t in range(trees)], float(size), _importances(grown, tops, len(cuts)))
        )


def _paths(feature: list[int], cut: list[int], left: list[int]) -> dict[int, list[tuple[int, int, bool]]]:
    """Per node the features and cuts above it, and whether its rows are above those."""
    found = {0: []}
    for i, f in enumerate(feature):
        if f >= 0:
            found[left[i]], found[left[i] + 1] = (found[i] + [(f, cut[i], right)] for right in (False, True))
    return found


def _importances(parts: DataFrame, tops: dict[int, Top], features: int) -> list[float]:
    """Each tree's gains as parts of its own total, averaged over the trees that have any."""
    gains = np.zeros((len(tops), features))
    sums = parts.select("tree", F.posexplode("importance")).groupBy("tree", "pos").agg(F.sum("col").alias("gain"))
    for r in sums.collect():
        gains[r.tree, r.pos] = r.gain
    for tree, top in tops.items():
        for f, gain in top.importance.items():
            gains[tree, f] += gain
    total = gains.sum(1, keepdims=True)
    shares = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).sum(0)
    return [float(s) for s in (shares / shares.sum() if shares.sum() else shares)]


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """A fitted forest. Its trees are a table, parts of trees as arrays of nodes; the driver has only the
    cuts of the bins and the upper nodes."""

    def __init__(self, parts: DataFrame, cuts: list, tops: list, size: float, importances: list[float]):
        super().__init__()
        self.parts, self.cuts, self.tops, self.size, self.importances = parts, cuts, tops, size, importances

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importances)

    def getNumTrees(self) -> int:
        return len(self.tops)

    def _unit(self) -> float:
        """Means are added up as whole multiples of this power of two, of which no sum of all trees overflows:
        sums are then the same in any order."""
        return 2.0 ** (frexp(self.size)[1] + len(self.tops).bit_length() - 61)

    def _scorer(self) -> Callable:
        unit, paths = self._unit(), [_paths(*top) for top in self.tops]

        def score(codes: np.ndarray, tree: int, root: int, feature, cut, left, value) -> tuple[np.ndarray, np.ndarray]:
            """The rows that come to this part of a tree, and what it adds to them."""
            comes = np.ones(codes.shape[1], bool)
            for f, c, right in paths[tree][root]:
                comes &= codes[f] > c if right else codes[f] <= c
            rows = np.flatnonzero(comes)
            return rows, np.rint(value[walk(feature, cut, left, codes.take(rows, 1))] / unit).astype(np.int64)

        return score

    def _transform(self, dataset: DataFrame) -> DataFrame:
        _prepare(dataset.sparkSession)
        return self._row_by_row(dataset) if dataset.isStreaming else self._by_tree(dataset)

    def _by_tree(self, dataset: DataFrame) -> DataFrame:
        """Parts of trees meet blocks of rows, and what they add is summed by row: no task has all trees, nor more
        than `SCORED_ROWS` rows."""
        cuts, score, own = self.cuts, self._scorer(), "_row"
        while own in dataset.columns:
            own += "_"
        rows = materialize(dataset.withColumn(own, F.monotonically_increasing_id()), "forest-scored")
        named = rows.select(F.col(own).alias("key"), F.lit(0.0).alias("y"), vector_to_array(quoted(self.getFeaturesCol())).alias("x"))
        layout = Layout([len(c) + 1 for c in cuts])

        def shared(batches: Batches) -> Batches:
            for at, key, _, codes in _blocks_of(batches, cuts):
                values = [pa.array([v], t) for v, t in ((at, pa.int64()), (key.tobytes(), pa.binary()), (layout.pack(codes).tobytes(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(values, ["at", "key", "columns"])

        kept = "at long, key binary, columns binary"
        blocks = materialize(pack(named, cuts, SCORED_BLOCK).mapInArrow(shared, kept), "forest-blocks")

        def added(batches: Batches) -> Batches:
            sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                names = ["feature", "cut", "left", "value"]
                for i, (at, tree, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "tree", "root")))):
                    if at not in sums:
                        key = np.frombuffer(batch.column("key")[i].as_py(), np.int64)
                        sums[at] = key, layout.unpack(batch.column("columns")[i].as_py(), len(key)), np.zeros(len(key), np.int64)
                    part = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in names]
                    found, more = score(sums[at][1], tree, root, *part)
                    sums[at][2][found] += more
            for key, _, total in sums.values():
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], ["key", "total"])

        dealt = blocks.repartition(-(-blocks.count() * SCORED_BLOCK // SCORED_ROWS) or 1)
        pairs = self.parts.drop("importance").hint("shuffle_replicate_nl").crossJoin(dealt)
        sums = pairs.mapInArrow(added, "key long, total long").groupBy("key").agg(F.sum("total").alias("total"))
        value = (F.col("total") * F.lit(self._unit()) / len(self.tops)).alias(self.getPredictionCol())
        predicted = materialize(sums.select(F.col("key").alias(own), value), "forest-predictions")
        drop(blocks)
        return rows.join(predicted, own).drop(own)

    def _row_by_row(self, dataset: DataFrame) -> DataFrame:
        """For streams, whose rows are answered one by one: every worker has all trees."""
        cuts, score, unit, trees = self.cuts, self._scorer(), self._unit(), len(self.tops)
        names = ["feature", "cut", "left", "value"]
        parts = [(r.tree, r.root, *[np.array(r[c]) for c in names]) for r in self.parts.drop("importance").toLocalIterator()]
        sent = dataset.sparkSession.sparkContext.broadcast(parts)

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            total = np.zeros(len(x), np.int64)
            if len(x):
                codes = encode(np.stack(x), cuts)
                for part in sent.value:
                    found, more = score(codes, *part)
                    total[found] += more
            return pd.Series(total * unit / trees)

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(quoted(self.getFeaturesCol()))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        extra = {"cuts": m.cuts, "tops": m.tops, "size": m.size, "importances": m.importances}
        DefaultParamsWriter.saveMetadata(m, path, m.parts.sparkSession, extraMetadata={"forest": extra})
        m.parts.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        extra = metadata["forest"]
        model = ForestModel(spark.read.parquet(f"{path}/trees"), extra["cuts"], extra["tops"], extra["size"], extra["importances"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
