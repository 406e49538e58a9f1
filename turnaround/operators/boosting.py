"""Gradient boosting of shallow trees for regression, by squared error.

Spark's own boosting keeps an object per row and runs its jobs over them however few there are. Here rows are
binned and packed once; rows that a task can hold are boosted there from the first round to the last, more
by histograms that tasks add up, a job per level of a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from math import frexp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnaround.operators import forest
from turnaround.operators.forest import DUST, TIE, ForestModel, Layout
from turnaround.sources.storage import delete, drop, materialize

#: So many rows are boosted by one task alone: a job per level would take longer.
ALONE_ROWS = 1 << 22
#: Histograms of more tasks are added up on the way to the driver.
GATHERED = 32
#: Rounds between checkpoints, where a checkpoint folder is set.
KEPT_ROUNDS = 10


class Tree(NamedTuple):
    """Nodes by number: feature (-1 in a leaf), greatest bin that goes left, left child (the right one is
    behind it) and mean of the residuals."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray


class Rows:
    """Rows of a task as packed codes, and the nodes that they have come to."""

    def __init__(self, layout: Layout, columns: np.ndarray):
        self.layout, self.columns = layout, columns

    def begin(self) -> None:
        self.node, self.level = np.zeros(self.columns.shape[1], np.int32), 0

    def walk(self, tree: Tree, level: int) -> None:
        """Down to a level; rows stay at leaves above it."""
        split = tree.feature >= 0
        left = np.where(split, tree.left, np.arange(len(split))).astype(np.int32)
        column = np.where(split, self.layout.column[tree.feature], 0)
        right, codes = np.zeros((len(split), self.layout.most), np.int8), np.arange(self.layout.most)
        for i in np.flatnonzero(split):
            right[i] = self.layout.bin_of(tree.feature[i], codes) > tree.cut[i]
        flat, right, row = self.columns.ravel(), right.ravel(), np.arange(len(self.node))
        while self.level < level:
            code = flat.take((column * len(row)).take(self.node) + row)
            self.node = left.take(self.node) + right.take(self.node * np.int32(self.layout.most) + code)
            self.level += 1


class Drawn(Rows):
    """The rows that a tree sees. What is left of their targets is in whole multiples of a unit, whose sums are
    the same in any order."""

    def __init__(self, layout: Layout, columns: np.ndarray, whole: np.ndarray):
        super().__init__(layout, columns)
        self.whole = whole.astype(np.int32 if np.abs(whole).max(initial=0) < 2**31 else np.int64)

    def sums(self, tree: Tree, level: int, nodes: np.ndarray) -> np.ndarray:
        """Per node and bin the number of rows and the sum of what is left."""
        if not level:
            self.begin()
        self.walk(tree, level)
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        place = place[self.node]
        rows = np.flatnonzero(place >= 0)
        return self.layout.sums(place[rows], len(nodes), self.columns, rows, (None, self.whole[rows]))


class State(Rows):
    """All rows of a task, with their keys and what is left to explain of their targets."""

    def __init__(self, layout: Layout, columns: np.ndarray, key: np.ndarray, residual: np.ndarray):
        super().__init__(layout, columns)
        self.key, self.residual = key, residual

    def drawn(self, s: Settings, number: int) -> Drawn:
        whole = np.rint(self.residual / s.unit)
        self.seen = np.ones(len(self.key), bool) if s.row_share >= 1 else forest.chance(s.seed, number, self.key) < s.row_share
        rows = np.flatnonzero(self.seen)
        return Drawn(self.layout, self.columns.take(rows, 1), whole[rows])

    def after(self, s: Settings, number: int, tree: Tree, drawn: Drawn | None = None) -> State:
        """The same rows once a tree has explained its share; `drawn` has come a long way already."""
        self.begin()
        if drawn is None:
            self.walk(tree, s.depth)
        else:
            others = Rows(self.layout, self.columns.take(np.flatnonzero(~self.seen), 1))
            others.begin()
            for rows, seen in ((drawn, self.seen), (others, ~self.seen)):
                rows.walk(tree, s.depth)
                self.node[seen] = rows.node
        return State(self.layout, self.columns, self.key, self.residual - s.weight(number) * tree.value[self.node])


class Settings(NamedTuple):
    rounds: int
    depth: int
    step: float
    row_share: float
    column_share: float
    seed: int
    unit: float
    floor: float

    def weight(self, number: int) -> float:
        """The first tree counts whole, later ones by the step."""
        return self.step if number else 1.0

    def features(self, number: int, level: int, nodes: int, features: int) -> np.ndarray:
        """Which features each node of a level may use."""
        asked = min(features, int(np.ceil(self.column_share * features)))
        order = np.random.default_rng([self.seed, number, level]).random((nodes, features)).argsort(1)
        return order.argsort(1) < asked


def _best(h: np.ndarray, layout: Layout, allowed: np.ndarray, floor: float) -> tuple:
    """Per node the rows and sum of residuals, and the best split's gain, feature, cut and left share of both."""
    count, total = h[:, :, : layout.bins[0]].sum(2)
    mean = total / np.maximum(count, 1)
    gain, feature, cut = np.zeros(len(count)), np.full(len(count), -1, np.int16), np.zeros(len(count), np.int32)
    lower, at = np.zeros((2, len(count))), np.arange(len(count))
    for f, b in enumerate(layout.bins):
        if b > 1:
            c, s = h[:, :, layout.starts[f] : layout.starts[f + 1] - 1].cumsum(2)
            g = forest._gains(c, s - c * mean[:, None], count[:, None], 1)
            place = (g * TIE >= g.max(1, keepdims=True)).argmax(1)
            g = np.where(allowed[:, f], g[at, place], 0)
            better = g > np.maximum(TIE * gain, floor * count)
            gain, feature, cut = np.where(better, g, gain), np.where(better, f, feature).astype(np.int16), np.where(better, place, cut)
            lower = np.where(better, (c[at, place], s[at, place]), lower)
    return count, total, gain, feature, cut, lower


def grow(ask: Callable[[Tree, int, np.ndarray], np.ndarray], layout: Layout, s: Settings, number: int) -> tuple[Tree, np.ndarray]:
    """A tree and the gain per feature, from histograms that `ask` returns for nodes of a level. Of two
    children only the one of fewer rows is asked for: the other has what is left of their parent."""
    gains = np.zeros(len(layout.bins))
    tree, nodes = Tree(np.array([-1], np.int16), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1)), np.zeros(1, int)
    for level in range(s.depth):
        if level == 0:
            h = ask(tree, 0, nodes)
        count, total, gain, feature, cut, lower = _best(
            h * np.array([1, s.unit])[:, None, None], layout, s.features(number, level, len(nodes), len(layout.bins)), s.floor
        )
        if level == 0:
            tree.value[0] = total[0] / max(count[0], 1)
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        np.add.at(gains, feature[split], gain[split])
        children = len(tree.feature) + 2 * np.arange(len(split))
        tree.feature[nodes[split]], tree.cut[nodes[split]], tree.left[nodes[split]] = feature[split], cut[split], children
        sizes = np.stack([lower[0, split], count[split] - lower[0, split]], 1)
        means = np.stack([lower[1, split], total[split] - lower[1, split]], 1) / sizes
        new = 2 * len(split)
        tree = Tree(
            np.append(tree.feature, np.full(new, -1, np.int16)), np.append(tree.cut, np.zeros(new, np.int32)),
            np.append(tree.left, np.zeros(new, np.int32)), np.append(tree.value, means.ravel()),
        )
        if level + 1 < s.depth:
            fewer = (sizes[:, 1] < sizes[:, 0]).astype(int)
            few = ask(tree, level + 1, children + fewer)
            many = h[:, split] - few
            h = np.stack([np.where(fewer[:, None], many, few), np.where(fewer[:, None], few, many)], 2).reshape(2, new, -1)
            nodes = (children[:, None] + np.arange(2)).ravel()
    return tree, gains


def _states(layout: Layout, cuts: list[list[float]]) -> Callable[[Iterator], Iterator[State]]:
    """Blocks of a task as one `State`."""

    def packed(blocks: Iterator) -> Iterator[State]:
        key, y, columns = [], [], []
        kind = forest._code_type(cuts)
        for b in blocks:
            key.append(np.frombuffer(b.key, np.int64))
            y.append(np.frombuffer(b.y))
            columns.append(layout.pack(np.frombuffer(b.codes, kind).reshape(len(cuts), b.n)))
        if key:
            yield State(layout, np.concatenate(columns, axis=1), np.concatenate(key), np.concatenate(y))

    return packed


def boost_here(state: State, s: Settings) -> Iterator[tuple[Tree, np.ndarray]]:
    """All rounds over rows that are at hand."""
    for number in range(s.rounds):
        drawn = state.drawn(s, number)
        tree, gains = grow(drawn.sums, state.layout, s, number)
        state = state.after(s, number, tree, drawn)
        yield tree, gains


def boost_apart(states: RDD, layout: Layout, s: Settings) -> Iterator[tuple[Tree, np.ndarray]]:
    """The same over rows of many tasks: their state is stored each round, and a job adds up a level's histograms."""

    def stored(rdd: RDD) -> RDD:
        return rdd.persist(StorageLevel.MEMORY_AND_DISK)

    def advanced(before: RDD, number: int, tree: Tree) -> RDD:
        return stored(before.map(lambda state: state.after(s, number, tree)))

    def asked(drawn: RDD) -> Callable:
        def sums(tree: Tree, level: int, nodes: np.ndarray) -> np.ndarray:
            found = drawn.map(lambda rows: rows.begin() or rows.sums(tree, level, nodes))
            return found.treeReduce(np.add) if found.getNumPartitions() > GATHERED else reduce(np.add, found.collect())

        return sums

    now, folder, files = stored(states), states.context.getCheckpointDir(), []
    for number in range(s.rounds):
        if folder and number % KEPT_ROUNDS == KEPT_ROUNDS - 1:
            now.checkpoint()
        drawn = stored(now.map(partial(State.drawn, s=s, number=number)))
        tree, gains = grow(asked(drawn), layout, s, number)
        drawn.unpersist()
        if number:
            before.unpersist()
        if now.getCheckpointFile() and now.getCheckpointFile() not in files:
            files.append(now.getCheckpointFile())
            for path in files[:-1]:
                delete(states.context, path)
            files = files[-1:]
        before, now = now, advanced(now, number, tree)
        yield tree, gains
    before.unpersist()
    for path in files:
        delete(states.context, path)


class Boosted(Estimator, HasLabelCol, HasFeaturesCol, HasPredictionCol, HasSeed):
    """Sum of regression trees, each fitted to what those before it leave of the target and counted by
    `stepSize`; the first counts whole. A tree sees each row with the chance `subsamplingRate`, a node the part
    `featureShare` of the features; splits are by variance between bins, down to `maxDepth`.

    A level's histograms are held at once, so trees are meant to be shallow. `keyCol` names rows for the draws;
    without such a column they are numbered as they are read."""

    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth of a leaf", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "weight of the trees after the first", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "chance of a row to be drawn in a round", TypeConverters.toFloat)
    featureShare = Param(Params._dummy(), "featureShare", "part of the features that a node may use", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "most bins per feature", TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "column that names rows", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol="label", maxIter=300, maxDepth=7, stepSize=0.05, subsamplingRate=0.8, featureShare=0.8, maxBins=256, keyCol="unique_key", seed=42):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(
            labelCol="label", maxIter=300, maxDepth=7, stepSize=0.05, subsamplingRate=0.8, featureShare=0.8, maxBins=256, keyCol="unique_key", seed=42
        )

    def _fit(self, dataset: DataFrame) -> ForestModel:
        spark = dataset.sparkSession
        forest._prepare(spark)
        rows = forest.named_rows(dataset, self.getOrDefault(self.keyCol), self.getLabelCol(), self.getFeaturesCol())
        cuts = forest.find_cuts(rows, self.getOrDefault(self.maxBins))
        blocks = materialize(forest.pack(rows, cuts), "boosted-rows")
        n, size = blocks.agg(F.sum("n"), F.max("size")).first()
        if not n:
            raise ValueError("no rows to fit")
        layout = Layout([len(c) + 1 for c in cuts])
        rounds, depth, step, row_share, column_share = (
            self.getOrDefault(p) for p in (self.maxIter, self.maxDepth, self.stepSize, self.subsamplingRate, self.featureShare)
        )
        # Residuals stay below four times the greatest target: whole numbers of 30 bits, their sums of 53.
        unit = 2.0 ** (frexp(size)[1] + 2 - min(30, 53 - int(n).bit_length()))
        s = Settings(rounds, depth, step, row_share, column_share, self.getSeed(), unit, DUST * size**2)
        packed = blocks.select("n", "key", "y", "codes")
        if n <= ALONE_ROWS:
            states = packed.coalesce(1).rdd.mapPartitions(_states(layout, cuts))
            made = states.flatMap(lambda state: boost_here(state, s)).collect()
        else:
            made = list(boost_apart(packed.rdd.mapPartitions(_states(layout, cuts)), layout, s))
        drop(blocks)
        return self._copyValues(_model(spark, made, cuts, s))


def _model(spark, made: list[tuple[Tree, np.ndarray]], cuts: list[list[float]], s: Settings) -> ForestModel:
    """A forest's model is the mean of its trees: values are multiplied by weight and number of trees."""
    gains = np.sum([g for _, g in made], axis=0)
    values = [t.value * s.weight(i) * len(made) for i, (t, _) in enumerate(made)]
    kinds = [("feature", pa.int16()), ("cut", pa.int32()), ("left", pa.int32())]
    table = pa.table(
        {"tree": pa.array(range(len(made)), pa.int32()), "root": pa.array([0] * len(made), pa.int32())}
        | {name: pa.array([getattr(t, name) for t, _ in made], pa.list_(kind)) for name, kind in kinds}
        | {"value": pa.array(values, pa.list_(pa.float64())), "importance": pa.array([g for _, g in made], pa.list_(pa.float64()))}
    )
    parts = materialize(spark.createDataFrame(table), "boosted-trees")
    shares = gains / gains.sum() if gains.sum() else gains
    return ForestModel(parts, cuts, [[[-1], [0], [0]] for _ in made], float(max(np.abs(v).max() for v in values)), [float(v) for v in shares])
