"""Boosted trees against Spark's where nothing is drawn by chance, and alike however rows are dealt."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from turnaround import schema
from turnaround.operators import boosting, forest, modelling
from turnaround.plans import catalog

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, n, 1500) for n in (24, 7, 2, 2, 60)], 1)
    y = x[:, 0] % 5 + 2.0 * (x[:, 1] > 4) + x[:, 2] * x[:, 3] + np.sin(x[:, 4]) + rng.normal(0, 0.1, 1500)
    table = [(i, float(t), *map(int, r)) for i, (t, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(table, f"unique_key long, {schema.TARGET} double, {', '.join(f'{n} int' for n in NAMES)}").repartition(6).cache()


def predictions(model, rows):
    return {r.unique_key: r.prediction for r in model.transform(rows).select("unique_key", "prediction").collect()}


def test_registered_candidates_run_whole(spark):
    boosted = catalog.candidates()[modelling.BOOSTED]
    found = {p: boosted.getOrDefault(p) for p in ("maxIter", "maxDepth", "stepSize", "maxBins", "subsamplingRate", "featureShare")}
    assert found == {"maxIter": 300, "maxDepth": 7, "stepSize": 0.05, "maxBins": 256, "subsamplingRate": 0.8, "featureShare": 0.8}
    grown = catalog.candidates()[modelling.FOREST]
    assert (grown.getOrDefault("numTrees"), grown.getOrDefault("maxDepth")) == (200, 20)


def test_trees_are_those_of_spark(spark, rows):
    """Spark's trees fit twice the residual, so half the step gives the same sums."""
    ours = modelling.fit(modelling.boosted(rounds=6, depth=4, step=0.4, row_share=1, column_share=1), rows, NAMES)
    spark_s = GBTRegressor(labelCol=schema.TARGET, maxIter=6, maxDepth=4, stepSize=0.2, maxBins=256)
    theirs = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), spark_s]).fit(rows)
    assert predictions(ours, rows) == pytest.approx(predictions(theirs, rows), abs=1e-6)
    mine, other = (m.stages[-1].featureImportances.toArray() for m in (ours, theirs))
    assert mine.sum() == pytest.approx(1) and np.argmax(mine) == np.argmax(other)


@pytest.mark.parametrize("gathered", [1, 32])
def test_rows_of_many_tasks_are_boosted_alike(spark, rows, monkeypatch, tmp_path, gathered):
    alone = predictions(modelling.fit(modelling.boosted(rounds=14, depth=5), rows, NAMES), rows)
    monkeypatch.setattr(boosting, "ALONE_ROWS", 100)
    monkeypatch.setattr(boosting, "GATHERED", gathered)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 4)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 60)
    assert predictions(modelling.fit(modelling.boosted(rounds=14, depth=5), rows, NAMES), rows) == alone


def test_more_rounds_explain_more(spark, rows):
    def left(rounds):
        found = predictions(modelling.fit(modelling.boosted(rounds=rounds, depth=3), rows, NAMES), rows)
        return sum((found[r.unique_key] - r[schema.TARGET]) ** 2 for r in rows.collect())

    first, last = left(1), left(80)
    assert last < first / 2


def test_histograms_of_shared_columns_are_those_of_features():
    rng, bins = np.random.default_rng(2), [24, 2, 7, 1, 2, 200, 300, 2, 2]
    codes = np.stack([rng.integers(0, b, 500).astype(np.uint16) for b in bins])
    layout, place, values = forest.Layout(bins), rng.integers(0, 3, 500), rng.integers(-9, 9, 500)
    assert len(layout.sizes) < len(bins) and (layout.unpack(layout.pack(codes).tobytes(), 500) == codes).all()
    count, total = layout.sums(place, 3, layout.pack(codes), np.arange(500), (None, values))
    for f, b in enumerate(bins):
        for k, found in ((np.ones(500), count), (values, total)):
            expected = np.zeros((3, b))
            np.add.at(expected, (place, codes[f]), k)
            assert (found[:, layout.starts[f] : layout.starts[f + 1]] == expected).all()
