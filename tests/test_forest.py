import uuid

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.operators import forest, modelling


def table(spark, rows, seed=3, distinct=(24, 2, 130, 1), parts=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, d, rows) / 7 for d in distinct])
    y = np.sin(x[:, 0]) + x[:, 1 % x.shape[1]] * x[:, 2 % x.shape[1]] / 20 + rng.normal(0, 0.3, rows)
    names = [f"f{i}" for i in range(len(distinct))]
    layout = ", ".join(["unique_key long", f"{schema.TARGET} double", *[f"{n} double" for n in names]])
    data = [(k, float(t), *map(float, r)) for k, (t, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, layout).repartition(parts), names


def predictions(model, df):
    return {r.unique_key: r.prediction for r in model.transform(df).select("unique_key", "prediction").collect()}


def test_a_fit_takes_fewer_jobs_than_levels(spark):
    """A forest that gathers histograms for every node takes a job or more per level."""
    df, names = table(spark, 3000)
    df = df.cache()
    df.count()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "fit")
    try:
        modelling.fit(modelling.forest(), df, names)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert 0 < len(jobs) < 20


@pytest.mark.parametrize("depth, least", [(20, 5), (4, 1), (0, 1)])
def test_a_tree_is_that_of_spark(spark, depth, least):
    df, names = table(spark, 2000)
    ours = modelling.fit(modelling.forest(trees=1, depth=depth, min_leaf=least, bootstrap=False), df, names)
    theirs = modelling.fit(
        RandomForestRegressor(
            labelCol=schema.TARGET, numTrees=1, maxDepth=depth, minInstancesPerNode=least, maxBins=256,
            featureSubsetStrategy="all", bootstrap=False,
        ), df, names,
    )
    assert predictions(ours, df) == pytest.approx(predictions(theirs, df), abs=1e-9)
    ours, theirs = (m.stages[-1].featureImportances.toArray() for m in (ours, theirs))
    assert np.allclose(ours, theirs, atol=1e-9)


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_large_nodes_are_split_like_small_ones(spark, monkeypatch, held):
    df, names = table(spark, 3000)
    whole = modelling.fit(modelling.forest(trees=6, depth=9), df, names)
    monkeypatch.setattr(forest, "GROWN_ROWS", 40)
    monkeypatch.setattr(forest, "HELD_BYTES", held)
    monkeypatch.setattr(forest, "ROUND_BYTES", 150_000)
    split = modelling.fit(modelling.forest(trees=6, depth=9), df, names)
    assert all(len(top[0]) > 50 for top in split.stages[-1].tops)
    assert predictions(split, df) == pytest.approx(predictions(whole, df), abs=1e-12)
    assert np.allclose(split.stages[-1].importances, whole.stages[-1].importances, atol=1e-12)


def test_a_large_node_that_cannot_be_split_sends_no_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "GROWN_ROWS", 40)
    df = spark.range(500).select(F.col("id").alias("unique_key"), (F.col("id") % 2).cast("double").alias("f"), F.lit(2.5).alias("one"))
    df = df.withColumn(schema.TARGET, F.col("f") * 3 + 1)
    model = modelling.fit(modelling.forest(trees=3, bootstrap=False), df, ["one", "f"])
    assert model.stages[-1].tops[0][0] == [1, -1, -1]
    assert {r.prediction for r in model.transform(df).collect()} == {1.0, 4.0}
    assert model.stages[-1].importances == [0.0, 1.0]


def test_draws_depend_on_keys_alone(spark):
    df, names = table(spark, 1500, parts=1)
    first = predictions(modelling.fit(modelling.forest(trees=5, depth=8), df, names), df)
    other = df.repartition(7, "f0")
    assert predictions(modelling.fit(modelling.forest(trees=5, depth=8), other, names), other) == pytest.approx(first, abs=1e-9)
    assert predictions(modelling.fit(modelling.forest(trees=5, depth=8, seed=1), df, names), df) != pytest.approx(first, abs=1e-3)


def test_draws_are_poisson():
    drawn = np.stack([forest.draws(42, t, np.arange(100_000)) for t in range(3)])
    assert np.allclose([np.mean(drawn == k) for k in range(3)], [np.exp(-1), np.exp(-1), np.exp(-1) / 2], atol=0.003)
    assert np.abs(np.corrcoef(drawn) - np.eye(3)).max() < 0.02


def test_both_ways_to_find_the_best_cut():
    rng = np.random.default_rng(5)
    at = np.sort(np.concatenate([np.arange(40), rng.integers(0, 40, 900)]))
    code = at * 30 + rng.integers(0, 30, len(at))
    w, y = rng.integers(1, 4, len(at)).astype(float), rng.normal(size=len(at))
    count = np.bincount(at, w)
    e = w * (y - (np.bincount(at, w * y) / count)[at])
    c, s = (np.bincount(code, v, 1200).reshape(40, 30) for v in (w, e))
    (g1, c1), (g2, c2) = forest._best_dense(c, s, count, None, 3), forest._best_sorted(code, 30, w, e, count, 3)
    assert np.allclose(g1, g2) and (g1 > 0).sum() > 30
    # Empty bins behind a cut leave it where it is: the same rows go left.
    left = [[set(np.flatnonzero((at == i) & (code % 30 <= c[i]))) for i in range(40) if g1[i] > 0] for c in (c1, c2)]
    assert left[0] == left[1]


@pytest.mark.parametrize("bins, distinct", [(16, 900), (1000, 900), (256, 256), (256, 257)])
def test_bins(spark, bins, distinct):
    df, _ = table(spark, 4000, distinct=(distinct,))
    rows = df.select(F.array("f0").alias("x"))
    (cuts,) = forest.find_cuts(rows, bins)
    values = np.unique([r.x[0] for r in rows.collect()])
    if len(values) <= bins:
        assert np.allclose(cuts, (values[1:] + values[:-1]) / 2)
    else:
        assert len(cuts) < bins
        shares = np.bincount(forest.encode(np.array([r.x for r in rows.collect()]), [cuts])[0])
        assert shares.max() < 2 * 4000 / bins + 2 * 4000 / distinct
    model = modelling.fit(modelling.forest(trees=2, depth=12, bins=bins), df, ["f0"])
    assert len(predictions(model, df)) == 4000


def test_saved_models_and_streams_answer_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "GROWN_ROWS", 300)
    df, names = table(spark, 2000)
    df = df.withColumnRenamed("f1", "f.1").withColumn("_row", F.lit("own"))
    names[1] = "f.1"
    model = modelling.fit(modelling.forest(trees=9, depth=20), df, names)
    scored = model.transform(df)
    assert scored.columns[: len(df.columns)] == df.columns and {r._row for r in scored.collect()} == {"own"}
    expected = predictions(model, df)
    model.write().overwrite().save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    assert predictions(loaded, df) == expected
    assert loaded.stages[-1].getNumTrees() == 9 and loaded.stages[-1].importances == model.stages[-1].importances
    df.write.parquet(f"{tmp_path}/rows")
    answers = loaded.transform(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/rows"))
    query = answers.select("unique_key", "prediction").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {r.unique_key: r.prediction for r in spark.read.parquet(f"{tmp_path}/out").collect()} == expected
    assert model.transform(df.limit(0)).count() == 0
    # Equal rows are answered one by one.
    assert model.transform(df.unionByName(df)).count() == 4000
