import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.operators import analysis, evaluation, modelling, reshape
from turnaround.operators.encoding import apply_encoding, fit_encoding
from turnaround.plans import batch, catalog


@pytest.fixture(scope="module")
def planted(spark):
    """Requests whose log hours follow the problem type and the hour, plus noise."""
    rng = np.random.default_rng(7)
    rows = []
    for key in range(3000):
        kind, hour, weekend = int(rng.integers(0, 12)), int(rng.integers(0, 24)), int(rng.integers(0, 2))
        y = 1.0 + 0.3 * kind + (0.8 if hour >= 18 else 0.0) + 0.4 * weekend + float(rng.normal(0, 0.2))
        rows.append((key, float(np.expm1(y)), y, hour, weekend, f"type {kind}", "street"))
    layout = "unique_key long, resolution_hours double, log_resolution_hours double, hour_of_day int, is_weekend int, problem_type string, location_type string"
    return modelling.model_inputs(spark.createDataFrame(rows, layout).coalesce(1))


@pytest.fixture(scope="module")
def small(spark):
    return {
        modelling.LINEAR: modelling.linear(),
        modelling.FOREST: modelling.forest(trees=8, depth=7, bins=32),
        modelling.BOOSTED: modelling.boosted(rounds=8, depth=4, step=0.4, bins=32),
    }


def test_least_squares_equals_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.5, -2.0, 0.25]) + 0.7 + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], f"a double, b double, c double, {schema.TARGET} double")
    fitted = modelling.fit(modelling.linear(), df, ["a", "b", "c"]).stages[-1]
    expected = np.linalg.lstsq(np.column_stack([x, np.ones(200)]), y, rcond=None)[0]
    assert np.allclose([*fitted.coefficients, fitted.intercept], expected, atol=1e-6)


def test_models_beat_the_baseline(spark, planted, small, tmp_path):
    train, validation, encoding = modelling.prepared_split(planted, ["train"], ["validation"])
    features = modelling.feature_columns(train)
    assert features == ["hour_of_day", "is_weekend", "problem_type_encoded", "location_type_encoded"]
    base = evaluation.regression_metrics(modelling.baseline().transform(validation)).first().r2
    for name in (modelling.FOREST, modelling.BOOSTED):
        model, tidy = modelling.fit_and_score(name, small[name], train, validation, features, "validation")
        scores = {r.metric: r.value for r in tidy.collect()}
        assert scores["r2"] > base + 0.02 and scores["r2"] > 0.85
        assert set(scores) == set(evaluation.METRICS)
    importance = modelling.feature_importance(spark, model, features).collect()
    assert importance[0].feature == "problem_type_encoded"
    assert sum(r.importance for r in importance) == pytest.approx(1.0)
    modelling.save_model(str(tmp_path), model, features, encoding)
    loaded, names, table = modelling.load_model(spark, str(tmp_path))
    assert names == features and table.count() == encoding.count()
    first, second = (
        {r.unique_key: r.prediction for r in m.transform(validation).select("unique_key", "prediction").collect()} for m in (model, loaded)
    )
    assert first == second


def test_shuffled_encoding_loses_to_the_baseline(spark, planted, small):
    train, validation, _ = modelling.prepared_split(planted, ["train"], ["validation"])
    base = evaluation.regression_metrics(modelling.baseline().transform(validation)).first().r2
    order = Window.orderBy(F.md5(F.col("unique_key").cast("string")))
    place = train.withColumn("at", F.row_number().over(Window.orderBy("unique_key")))
    moved = train.select(F.row_number().over(order).alias("at"), F.col("problem_type_encoded").alias("other"))
    shuffled = place.join(moved, "at").withColumn("problem_type_encoded", F.col("other")).drop("at", "other")
    tidy = modelling.fit_and_score("forest", small[modelling.FOREST], shuffled, validation, modelling.feature_columns(train), "validation")[1]
    assert {r.metric: r.value for r in tidy.collect()}["r2"] < base


def test_same_seed_same_forest(spark, planted, small):
    train, validation, _ = modelling.prepared_split(planted, ["train"], ["validation"])
    ordered = train.coalesce(1).sortWithinPartitions("unique_key")
    features = modelling.feature_columns(train)
    scores = [
        evaluation.regression_metrics(modelling.fit(small[modelling.FOREST], ordered, features).transform(validation)).first().r2
        for _ in range(2)
    ]
    assert scores[0] == scores[1]


def test_train_job(spark, planted, small, tmp_path):
    wide = planted.withColumn("resolution_hours", F.expm1(schema.TARGET))
    result = batch.train(wide, str(tmp_path), small)
    stages = {(r.stage, r.model) for r in result["metrics"].collect()}
    assert len([s for s in stages if s[0] == "validation"]) == 3
    assert ("test", result["best"]) in stages
    stored = evaluation.read_metrics(spark, f"{tmp_path}/model_metrics")
    assert {r.stage for r in stored.collect()} == {"validation", "test"}
    before = stored.count()
    merged = batch.train_small(wide, str(tmp_path), modelling.small_forest(trees=5, depth=6, min_leaf=20))
    assert evaluation.error_band(merged) > 0
    first = {(r.stage, r.model, r.metric): r.value for r in merged.collect()}
    written = evaluation.read_metrics(spark, f"{tmp_path}/model_metrics")
    assert {r.stage for r in written.collect()} == {"validation", "test", "deployed"} and written.count() == before + 2
    # Columns in another order, and one the saved model does not know, change nothing.
    moved = wide.select(*reversed(wide.columns), F.lit(1).alias("unknown_feature"))
    again = batch.train_small(moved, str(tmp_path), modelling.small_forest(trees=5, depth=6, min_leaf=20))
    assert modelling.load_model(spark, f"{tmp_path}/deployed_model")[1] == result["features"]
    assert {(r.stage, r.model, r.metric): pytest.approx(r.value, rel=1e-9) for r in again.collect()} == first
    document = spark.read.json(f"{tmp_path}/model_metrics", multiLine=True).first()
    assert document.rows == wide.count() and document.best_model == result["best"]
    predictions = spark.read.parquet(f"{tmp_path}/request_predictions")
    assert [(f.name, f.dataType) for f in predictions.schema] == [(f.name, f.dataType) for f in schema.PREDICTION_SCHEMA]
    low = predictions.agg(F.max(F.abs(F.col("error_hours") - F.col("predicted_hours") + F.col("actual_hours")))).first()[0]
    assert low == 0


def test_metrics_equal_definition(spark):
    y, p = [0.5, 1.0, 2.0, 4.0], [0.6, 0.8, 2.5, 3.0]
    df = spark.createDataFrame(list(zip(y, p)), f"{schema.TARGET} double, prediction double")
    found = evaluation.regression_metrics(df).first()
    y, p = np.array(y), np.array(p)
    assert found.r2 == pytest.approx(1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert found.mae_hours == pytest.approx(np.abs(np.expm1(p) - np.expm1(y)).mean())
    assert found.rmse_log == pytest.approx(np.sqrt(((p - y) ** 2).mean()))


def test_linear_model_has_no_importance(spark, planted):
    train, _, _ = modelling.prepared_split(planted, ["train"], ["test"])
    features = modelling.feature_columns(train)
    model = modelling.fit(modelling.linear(), train, features)
    assert modelling.feature_importance(spark, model, features).count() == 0


def test_feature_names_may_hold_dots(spark, planted):
    dotted = planted.withColumnRenamed("is_weekend", "agency_U.S. Mail")
    result = modelling.final_test(dotted, "forest", modelling.forest(trees=2, depth=4, bins=32))
    importance = modelling.feature_importance(spark, result["model"], result["features"])
    assert importance.where("feature = 'agency_U.S. Mail' and importance > 0").count() == 1


def test_candidates_share_one_encoded_split(spark, sf_dir, monkeypatch):
    made, prepare = [], modelling.prepared_split

    def counted(*args):
        made.append(args)
        return prepare(*args)

    monkeypatch.setattr(modelling, "prepared_split", counted)
    monkeypatch.setattr(catalog, "_made", {})
    monkeypatch.setattr(catalog, "candidates", lambda: {n: modelling.linear() for n in (modelling.LINEAR, "again")})
    tidy, ranked = catalog._comparison(spark, sf_dir)
    assert len(made) == 1 and ranked.count() == 2
    first, second = ({r.metric: r.value for r in tidy.where(F.col("model") == n).collect()} for n in (modelling.LINEAR, "again"))
    assert first == second


def test_segment_must_exist(spark, sf_dir):
    clean = catalog.clean(spark, sf_dir)
    with pytest.raises(ValueError):
        analysis.error_by_segment(clean, clean, "no_such_column")


def test_histogram_edges(spark):
    errors = [(-900.0,), (-200.0,), (-195.0,), (0.0,), (199.9,), (200.0,), (5000.0,), (None,)]
    df = spark.createDataFrame(errors, "error_hours double")
    found = {r.bin: (r.from_hours, r.predictions) for r in reshape.error_histogram(df).collect()}
    assert found == {0: (-200.0, 2), 1: (-195.0, 1), 40: (0.0, 1), 79: (195.0, 3)}
    assert reshape.error_clip_mean(df).first().predictions == 7


def test_pivot_has_every_day_and_hour(spark):
    df = spark.createDataFrame([(3, 0, 5.0), (3, 2, 7.0)], "hour int, dow int, median_hours double")
    rows = reshape.pivot_hour_day(df).collect()
    assert [r.dow_label for r in rows] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert len(rows[0]) == 25 and rows[6]["3"] == 5.0 and rows[1]["3"] == 7.0 and rows[0]["3"] is None


def test_stored_encoding_is_reused(spark, planted):
    table = fit_encoding(planted).cache()
    assert apply_encoding(planted, table).count() == planted.count()
