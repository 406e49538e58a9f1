import numpy as np
import pytest
from pyspark.sql import functions as F

from turnaround.operators import quantiles
from turnaround.operators.features import column_medians, impute_median
from turnaround.operators.quantiles import POWER_CELLS, count_values, exact_quantiles, medians, time_summary

FRACTIONS = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "high": 1.0}


def frame(spark, seed, rows=3000):
    rng = np.random.default_rng(seed)
    # One group holds a third of the rows; keys and values may be null; values repeat and go below 0.
    group = np.where(rng.random(rows) < 0.34, "hot", rng.choice(["a", "b", "c", "one"], rows, p=[0.5, 0.3, 0.199, 0.001]))
    value = np.where(rng.random(rows) < 0.3, np.round(rng.normal(0, 5, rows), 1), rng.normal(0, 1, rows) * 10.0 ** rng.integers(-3, 4, rows))
    data = [
        (None if rng.random() < 0.1 else str(g), None if rng.random() < 0.05 else float(v))
        for g, v in zip(group, value)
    ]
    return data, spark.createDataFrame(data, "g string, v double").repartition(5)


@pytest.mark.parametrize("cells", [(0.01,), (1.0,), (100.0, 1.0, 0.01), (1e9,), POWER_CELLS])
def test_equals_numpy(spark, cells):
    data, df = frame(spark, 1)
    found = {r.g: r for r in exact_quantiles(df, ["g"], ["v"], FRACTIONS, cells).collect()}
    groups = {g for g, v in data if v is not None}
    assert set(found) == groups
    for g in groups:
        values = [v for k, v in data if k == g and v is not None]
        assert found[g].rows == len(values)
        for name, q in FRACTIONS.items():
            assert found[g][name] == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_two_measures_and_no_keys(spark):
    data, df = frame(spark, 2)
    both = df.withColumn("w", F.col("v") * -2)
    found = {r.measure: r for r in exact_quantiles(both, [], ["v", "w"], {"m": 0.5}).collect()}
    values = [v for _, v in data if v is not None]
    assert found["v"].m == pytest.approx(np.median(values))
    assert found["w"].m == pytest.approx(np.median([-2 * v for v in values]))


def test_outliers_do_not_gather_the_rest_in_one_cell(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = [float(x) for x in rng.random(20001)] + [1e15, -1e15, 1e308, -1e308, 5e-324, 0.0, -0.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    left, narrow = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: left.append(narrow(*a)) or left[-1])
    found = exact_quantiles(df, [], ["v"], {"m": 0.5}, POWER_CELLS).first()
    assert found.m == np.median(values)
    # What the last window puts in order: a handful of values.
    assert left[-1].count() < 5


def test_powers_keep_order_and_every_scale(spark):
    rng = np.random.default_rng(4)
    values = [float(s * x) for s in (1, -1) for x in 10.0 ** rng.uniform(-300, 300, 500)] + [2.0**e for e in range(-1074, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = exact_quantiles(df, [], ["v"], FRACTIONS, POWER_CELLS).first()
    ordered = sorted(values)
    assert (found.low, found.high) == (ordered[0], ordered[-1])
    assert found.mid == pytest.approx(np.median(values))


def test_counted_values_give_the_same(spark):
    data, df = frame(spark, 5)
    counted = count_values(df, ["g"], "v", extra=F.max("v"))
    plain = {r.g: (r.median, r.rows) for r in medians(df, ["g"], "v").collect()}
    assert {r.g: (r.median, r.rows) for r in medians(counted, ["g"], "v", weight="n").collect()} == plain
    assert counted.agg(F.sum("n")).first()[0] == len(data)


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 3.0), ("a", 1.0)], "g string, v double")
    assert [(r.median, r.rows) for r in medians(df, ["g"], "v").collect()] == [(2.0, 2)]


def test_empty_input_gives_no_group(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert medians(df, ["g"], "v").count() == 0


def test_time_summary_keeps_null_group(spark):
    df = spark.createDataFrame(
        [(None, "1.00"), (None, "2.00"), ("a", "0.05"), ("a", "0.10"), ("b", None)], "g string, h string"
    ).withColumn("h", F.col("h").cast("decimal(10,2)"))
    found = {r.g: r for r in time_summary(df, ["g"], "h").collect()}
    assert (found[None].complaints, found[None].median_hours, found[None].avg_hours) == (2, 1.5, 1.5)
    assert (found["a"].median_hours, found["a"].max_hours) == (0.1, 0.1)
    assert (found["b"].complaints, found["b"].median_hours) == (1, None)


def test_column_medians_and_impute(spark):
    df = spark.createDataFrame(
        [(1, 5, None, 7.0), (2, None, None, 7.0), (3, 8, 1e12, 7.0), (4, 6, -1e-9, 7.0)], "k int, `a.b` int, c double, d double"
    )
    assert column_medians(df, ["a.b", "c", "d"]) == {"a.b": 6.0, "c": pytest.approx((1e12 - 1e-9) / 2), "d": 7.0}
    filled = {r.k: r for r in impute_median(df, ["a.b", "d"]).collect()}
    assert filled[2]["a.b"] == 6.0 and filled[1]["a.b"] == 5.0
    assert column_medians(df.where("k < 3"), ["c"]) == {}
