from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.operators import encoding, features
from turnaround.operators.modelling import align, feature_columns, model_inputs
from turnaround.plans import catalog


@pytest.fixture(scope="module")
def train(spark, sf_dir):
    return catalog.encoder_rows(spark, sf_dir).drop("split").cache()


def by_key(df, column="problem_type_encoded"):
    return {r.unique_key: r[column] for r in df.select("unique_key", column).collect()}


def test_encoding_equals_definition(train):
    rows = train.collect()
    mean = sum(r[schema.TARGET] for r in rows) / len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r.problem_type].append(r[schema.TARGET])
    found = encoding.fit_encoding(train).where(F.col("column") == "problem_type").collect()
    assert len(found) == len(groups)
    for r in found:
        values = groups[r.category]
        assert r.encoding == pytest.approx((sum(values) + 20 * mean) / (len(values) + 20))
    assert encoding.global_mean(encoding.fit_encoding(train)) == pytest.approx(mean)


def test_own_fold_never_leaks(train):
    before = by_key(encoding.encode_out_of_fold(train))
    target = sorted(before)[10]
    place = train.where(F.col("unique_key") == target).select(encoding.fold(F.col("unique_key")).alias("f")).first().f
    changed = train.withColumn(
        schema.TARGET, F.when(F.col("unique_key") == target, 1000.0).otherwise(F.col(schema.TARGET))
    )
    after = by_key(encoding.encode_out_of_fold(changed))
    same_fold = {r.unique_key for r in train.where(encoding.fold(F.col("unique_key")) == place).collect()}
    assert target in same_fold
    assert all(after[k] == pytest.approx(before[k]) for k in same_fold)
    assert any(after[k] != pytest.approx(before[k]) for k in before)


def test_category_in_one_fold_only_gets_the_others_mean(spark):
    rows = [(i, f"c{i % 2}", "x", float(i)) for i in range(40)] + [(1000, "rare", "x", 99.0)]
    df = spark.createDataFrame(rows, "unique_key long, problem_type string, location_type string, log_resolution_hours double")
    folds = {r.unique_key: r.f for r in df.select("unique_key", encoding.fold(F.col("unique_key")).alias("f")).collect()}
    others = [v for k, _, _, v in rows if folds[k] != folds[1000]]
    assert by_key(encoding.encode_out_of_fold(df))[1000] == pytest.approx(sum(others) / len(others))


def test_unseen_and_null_categories_get_the_global_mean(spark, train):
    table = encoding.fit_encoding(train).cache()
    rows = spark.createDataFrame([(1, "never seen", None)], "unique_key long, problem_type string, location_type string")
    found = encoding.apply_encoding(rows, table).first()
    assert found.problem_type_encoded == found.location_type_encoded == pytest.approx(encoding.global_mean(table))
    assert "problem_type" not in found.asDict()


def test_split_and_folds(spark):
    keys = spark.range(20000).withColumnRenamed("id", "unique_key")
    sizes = {r.split: r.rows for r in encoding.split_sizes(keys).collect()}
    assert sum(sizes.values()) == 20000
    assert abs(sizes["train"] - 12000) < 300 and abs(sizes["validation"] - 4000) < 250 and abs(sizes["test"] - 4000) < 250
    again = {r.split: r.rows for r in encoding.split_sizes(keys.repartition(13)).collect()}
    assert again == sizes
    # Folds are spread evenly within a split: the two hashes are salted apart.
    inside = encoding.with_split(keys).where("split = 'train'").groupBy(encoding.fold(F.col("unique_key"))).count().collect()
    assert len(inside) == 5 and all(abs(r["count"] - sizes["train"] / 5) < 200 for r in inside)


def test_encode_split_imputes_from_training_rows_only(spark):
    rows = [(i, "a", "x", float(i % 7), None if i % 4 == 0 else float(i)) for i in range(60)]
    layout = "unique_key long, problem_type string, location_type string, log_resolution_hours double, load double"
    train = spark.createDataFrame(rows, layout)
    evaluation = spark.createDataFrame([(100, "a", "x", 1.0, None), (101, "zzz", "x", 1.0, 5000.0)], layout)
    encoded_train, encoded_eval, _ = encoding.encode_split(train, evaluation)
    known = sorted(r[4] for r in rows if r[4] is not None)
    middle = (known[len(known) // 2 - 1] + known[len(known) // 2]) / 2 if len(known) % 2 == 0 else known[len(known) // 2]
    assert by_key(encoded_eval, "load") == {100: middle, 101: 5000.0}
    assert by_key(encoded_train, "load")[0] == middle


def test_one_hot(spark):
    df = spark.createDataFrame(
        [("A", None, "x y", "long name"), ("B", "Q", None, "n")], "agency string, borough string, open_data_channel_type string, agency_name string"
    )
    categories = features.fit_categories(df)
    assert [features.one_hot_name(*c) for c in categories] == ["agency_A", "agency_B", "borough_Q", "channel_x y"]
    rows = [r.asDict() for r in features.one_hot(df, categories).collect()]
    assert rows[0] == {"agency_name": "long name", "agency_A": 1, "agency_B": 0, "borough_Q": 0, "channel_x y": 1}
    fitted = features.sparse_categories(df)
    vectors = [r.categories.toArray().tolist() for r in fitted.transform(df).collect()]
    assert vectors == [[1, 0, 0, 1], [0, 1, 1, 0]]
    unseen = df.selectExpr("'C' AS agency", "borough", "open_data_channel_type")
    assert fitted.transform(unseen).first().categories.toArray().tolist() == [0, 0, 0, 1]


def test_names_made_from_data_may_hold_dots(spark, train):
    dotted = train.withColumn("agency_U.S. Mail", F.lit(1))
    encoded, _, _ = encoding.encode_split(dotted, dotted)
    assert "agency_U.S. Mail" in encoded.columns and encoded.count() == train.count()


def test_model_inputs(spark):
    inf = float("inf")
    df = spark.createDataFrame(
        [(1, 2.0, 1.1, None, "l", "n", inf, 3), (2, 2.0, None, "p", "l", "n", 1.0, 3), (3, 2.0, 0.5, "p", None, "n", -inf, None)],
        "unique_key long, resolution_hours double, log_resolution_hours double, problem_type string, location_type string, note string, load double, month int",
    )
    rows = {r.unique_key: r.asDict() for r in model_inputs(df).collect()}
    assert set(rows) == {1, 3}
    assert set(rows[1]) == {"unique_key", "log_resolution_hours", "problem_type", "location_type", "load", "month"}
    assert rows[1]["load"] is None and rows[3]["load"] is None
    assert rows[1]["problem_type"] == "UNKNOWN" and rows[3]["location_type"] == "UNKNOWN"
    assert feature_columns(model_inputs(df)) == ["load", "month"]
    assert align(df, ["month", "problem_type_encoded"]).columns == ["month", "problem_type"]


def test_time_features(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (timestamp_ntz'2026-01-03 21:59:59'), (timestamp_ntz'2026-01-05 22:00:00'), "
        "(timestamp_ntz'2026-02-04 05:59:59'), (timestamp_ntz'2026-02-04 06:00:00') AS t(created_date)"
    )
    found = [tuple(r)[1:] for r in features.time_features(df).orderBy("created_date").collect()]
    assert found == [(21, 5, 1, 1, 0), (22, 0, 1, 0, 1), (5, 2, 2, 0, 1), (6, 2, 2, 0, 0)]
