from pyspark.sql import functions as F

from turnaround.operators.joins import lookup_join


def tables(spark):
    left = spark.range(2000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 400).cast("int").alias("k"),
        F.lit("x").alias("j"),
    )
    lookup = spark.range(300).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("j"), (F.col("id") * 10).alias("v"))
    return left, lookup


def bag(df):
    return sorted(map(str, df.select("id", "k", "j", "v").collect()))


def shuffled(spark, left, lookup):
    """The join as it runs when the lookup is too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = lookup_join(left, lookup, ["k", "j"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        return bag(joined), plan, joined.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_lookup_gives_the_same_rows(spark):
    left, lookup = tables(spark)
    small = lookup_join(left, lookup, ["k", "j"])
    rows, plan, columns = shuffled(spark, left, lookup)
    assert rows == bag(small) and columns == small.columns == ["id", "k", "j", "v"]
    assert "SortMergeJoin" in plan and small.count() == 2000


def test_a_hot_key_keeps_all_its_rows(spark):
    left, lookup = tables(spark)
    assert sum("k=1," in row and "v=10" in row for row in shuffled(spark, left, lookup)[0]) == left.where("k = 1").count()


def test_rows_without_a_key_are_dealt_out(spark):
    left, lookup = tables(spark)
    plan = shuffled(spark, left.where("k is null"), lookup)[1]
    keys = [line for line in plan.split("\n") if "hashpartitioning" in line]
    assert all("_place" in line for line in keys)


def test_small_lookup_is_broadcast_without_shuffle(spark):
    left, lookup = tables(spark)
    plan = lookup_join(left, lookup, ["k", "j"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
