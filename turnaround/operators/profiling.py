"""What is in a request table: shape, nulls, ranges, frequent values, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.functions.numbers import round_half_up
from turnaround.operators.quantiles import RAW_HOUR_CELLS, count_values, exact_quantiles
from turnaround.sources.storage import materialize


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def profile_dtypes(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, data_type string")


def profile_nulls(df: DataFrame) -> DataFrame:
    """Count and percent of nulls for the columns that have any."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (
        counts.unpivot(["_rows"], df.columns, "column_name", "null_count")
        .where("null_count > 0")
        .select("column_name", "null_count", round_half_up(F.col("null_count") * 100 / F.col("_rows"), 1).alias("null_pct"))
        .orderBy(F.desc("null_pct"), "column_name")
    )


def profile_date_range(df: DataFrame) -> DataFrame:
    return df.agg(
        *[fn(c).alias(f"{label}_{short}") for c, short in (("created_date", "created"), ("closed_date", "closed"))
          for label, fn in (("first", F.min), ("last", F.max))]
    )


def profile_closed_share(df: DataFrame) -> DataFrame:
    """Requests with and without a closed date, count and percent."""
    closed = F.col("closed_date").isNotNull()
    percent = F.avg(closed.cast("double")) * 100
    return df.agg(
        F.count_if(closed).alias("with_closed"),
        F.count_if(~closed).alias("without_closed"),
        round_half_up(percent, 1).alias("with_closed_pct"),
        round_half_up(100 - percent, 1).alias("without_closed_pct"),
    )


def profile_describe(df: DataFrame, value: str = "hours", digits: int = 2) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and greatest of one measure; null left out."""
    counted = count_values(df, [], value).where(F.col(value).isNotNull()).withColumn("measure", F.lit(value))
    v, n = F.col(value), F.col("n")
    basic = counted.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"),
        F.try_divide(F.sum(v * n), F.sum(n)).alias("_mean"),
        round_half_up(F.min(v), digits).alias("min"),
        round_half_up(F.max(v), digits).alias("max"),
    ).withColumn("measure", F.lit(value))
    # One row each; deviations are summed around the mean, which loses no digits.
    spread = counted.join(F.broadcast(basic), "measure").groupBy("measure").agg(
        F.sqrt(F.try_divide(F.sum((v - F.col("_mean")) * (v - F.col("_mean")) * n), F.sum(n) - 1)).alias("_std")
    )
    quartiles = exact_quantiles(counted, [], [value], {"p25": 0.25, "p50": 0.5, "p75": 0.75}, RAW_HOUR_CELLS, "n").select(
        "measure", *[round_half_up(F.col(q), digits).alias(q) for q in ("p25", "p50", "p75")]
    )
    joined = basic.join(spread, "measure", "left").join(quartiles, "measure", "left")
    mean, std = (round_half_up(F.col(c), digits).alias(c[1:]) for c in ("_mean", "_std"))
    return joined.select("measure", "count", mean, std, "min", "max", "p25", "p50", "p75")


def profile_anomalies(df: DataFrame, max_hours: float = schema.MAX_HOURS) -> DataFrame:
    return df.agg(
        F.count_if(F.col("hours") < 0).alias("negative_hours"), F.count_if(F.col("hours") > max_hours).alias("over_one_year")
    )


def profile_top_values(df: DataFrame, columns: list[str] = schema.PROFILED, top: int = 3) -> DataFrame:
    """Number of distinct values and the most frequent ones per column; absent columns are skipped.

    All columns are counted in one pass and the counts stored, as they are read twice. The rank filter lets Spark cut each partition to `top` rows
    per column before the ranking shuffle, so a column with many values is never sorted whole.
    """
    present = [c for c in columns if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in present])
    counts = materialize(
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("rows")),
        "value-counts",
    )
    order = Window.partitionBy("column_name").orderBy(F.desc("rows"), "value")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    unique = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_values"))
    return best.join(unique, "column_name")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), column)
    )


def sample_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def first_by_hash(df: DataFrame, n: int, seed: int = 42, key: str = "unique_key") -> DataFrame:
    """The `n` rows of least `sample_order`, in that order; null keys first.

    Counted hash prefixes (65,536 a look, over the key alone) tell the cut-off below which about `n` rows
    lie, looking four digits further where one prefix holds too many. Only what lies below is ordered, so
    the last task reads about `n` rows however many partitions there are.
    """
    place = F.coalesce(sample_order(key, seed), F.lit(""))
    least = _hash_cutoff(df.select(place.alias("place")), n)
    near = df if least is None else df.where(F.substring(place, 1, len(least)) <= least)
    return near.orderBy(place, key).limit(n)


def _hash_cutoff(places: DataFrame, n: int) -> str | None:
    """A prefix such that the rows up to it are `n` at least, and twice as many at most unless their keys
    are equal; None if there are fewer rows."""
    prefix, before = "", 0
    while True:
        width = len(prefix) + 4
        here = places.where(F.col("place").startswith(prefix)) if prefix else places
        counts = sorted((r["p"], r["n"]) for r in here.groupBy(F.substring("place", 1, width).alias("p")).agg(F.count("*").alias("n")).collect())
        for value, rows in counts:
            if before + rows >= n:
                break
            before += rows
        else:
            return None
        if before + rows <= 2 * n or len(value) < width or width == 32:
            return value
        prefix = value


def sample_rows(
    df: DataFrame, n: int = 3, seed: int = 42, columns: list[str] | None = None, key: str = "unique_key"
) -> DataFrame:
    """`n` random rows without replacement; the same rows on every run and any partitioning."""
    ordered = first_by_hash(df, n, seed, key)
    return ordered.select(*columns) if columns else ordered


def verify_load(df: DataFrame, columns: list[str] = schema.SAMPLED, n: int = 3) -> DataFrame:
    """First `n` rows by key beside the row count of the whole table."""
    names = ", ".join(f"`{c}`" for c in columns)
    return df.sparkSession.sql(
        f"SELECT {names}, (SELECT count(*) FROM {{t}}) AS table_rows FROM {{t}} ORDER BY `{columns[0]}` LIMIT {n}", t=df
    )


def resolution_stats(df: DataFrame, value: str = "hours", digits: int = 1) -> DataFrame:
    """Least, median, mean and greatest of a measure."""
    counted = count_values(df, [], value).where(F.col(value).isNotNull())
    v, n = F.col(value), F.col("n")
    basic = counted.agg(
        round_half_up(F.min(v), digits).alias("min_hours"),
        round_half_up(F.try_divide(F.sum(v * n), F.sum(n)), digits).alias("mean_hours"),
        round_half_up(F.max(v), digits).alias("max_hours"),
    ).withColumn("measure", F.lit(value))
    middle = exact_quantiles(counted, [], [value], {"m": 0.5}, weight="n")
    return basic.join(middle, "measure", "left").select(
        "min_hours", round_half_up(F.col("m"), digits).alias("median_hours"), "mean_hours", "max_hours"
    )
