"""Resolution-time questions over the clean table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.functions.dates import day_text, is_night, sunday_day
from turnaround.functions.numbers import round_half_up
from turnaround.operators.quantiles import exact_quantiles, summarize_counts, time_summary
from turnaround.sources.storage import materialize


def bucket(hours: Column) -> Column:
    (first_bound, first_label), *rest = schema.BUCKETS
    start = F.when(hours <= first_bound, first_label)
    return reduce(lambda chain, b: chain.when(hours <= b[0], b[1]), rest, start).otherwise(schema.LAST_BUCKET)


def time_distribution(clean: DataFrame, rows: Column | None = None) -> DataFrame:
    """Requests per resolution-time bucket and their percent of all, shortest bucket first. `rows` adds up
    the requests of a group where the table is counted already."""
    hours = F.col("resolution_hours")
    counts = clean.groupBy(bucket(hours).alias("bucket")).agg(
        (F.count(F.lit(1)) if rows is None else rows).alias("complaints"), F.min(hours).alias("_from")
    )
    # At most one row per bucket reaches this window, so a single partition is enough.
    total = F.sum("complaints").over(Window.partitionBy())
    return (
        counts.withColumn("pct", round_half_up(F.col("complaints") * 100 / total, 1))
        .orderBy("_from")
        .select("bucket", "complaints", "pct")
    )


def by_segment(clean: DataFrame, segment: str | Column, columns: list[str]) -> DataFrame:
    """Time summary per value of a segment, slowest median first."""
    return slowest_first(time_summary(clean, [segment]), columns)


def slowest_first(summary: DataFrame, columns: list[str]) -> DataFrame:
    key = summary.columns[0]
    return summary.orderBy(F.desc_nulls_first("median_hours"), F.asc_nulls_last(key)).select(key, *columns)


def ranked_types(
    clean: DataFrame, slowest: bool = True, top: int = 10, min_rows: int = 100, columns: list[str] | None = None
) -> DataFrame:
    """The problem types with the highest or lowest median, among those with more than `min_rows`."""
    return rank_types(time_summary(clean, ["problem_type"]), slowest, top, min_rows, columns)


def rank_types(
    summary: DataFrame, slowest: bool = True, top: int = 10, min_rows: int = 100, columns: list[str] | None = None
) -> DataFrame:
    median = F.col("median_hours")
    order = median.desc_nulls_first() if slowest else median.asc_nulls_last()
    return (
        summary.where(F.col("complaints") > min_rows)
        .orderBy(order, F.asc_nulls_last("problem_type"))
        .limit(top)
        .select("problem_type", *(columns or ["complaints", "median_hours"]))
    )


def agency_types(clean: DataFrame, agency: str = schema.HOUSING_AGENCY, top: int = 8) -> DataFrame:
    return ranked_types(clean.where(F.col("agency") == agency), top=top, min_rows=0)


def by_hour(clean: DataFrame) -> DataFrame:
    hour = F.hour("created_date").alias("hour")
    return time_summary(clean, [hour]).select("hour", "complaints", "median_hours").orderBy("hour")


def day_type() -> Column:
    weekend = sunday_day(F.col("created_date")).isin(0, 6)
    return F.when(weekend, "Weekend").otherwise("Weekday").alias("day_type")


def time_of_day() -> Column:
    night = is_night(F.hour("created_date"))
    return F.when(night, "Night (10pm-6am)").otherwise("Day (6am-10pm)").alias("time_of_day")


def by_hour_and_day(clean: DataFrame) -> DataFrame:
    """Median per hour and day (0 = Sunday), in no order: it feeds the pivot."""
    keys = [F.hour("created_date").alias("hour"), sunday_day(F.col("created_date")).alias("dow")]
    return time_summary(clean, keys).select("hour", "dow", "median_hours")


def by_borough_and_agency(clean: DataFrame, agencies: list[str] = schema.MATRIX_AGENCIES) -> DataFrame:
    chosen = clean.where((F.col("borough") != schema.UNSPECIFIED) & F.col("agency").isin(agencies))
    return time_summary(chosen, ["borough", "agency"]).select("borough", "agency", "median_hours", "complaints")


def daily_volume(clean: DataFrame) -> DataFrame:
    return (
        clean.groupBy(day_text(F.col("created_date")).alias("date"), "agency")
        .agg(F.count(F.lit(1)).alias("complaints"))
        .orderBy("date", "agency")
    )


def daily_volume_top(clean: DataFrame, agencies: list[str] = schema.VOLUME_AGENCIES) -> DataFrame:
    """Daily volume of the busiest agencies, with the day as a date."""
    return daily_volume(clean.where(F.col("agency").isin(agencies))).withColumn("date", F.to_date("date"))


#: What one scan counts for: the columns that tell a question's groups apart.
QUESTIONS = {
    "agency": ("agency",), "borough": ("borough",), "channel": ("channel",), "type": ("problem_type",), "hour": ("hour",),
    "day_type": ("day_type",), "time_of_day": ("time_of_day",), "hour_day": ("hour", "dow"),
    "borough_agency": ("borough", "agency"), "agency_type": ("agency", "problem_type"), "all": (),
}
DAILY = ("date", "agency")


def count_questions(clean: DataFrame) -> DataFrame:
    """Equal hours of every group of every question as one row, from one scan of the clean table, stored.

    `(question, <columns of all questions>, _v, _n)`: grouping sets over segments and hours, so rows are
    added up before they are shuffled and a large group is spread by value. `daily` has no hours.
    """
    created = F.col("created_date")
    keyed = clean.select(
        "agency", "borough", F.col("open_data_channel_type").alias("channel"), "problem_type", F.hour(created).alias("hour"),
        day_type(), time_of_day(), sunday_day(created).alias("dow"), day_text(created).alias("date"),
        F.col("resolution_hours").cast("double").alias("_v"),
    )
    columns = keyed.columns
    sets = {name: [*keys, "_v"] for name, keys in QUESTIONS.items()} | {"daily": list(DAILY)}
    # A grouping id has a bit per column, first column highest, set where the column is left out.
    ids = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s) for name, s in sets.items()}
    counted = keyed.groupingSets(list(sets.values()), *columns).agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("_n")
    )
    question = reduce(lambda chain, x: chain.when(F.col("_id") == x[1], x[0]), ids.items(), F.when(F.lit(False), ""))
    return materialize(counted.select(question.alias("question"), *columns, "_n"), "questions")


def summary_of(counted: DataFrame, question: str) -> DataFrame:
    """`time_summary` of one question's groups."""
    keys = list(QUESTIONS[question])
    return summarize_counts(counted.where(F.col("question") == question).select(*keys, "_v", "_n"), keys)


def charts(counted: DataFrame, agencies: list[str] = schema.MATRIX_AGENCIES) -> dict[str, DataFrame]:
    """Every chart's table from what `count_questions` stored; equal to the questions asked one by one."""
    both, all_three = ["complaints", "median_hours"], ["complaints", "median_hours", "avg_hours"]
    types = summary_of(counted, "type")
    matrix = summary_of(counted, "borough_agency").where(
        (F.col("borough") != schema.UNSPECIFIED) & F.col("agency").isin(agencies)
    )
    housing = summary_of(counted, "agency_type").where(F.col("agency") == schema.HOUSING_AGENCY).drop("agency")
    hours = counted.where("question = 'all'").select(F.col("_v").alias("resolution_hours"), "_n")
    daily = counted.where("question = 'daily'").select(*DAILY, F.col("_n").alias("complaints"))
    return {
        "distribution": time_distribution(hours, F.sum("_n")),
        "agency": slowest_first(summary_of(counted, "agency"), ["complaints", "avg_hours", "median_hours", "max_hours"]),
        "borough": slowest_first(summary_of(counted, "borough"), all_three),
        "channel": slowest_first(summary_of(counted, "channel"), both),
        "weekend": slowest_first(summary_of(counted, "day_type"), all_three),
        "night": slowest_first(summary_of(counted, "time_of_day"), all_three),
        "hour": summary_of(counted, "hour").select("hour", *both).orderBy("hour"),
        "hour_day": summary_of(counted, "hour_day").select("hour", "dow", "median_hours").orderBy("dow", "hour"),
        "borough_agency": matrix.select("borough", "agency", "median_hours", "complaints"),
        "slowest": rank_types(types, top=15),
        "fastest": rank_types(types, slowest=False, top=15),
        "agency_types": rank_types(housing, top=8, min_rows=0),
        "daily": daily.orderBy("date", "agency"),
    }


def row_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), column)


def error_by_segment(
    predictions: DataFrame,
    clean: DataFrame,
    segment: str,
    min_rows: int = 500,
    exclude: tuple[str, ...] = (schema.UNSPECIFIED,),
) -> DataFrame:
    """Absolute error of predictions per value of a clean column, worst median first."""
    if segment not in clean.columns:
        raise ValueError(f"no column {segment} in the clean table")
    labelled = clean.where(~F.col(segment).isin(*exclude)).select("unique_key", F.col(segment).alias("segment"))
    errors = predictions.join(labelled, "unique_key").select(
        "segment",
        F.abs(F.col("predicted_hours") - F.col("actual_hours")).alias("abs_error"),
        F.col("actual_hours").alias("actual"),
    )
    means = errors.groupBy("segment").agg(
        F.count(F.lit(1)).alias("complaints"), round_half_up(F.avg("abs_error"), 1).alias("mae_hours")
    )
    middle = exact_quantiles(errors, ["segment"], ["abs_error", "actual"], {"m": 0.5})

    def median(measure: str) -> Column:
        return round_half_up(F.max(F.when(F.col("measure") == measure, F.col("m"))), 1)

    both = middle.groupBy("segment").agg(
        median("abs_error").alias("median_abs_error"), median("actual").alias("median_actual")
    )
    return (
        means.where(F.col("complaints") >= min_rows)
        .join(both, "segment")
        .select("segment", "complaints", "median_abs_error", "mae_hours", "median_actual")
        .orderBy(F.desc("median_abs_error"), "segment")
    )


def scoring_options(clean: DataFrame) -> DataFrame:
    """Every value a request may carry, one row per field and value."""
    fields = {
        "agency": "agencies",
        "borough": "boroughs",
        "open_data_channel_type": "channels",
        "problem_type": "problem_types",
        "location_type": "location_types",
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for c, n in fields.items()])
    return (
        clean.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
        .orderBy("field", "value")
    )
