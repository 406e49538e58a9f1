"""Tables behind charts: pivots, histograms, samples and ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.functions.numbers import flag, round_half_up
from turnaround.operators.analysis import ranked_types
from turnaround.operators.profiling import first_by_hash


def predicted_vs_actual(predictions: DataFrame, top: float = 300, n: int = 8000, seed: int = 42) -> DataFrame:
    """Up to `n` random predictions with both values in `0..top`; null values fall out."""
    inside = F.col("actual_hours").between(0, top) & F.col("predicted_hours").between(0, top)
    return first_by_hash(predictions.where(inside), n, seed)


def dow_label(dow: Column) -> Column:
    """Name of a Sunday-based day number; other numbers give null."""
    return F.get(F.array(*[F.lit(d) for d in schema.DOW_LABELS]), dow)


def pivot_hour_day(hour_day: DataFrame) -> DataFrame:
    """Days Monday to Sunday down, hours 0 to 23 across; empty cells null, every day present."""
    days = schema.DOW_LABELS[1:] + schema.DOW_LABELS[:1]
    order = hour_day.sparkSession.createDataFrame(list(enumerate(days)), "day_order int, dow_label string")
    cells = (
        hour_day.withColumn("dow_label", dow_label(F.col("dow")))
        .groupBy("dow_label")
        .pivot("hour", list(range(24)))
        .agg(F.avg("median_hours"))
    )
    return F.broadcast(order).join(cells, "dow_label", "left").orderBy("day_order").drop("day_order")


def pivot_borough_agency(matrix: DataFrame) -> DataFrame:
    """Agencies in fixed order down, the five boroughs across; empty cells 0."""
    agencies = F.array(*[F.lit(a) for a in schema.MATRIX_AGENCIES])
    return (
        matrix.where(F.col("agency").isin(schema.MATRIX_AGENCIES))
        .groupBy("agency")
        .pivot("borough", schema.BOROUGHS)
        .agg(F.avg("median_hours"))
        .fillna(0, subset=schema.BOROUGHS)
        .orderBy(F.array_position(agencies, F.col("agency")))
    )


def value_range(long_form: DataFrame, value: str = "median_hours") -> DataFrame:
    v = F.when(~F.isnan(value), F.col(value))
    return long_form.agg(F.min(v).alias("low"), F.max(v).alias("high"))


def _clipped(limit: float) -> Column:
    return F.least(F.greatest(F.col("error_hours"), F.lit(-float(limit))), F.lit(float(limit)))


def error_clip_mean(predictions: DataFrame, limit: float = 200) -> DataFrame:
    """Mean error after clipping to `-limit..limit`."""
    known = predictions.where(F.col("error_hours").isNotNull())
    return known.agg(F.count(F.lit(1)).alias("predictions"), round_half_up(F.avg(_clipped(limit)), 1).alias("mean_error"))


def error_histogram(predictions: DataFrame, limit: float = 200, bins: int = 80) -> DataFrame:
    """Clipped errors counted in `bins` equal bins; the top edge belongs to the last bin."""
    width = 2 * limit / bins
    place = F.least(F.floor((_clipped(limit) + limit) / width), F.lit(bins - 1)).cast("int")
    return (
        predictions.where(F.col("error_hours").isNotNull())
        .groupBy(place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("predictions"))
        .select("bin", (F.col("bin") * width - limit).alias("from_hours"), "predictions")
        .orderBy("bin")
    )


def agency_flagged(agencies: DataFrame, slow_hours: float = 60) -> DataFrame:
    """Agencies by median, quickest first, with the slow ones marked."""
    return agencies.withColumn("is_slow", flag(F.col("median_hours") > slow_hours)).orderBy("median_hours", "agency")


def type_chart_rows(clean: DataFrame, slowest: bool = True, top: int = 10, min_rows: int = 100, width: int = 30) -> DataFrame:
    """Ranked problem types in bar order (longest bar last for slowest), label cut to `width`."""
    rows = ranked_types(clean, slowest, top, min_rows)
    order = F.col("median_hours").asc() if slowest else F.col("median_hours").desc()
    return rows.orderBy(order, "problem_type").select(
        F.substring("problem_type", 1, width).alias("label"), "median_hours", "complaints"
    )
