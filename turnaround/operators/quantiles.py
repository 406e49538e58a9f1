"""Exact, interpolated quantiles without bringing a whole group into one task.

`percentile` keeps every distinct value of a group in one buffer. Both functions here first count
equal values per group, a shuffle that is pre-aggregated and spread by value, so a group holding a
third of the table is shared by all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnaround.functions.numbers import round_half_up
from turnaround.sources.storage import materialize

# A year of hours has 876,000 cells of this width; a cell holds 36 different seconds.
HOUR_CELLS = (0.01,)
# Unchecked dates may lie centuries apart: 100-hour cells first.
RAW_HOUR_CELLS = (100.0, 0.01)
# Any doubles: cells by power of two and sign, then 65,536 parts of a power per step. They depend on no
# range of the data, so no outlier can gather the other values in one cell.
POWER_CELLS = (None, 2.0**16, 2.0**32, 2.0**48)


def time_summary(
    df: DataFrame, keys: Sequence[str | Column], value: str = "resolution_hours", digits: int = 1
) -> DataFrame:
    """Count, median, mean, least and greatest hours per group.

    For hours stored with two decimals: a group has at most 876,000 distinct values within a year,
    so the counted values of a group always fit one task.
    """
    grouped = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return summarize_counts(grouped, grouped.columns[: len(keys)], digits)


def summarize_counts(counted: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    """`time_summary` of values that are counted already: rows `(*keys, _v, _n)`."""
    known = F.when(F.col("_v").isNotNull(), F.col("_n"))
    return counted.groupBy(*keys).agg(
        F.sum("_n").alias("complaints"),
        round_half_up(F.percentile("_v", 0.5, F.col("_n")), digits).alias("median_hours"),
        round_half_up(F.sum(F.col("_v") * F.col("_n")) / F.sum(known), digits).alias("avg_hours"),
        round_half_up(F.min("_v"), digits).alias("min_hours"),
        round_half_up(F.max("_v"), digits).alias("max_hours"),
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    fractions: dict[str, float],
    cells: Sequence[float | None] = HOUR_CELLS,
    weight: str | None = None,
) -> DataFrame:
    """Quantiles of unrounded measures: `(*keys, measure, rows, <one column per fraction>)`.

    The counted values of a group are located step by step: running counts of cells of the first
    width tell which cells hold the wanted ranks, only those are cut into cells of the next width, and
    the values left are put in order. A task sees the cells of one group, then the cells of one cell,
    then the distinct values of the smallest cells, never a whole group. Null and NaN are left out.

    `cells` are widths in units of the measure, or `POWER_CELLS`. `weight` names a column that says how
    often a row counts, for tables that are counted already (see `count_values`).
    """
    group = [*keys, "measure"]
    counted = (
        _measures(df, keys, values, F.col(weight) if weight else F.lit(1))
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy(*group, "v")
        .agg(F.sum("w").alias("n"))
    )
    # A struct compares null group keys as equal, so plain joins and windows on it keep null groups.
    rows = counted.withColumn("place", F.struct(*group))
    known = []
    for cell in _powers(cells[1:]) if cells[0] is None else [F.floor(F.col("v") / width) for width in cells]:
        rows = _narrow(rows.withColumn("cell", cell), known, fractions)
        known = ["before", "rows"]
    in_place = Window.partitionBy("place").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("upto", F.col("before") + F.sum("n").over(in_place))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("v")))

    def interpolated(q: float) -> Column:
        low, high = at(F.floor(_rank(q))), at(F.ceil(_rank(q)))
        return low + (high - low) * F.max(_rank(q) - F.floor(_rank(q)))

    return ranked.groupBy(*group).agg(
        F.max("rows").alias("rows"), *[interpolated(q).alias(name) for name, q in fractions.items()]
    )


def count_values(df: DataFrame, keys: Sequence[str], value: str, **totals: Column) -> DataFrame:
    """`(*keys, value, n, *totals)`: equal values of a group as one row, counted and stored.

    The one scan of a large table for quantiles (with `weight="n"`) and for whatever else the counted
    rows or the further `totals` answer. Null values are counted too.
    """
    named = [c.alias(name) for name, c in totals.items()]
    return materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *named), "counted")


def _measures(df: DataFrame, keys: Sequence[str], values: Sequence[str], weight: Column) -> DataFrame:
    """One row per row and measure: `(*keys, measure, v, w)`."""
    w = weight.alias("w")
    if len(values) == 1:
        return df.select(*keys, F.lit(values[0]).alias("measure"), F.col(values[0]).cast("double").alias("v"), w)
    pairs = F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("v")) for v in values])
    return df.select(*keys, F.explode(pairs).alias("_m"), w).select(*keys, "_m.measure", "_m.v", "w")


def _powers(parts: Sequence[float]) -> list[Column]:
    """Cells that grow with the value: its sign and power of two, then parts of that power."""
    v = F.col("v")
    power = F.floor(F.least(F.log2(F.abs(v)), F.lit(1025.0)))
    signed = F.coalesce(F.signum(v).cast("bigint") * (power + 1100), F.lit(0))
    # Within a cell of the first step the power is one and the same, so the parts are in order.
    inner = [F.coalesce(F.floor(v / F.pow(F.lit(2.0), power) * n), F.lit(0)) for n in parts]
    return [signed, *inner]


def _rank(q: float) -> Column:
    """Wanted rank, counted from 0; a fraction lies between two rows."""
    return (F.col("rows") - 1) * F.lit(float(q))


def _narrow(rows: DataFrame, known: list[str], fractions: dict[str, float]) -> DataFrame:
    """Keep the rows whose cell holds a wanted rank; `before` becomes the count of smaller rows."""
    running = Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.groupBy("place", "cell", *known).agg(F.sum("n").alias("cell_n"))
    start = F.col("before") if known else F.lit(0)
    total = F.col("rows") if known else F.sum("cell_n").over(Window.partitionBy("place"))
    counted = sized.select(
        F.struct("place", "cell").alias("place"),
        (start + F.sum("cell_n").over(running) - F.col("cell_n")).alias("before"),
        "cell_n",
        total.alias("rows"),
    )
    wanted = F.array(*[edge(_rank(q)).cast("bigint") for q in fractions.values() for edge in (F.floor, F.ceil)])
    holds = F.exists(wanted, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("cell_n")))
    targets = counted.where(holds).drop("cell_n")
    inner = rows.withColumn("place", F.struct("place", "cell")).drop("cell", *known)
    return inner.join(targets, "place")


def medians(df: DataFrame, keys: Sequence[str], value: str, digits: int = 1, weight: str | None = None) -> DataFrame:
    """Rounded median and row count per group of an unrounded measure: `(*keys, median, rows)`."""
    found = exact_quantiles(df, keys, [value], {"median": 0.5}, weight=weight)
    return found.select(*keys, round_half_up(F.col("median"), digits).alias("median"), "rows")
