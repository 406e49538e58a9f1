"""Raw requests to clean and open tables, with an account of every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnaround import schema
from turnaround.functions.dates import hours_between, moment
from turnaround.functions.text import standardize, zip_text

KEPT = "kept"


def is_closed() -> Column:
    return F.col("status").eqNullSafe("CLOSED")


def split_closed(raw: DataFrame) -> DataFrame:
    return raw.where(is_closed())


def split_open(raw: DataFrame) -> DataFrame:
    """Everything not closed, including requests without a status."""
    return raw.where(~is_closed())


def with_hours(df: DataFrame, name: str = "hours") -> DataFrame:
    """Add the unrounded resolution time."""
    return df.withColumn(name, hours_between(F.col("created_date"), F.col("closed_date")))


def fate(start: str, end: str, max_hours: float) -> Column:
    """First rule a closed request fails, in rule order, or `kept`. Needs `hours`."""
    created, hours = F.col("created_date"), F.col("hours")
    return (
        F.when(F.col("closed_date").isNull(), "1 no closed date")
        .when(created.isNull(), "2 no created date")
        .when(hours <= 0, "3 closed at or before creation")
        .when(~created.between(moment(start), moment(end)), "4 created outside window")
        .when(hours > max_hours, "5 over one year")
        .otherwise(KEPT)
    )


def valid(start: str, end: str, max_hours: float) -> Column:
    """Usable dates, a positive time within the limit, created inside the window. Needs `hours`."""
    return (
        F.col("closed_date").isNotNull()
        & (F.col("hours") > 0)
        & (F.col("hours") <= max_hours)
        & F.col("created_date").between(moment(start), moment(end))
    )


def keep_valid(
    raw: DataFrame,
    start: str = schema.CREATED_FROM,
    end: str = schema.CREATED_TO,
    max_hours: float = schema.MAX_HOURS,
) -> DataFrame:
    """Closed requests with usable dates, plus their unrounded `hours`; both window ends count."""
    return with_hours(split_closed(raw)).where(valid(start, end, max_hours))


def fill_defaults(df: DataFrame, defaults: dict[str, str] = schema.FILL_DEFAULTS) -> DataFrame:
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def clean_requests(raw: DataFrame, **window) -> DataFrame:
    """The 31-column clean table; hours are rounded to two decimals only after filtering."""
    valid = fill_defaults(keep_valid(raw, **window))
    hours = F.col("hours").cast("decimal(10,2)").alias("resolution_hours")
    return valid.select(*[hours if c == "resolution_hours" else F.col(c) for c in schema.CLEAN_COLUMNS])


def open_requests(raw: DataFrame) -> DataFrame:
    """The 27-column table of requests that are not closed."""
    return fill_defaults(split_open(raw)).select(*schema.OPEN_COLUMNS)


def clean_rejects(
    raw: DataFrame,
    start: str = schema.CREATED_FROM,
    end: str = schema.CREATED_TO,
    max_hours: float = schema.MAX_HOURS,
) -> DataFrame:
    """Closed requests per rule that removed them (or `kept`), in one pass."""
    return (
        with_hours(split_closed(raw))
        .groupBy(fate(start, end, max_hours).alias("rule"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("rule")
    )


def zip_and_text(raw: DataFrame) -> DataFrame:
    """Standardise the key text columns and the zip code of a typed table."""
    return raw.withColumns(
        {c: standardize(F.col(c)) for c in schema.STANDARDIZED} | {"incident_zip": zip_text(F.col("incident_zip"))}
    )


def constraint_checks(
    df: DataFrame, table: T.StructType = schema.RAW_SCHEMA, limits: dict[str, int] = schema.TEXT_LIMITS
) -> dict[str, Column]:
    """Per column whether a typed table would refuse its value: text too long, number that does not fit."""
    checks = {}
    for field in table.fields:
        if field.name not in df.columns:
            continue
        c = F.col(field.name)
        if field.name in limits:
            checks[field.name] = F.length(c) > limits[field.name]
        elif not isinstance(field.dataType, T.StringType):
            checks[field.name] = c.isNotNull() & c.try_cast(field.dataType.simpleString()).isNull()
    return checks


def constraint_violations(
    df: DataFrame, table: T.StructType = schema.RAW_SCHEMA, limits: dict[str, int] = schema.TEXT_LIMITS
) -> DataFrame:
    """Values a typed table would refuse, per column.

    One pass: every column's failures are counted in one aggregate and turned into rows after it.
    """
    checks = constraint_checks(df, table, limits)
    counts = df.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    return counts.unpivot([], list(checks), "column_name", "violations")


def duplicate_keys(df: DataFrame, key: str = "unique_key") -> DataFrame:
    """Keys that are missing or occur more than once."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where((F.col("rows") > 1) | F.col(key).isNull())


def reconcile_counts(
    raw: DataFrame,
    start: str = schema.CREATED_FROM,
    end: str = schema.CREATED_TO,
    max_hours: float = schema.MAX_HOURS,
) -> DataFrame:
    """Rows of the raw table and how many of them belong to the clean and the open table, in one scan."""
    tables = {
        "requests_raw": F.lit(True),
        "requests_clean": is_closed() & valid(start, end, max_hours),
        "requests_open": ~is_closed(),
    }
    counts = with_hours(raw).agg(*[F.count_if(belongs).alias(name) for name, belongs in tables.items()])
    return counts.unpivot([], list(tables), "table_name", "rows")
