"""Model features from the clean table."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnaround import schema
from turnaround.functions.dates import is_night, is_weekend, monday_day
from turnaround.functions.numbers import flag, to_double
from turnaround.operators.joins import quoted
from turnaround.operators.quantiles import POWER_CELLS, exact_quantiles


def time_features(df: DataFrame, created: str = "created_date") -> DataFrame:
    ts = F.col(created)
    return df.withColumns({"hour_of_day": F.hour(ts), "day_of_week": monday_day(ts), "month": F.month(ts)}).withColumns(
        {
            "is_weekend": flag(is_weekend(F.col("day_of_week"))),
            "is_night": flag(is_night(F.col("hour_of_day"))),
        }
    )


def log_target(df: DataFrame, hours: str = "resolution_hours") -> DataFrame:
    """Stored hours as double and their `log1p`; text that is no number becomes null."""
    return df.withColumn(hours, to_double(F.col(hours))).withColumn(schema.TARGET, F.log1p(hours))


def fill_unknown(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.fillna(schema.UNKNOWN, subset=columns or list(schema.ENCODED))


def encoding_inputs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values per column to encode, after the fill. Values are counted in one pass."""
    names = columns or list(schema.ENCODED)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("category")) for c in names])
    return (
        fill_unknown(df, names)
        .select(F.explode(pairs).alias("p"))
        .select("p.*")
        .distinct()
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("unique_values"))
    )


def fit_categories(df: DataFrame, columns: dict[str, str] = schema.ONE_HOT) -> list[tuple[str, str]]:
    """`(column, value)` pairs that become one-hot columns, in order of the column names to be.

    One small job. A wide table's columns must be known on the driver, whatever their number; where
    values are many, `sparse_categories` gives a model one vector instead.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    distinct = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    found = [(r.column_name, r.value) for r in distinct.collect()]
    return sorted(found, key=lambda cv: one_hot_name(*cv, columns))


def sparse_categories(df: DataFrame, columns: dict[str, str] = schema.ONE_HOT, output: str = "categories") -> PipelineModel:
    """A fitted model that adds one sparse 0/1 vector for all values of the columns, so their number
    never sizes a schema; unknown and null values give all 0."""
    names = list(columns)
    indexed, coded = [f"_{c}_index" for c in names], [f"_{c}_code" for c in names]
    steps = [
        StringIndexer(inputCols=names, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True),
        VectorAssembler(inputCols=coded, outputCol=output),
    ]
    return Pipeline(stages=steps).fit(df)


def one_hot_name(column: str, value: str, columns: dict[str, str] = schema.ONE_HOT) -> str:
    return f"{columns[column]}_{value}"


def one_hot(df: DataFrame, categories: list[tuple[str, str]], columns: dict[str, str] = schema.ONE_HOT) -> DataFrame:
    """Replace each column by one 0/1 column per known value; null or unknown gives all 0."""
    added = [
        F.coalesce(flag(F.col(c) == v), F.lit(0)).alias(one_hot_name(c, v, columns)) for c, v in categories
    ]
    return df.select(*[quoted(c) for c in df.columns if c not in columns], *added)


def request_features(clean: DataFrame, categories: list[tuple[str, str]] | None = None) -> DataFrame:
    """Feature table: key, hours, target, time features, two raw categoricals, one-hot columns."""
    known = fit_categories(clean) if categories is None else categories
    base = fill_unknown(log_target(time_features(clean))).select(
        "unique_key", "resolution_hours", schema.TARGET, *schema.TIME_FEATURES, *schema.ENCODED, *schema.ONE_HOT
    )
    return one_hot(base, known)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that hold a null, found in one pass."""
    if not columns:
        return []
    row = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i]]


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median per numeric column, one value each on the driver."""
    if not columns:
        return {}
    names = {f"c{i}": c for i, c in enumerate(columns)}
    renamed = df.select(*[quoted(c).cast("double").alias(n) for n, c in names.items()])
    found = exact_quantiles(renamed, [], list(names), {"m": 0.5}, POWER_CELLS)
    return {names[r.measure]: r.m for r in found.select("measure", "m").collect()}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(quoted(c).cast("double"), F.lit(m)) for c, m in medians.items()}) if medians else df


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill nulls of numeric columns with the column's median; columns without nulls are untouched."""
    return impute(df, column_medians(df, null_columns(df, columns or numeric_columns(df))))
