"""Smoothed target encoding, fitted on training rows, out of fold for the training rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.functions.numbers import hash_number
from turnaround.operators.features import column_medians, impute, null_columns, numeric_columns
from turnaround.operators.joins import lookup_join
from turnaround.sources.storage import materialize


def fold(key: Column, n_folds: int = schema.FOLDS) -> Column:
    return (hash_number("fold", key) % n_folds).cast("int")


def split_name(key: Column, train: int = 60, validation: int = 20) -> Column:
    """`train`, `validation` or `test` by a hash of the key: the same under any partitioning."""
    place = hash_number("split", key) % 100
    return F.when(place < train, "train").when(place < train + validation, "validation").otherwise("test")


def with_split(df: DataFrame, key: str = "unique_key") -> DataFrame:
    return df.withColumn("split", split_name(F.col(key)))


def split_sizes(df: DataFrame) -> DataFrame:
    return with_split(df).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def _category_sums(df: DataFrame, cols: list[str], target: str, extra: list[str]) -> DataFrame:
    """Sum and count of the target per `(column, category, *extra)`.

    Rows are first grouped by all columns together, one pre-aggregated shuffle; the columns are then
    unpivoted from that small table, so a frequent category costs no more than a rare one.
    """
    joint = df.where(F.col(target).isNotNull()).groupBy(*cols, *extra).agg(F.sum(target).alias("s"), F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("category")) for c in cols])
    return (
        joint.select(F.explode(pairs).alias("p"), "s", "n", *extra)
        .select("p.*", "s", "n", *extra)
        .groupBy("column", "category", *extra)
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    )


def _smoothed(s: Column, n: Column, mean: Column, smoothing: float) -> Column:
    return (s + smoothing * mean) / (n + smoothing)


def _encoding_of(sums: DataFrame, smoothing: float) -> DataFrame:
    # One row per encoded column.
    totals = sums.groupBy("column").agg((F.sum("s") / F.sum("n")).alias("mean"))
    encoded = (
        sums.where(F.col("category").isNotNull())
        .join(F.broadcast(totals), "column")
        .select("column", "category", _smoothed(F.col("s"), F.col("n"), F.col("mean"), smoothing).alias("encoding"))
    )
    nothing = F.lit(None).cast("string")
    overall = totals.agg(F.max("mean").alias("encoding")).select(nothing.alias("column"), nothing.alias("category"), "encoding")
    return encoded.unionByName(overall)


def fit_encoding(
    df: DataFrame, cols: list[str] | None = None, target: str = schema.TARGET, smoothing: float = schema.SMOOTHING
) -> DataFrame:
    """`(column, category, encoding)`; the row with null column and category holds the global mean."""
    return _encoding_of(_category_sums(df, cols or list(schema.ENCODED), target, []), smoothing)


def _out_of_fold_of(sums: DataFrame, smoothing: float) -> DataFrame:
    """`(column, category, fold, encoding)` where each fold's encoding uses the other folds only.

    Sums of the other folds are the total minus the fold's own, so one pass replaces one fit per
    fold. A category that the other folds lack gets their mean.
    """
    # At most `n_folds` rows per category and per column reach these windows and this join.
    category = Window.partitionBy("column", "category")
    by_fold = sums.groupBy("column", "fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    column = Window.partitionBy("column")
    means = by_fold.select(
        "column",
        "fold",
        F.try_divide(F.sum("fs").over(column) - F.col("fs"), (F.sum("fn").over(column) - F.col("fn"))).alias("mean"),
    )
    others = sums.select(
        "column",
        "category",
        "fold",
        (F.sum("s").over(category) - F.col("s")).alias("s"),
        (F.sum("n").over(category) - F.col("n")).alias("n"),
    )
    # With no other rows the difference of sums may leave binary dust; the count is exact.
    s = F.when(F.col("n") == 0, 0.0).otherwise(F.col("s"))
    return others.join(F.broadcast(means), ["column", "fold"]).select(
        "column", "category", "fold", _smoothed(s, F.col("n"), F.col("mean"), smoothing).alias("encoding")
    )


def _attach(df: DataFrame, table: DataFrame, cols: list[str], extra: list[str], fallback: Column | None) -> DataFrame:
    result = df
    for c in cols:
        name = schema.ENCODED.get(c, f"{c}_encoded")
        lookup = table.where(F.col("column") == c).select(F.col("category").alias(c), *extra, F.col("encoding").alias(name))
        result = lookup_join(result, lookup, [c, *extra])
        if fallback is not None:
            result = result.withColumn(name, F.coalesce(name, fallback))
    return result.drop(*cols, *extra)


def _fold_sums(train: DataFrame, cols: list[str], target: str, key: str, n_folds: int) -> DataFrame:
    """Sums per category and fold, stored: everything an encoding needs from the training rows."""
    folded = train.withColumn("fold", fold(F.col(key), n_folds))
    return materialize(_category_sums(folded, cols, target, ["fold"]), "fold-sums")


def encode_out_of_fold(
    df: DataFrame,
    cols: list[str] | None = None,
    target: str = schema.TARGET,
    key: str = "unique_key",
    n_folds: int = schema.FOLDS,
    smoothing: float = schema.SMOOTHING,
    sums: DataFrame | None = None,
) -> DataFrame:
    """Training rows with encodings that never saw the row's own fold; the raw columns are dropped."""
    names = cols or list(schema.ENCODED)
    sums = _fold_sums(df, names, target, key, n_folds) if sums is None else sums
    table = _out_of_fold_of(sums, smoothing)
    return _attach(df.withColumn("fold", fold(F.col(key), n_folds)), table, names, ["fold"], None)


def global_mean(encoding: DataFrame) -> float:
    """The fallback of a fitted encoding (one row)."""
    return encoding.where(F.col("column").isNull()).first()["encoding"]


def apply_encoding(df: DataFrame, encoding: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Encode by lookup; unseen and null categories get the global mean; raw columns are dropped.

    Pass a stored encoding (written or materialized), it is read several times.
    """
    return _attach(df, encoding, cols or list(schema.ENCODED), [], F.lit(global_mean(encoding)))


def encode_split(
    train: DataFrame,
    evaluation: DataFrame,
    cols: list[str] | None = None,
    target: str = schema.TARGET,
    key: str = "unique_key",
    smoothing: float = schema.SMOOTHING,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encode and impute both frames from training rows alone: `(train, evaluation, encoding)`.

    The training rows are summed once; the full and the out-of-fold encodings both come from those
    sums. Both frames are stored, model fits read them many times.
    """
    names = cols or list(schema.ENCODED)
    sums = _fold_sums(train, names, target, key, schema.FOLDS)
    whole = sums.groupBy("column", "category").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    encoding = materialize(_encoding_of(whole, smoothing), "encoding")
    encoded_train = materialize(encode_out_of_fold(train, names, target, key, sums=sums), "train")
    encoded_eval = materialize(apply_encoding(evaluation, encoding, names), "evaluation")
    numeric = [c for c in numeric_columns(encoded_train) if c not in (key, target)]
    gaps = sorted(set(null_columns(encoded_train, numeric)) | set(null_columns(encoded_eval, numeric)))
    middle = column_medians(encoded_train, gaps)
    return impute(encoded_train, middle), impute(encoded_eval, middle), encoding
