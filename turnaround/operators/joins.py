"""Lookup joins that hold up against large lookups, hot keys and missing keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows without a key are spread over so many places when a join shuffles.
PLACES = 1024


def quoted(name: str) -> Column:
    """A column by its exact name; names made from data may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def lookup_join(left: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a table with at most one row per key; works on batch and streaming frames.

    One plain join: Spark broadcasts the lookup when its measured bytes allow it, and splits hot keys
    of the large side where it has to shuffle. Rows without a key match nothing; they get a place of
    their own in the join key, so that a shuffle deals them out and not all to one task.
    """
    extra = [f.name for f in lookup.schema.fields if f.name not in on]
    order = [quoted(c) for c in [*left.columns, *extra]]
    has_key = reduce(and_, [quoted(c).isNotNull() for c in on])
    spread = F.pmod(F.xxhash64(*map(quoted, left.columns)), F.lit(PLACES))
    # Always -1, but not as a literal: the optimizer would take a literal out of the join key.
    found = F.pmod(F.xxhash64(*map(quoted, on)), F.lit(1)) - 1
    apart = left.withColumn("_place", F.when(has_key, F.lit(-1)).otherwise(spread).cast("bigint"))
    return apart.join(lookup.withColumn("_place", found), [*on, "_place"], "left").select(*order)
