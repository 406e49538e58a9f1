"""Rounding, number text and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


READING = "decimal(38,12)"


def round_half_up(value: Column, digits: int) -> Column:
    """Round half up on the decimal reading of a number, so binary noise cannot flip a tie.

    Twelve decimals are read, beyond which a double of this size holds noise. NaN, infinity and
    numbers beyond that decimal's range are returned as they are.
    """
    rounded = F.round(value.try_cast(READING), digits).cast("double")
    return F.coalesce(rounded, value.cast("double"))


def number_text(value: Column, digits: int) -> Column:
    """A number as text with a fixed count of digits after the point; NaN, infinity and numbers that
    no decimal holds as Spark writes them."""
    text = F.round(value.try_cast(READING), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.coalesce(text, value.cast("string"))


def to_double(value: Column) -> Column:
    """Text or number to double; what does not parse becomes null."""
    return value.try_cast("double")


def to_whole(value: Column, kind: str = "bigint") -> Column:
    """Float text such as `12.0` to an integer type; fractions, overflow and junk become null.

    Digits are read as decimals, never through a double, so large keys stay what they are.
    """
    exact = value.try_cast("decimal(38,10)")
    whole = F.when(exact == F.floor(exact), exact.try_cast("decimal(28,0)"))
    return F.coalesce(value.try_cast("bigint") if kind == "bigint" else F.lit(None).cast(kind), whole.try_cast(kind))


def finite_or_null(value: Column) -> Column:
    """Infinity and NaN become null."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), value)


def hash_number(salt: str, key: Column) -> Column:
    """A whole number below 2^32 from a salted key: the same in any engine and any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def flag(condition: Column) -> Column:
    return condition.cast("int")


def share(condition: Column, digits: int = 3) -> Column:
    """Part of the rows that meet a condition; a null condition counts as not met."""
    return round_half_up(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), digits)
