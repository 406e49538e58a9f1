"""Text clean-up and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnaround.functions.numbers import number_text, to_double
from turnaround.schema import NA_TOKENS

_MARK = "\u0001"


def null_if_na(text: Column) -> Column:
    return F.when(~text.isin(NA_TOKENS), text)


def standardize(text: Column) -> Column:
    """Strip white space of every kind at both ends and upper-case."""
    return F.upper(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def zip_text(text: Column) -> Column:
    """Float text to a zip code of five digits or more: `7001.0` -> `07001`.

    Null when there is no number; callers that must tell junk from null use `zip_rejected`.
    """
    digits = to_double(text).try_cast("bigint").cast("string")
    return F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)


def zip_rejected(text: Column) -> Column:
    return text.isNotNull() & zip_text(text).isNull()


def title_label(label: Column) -> Column:
    """All-capitals labels in title case (new word after white space, `/` or `-`); others unchanged."""
    # initcap starts a word after a space only, so a marked space is put after each separator.
    spaced = F.regexp_replace(label, r"([\s/-])", rf"$1{_MARK} ")
    titled = F.replace(F.initcap(spaced), F.lit(f"{_MARK} "), F.lit(""))
    return F.when(label == F.upper(label), titled).otherwise(label)


def format_duration(hours: Column) -> Column:
    """`45 min` below an hour, `12.3 h` below two days, else `5.6 days`."""
    return (
        F.when(hours < 1, F.concat(number_text(hours * 60, 0), F.lit(" min")))
        .when(hours < 48, F.concat(number_text(hours, 1), F.lit(" h")))
        .otherwise(F.concat(number_text(hours / 24, 1), F.lit(" days")))
    )


def format_percent(part: Column) -> Column:
    """`9.2%` below a tenth, else `41%`."""
    percent = part * 100
    return F.concat(
        F.when(part < 0.1, number_text(percent, 1)).otherwise(number_text(percent, 0)), F.lit("%")
    )
