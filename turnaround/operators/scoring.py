"""Scoring requests in bulk: checks, features, prediction, texts. Works on batch and streaming frames."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.functions.dates import is_night, is_weekend
from turnaround.functions.numbers import flag, number_text, round_half_up
from turnaround.operators.encoding import apply_encoding, global_mean
from turnaround.operators.joins import quoted

REQUEST = [f.name for f in schema.REQUEST_SCHEMA.fields]


def with_defaults(requests: DataFrame) -> DataFrame:
    """Missing or empty location and channel get their defaults."""
    def default(c: str, value: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value))

    return requests.withColumns(
        {"location_type": default("location_type", schema.UNKNOWN), "channel": default("channel", "ONLINE")}
    )


def request_errors() -> Column:
    """All reasons a request is refused, joined; empty text if none. Nulls are refused too."""
    def outside(c: str, low: int, high: int) -> Column:
        return F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), f"{c} must be {low} to {high}")

    def unknown(c: str, allowed: list[str]) -> Column:
        known = F.coalesce(F.upper(c).isin(allowed), F.lit(False))
        return F.when(~known, F.concat(F.lit(f"invalid {c} '"), F.coalesce(c, F.lit("")), F.lit("'")))

    checks = [
        unknown("agency", schema.AGENCIES),
        unknown("borough", schema.BOROUGHS),
        F.when(F.col("problem_type").isNull(), "problem_type is missing"),
        outside("hour_of_day", 0, 23),
        outside("day_of_week", 0, 6),
        outside("month", 1, 12),
    ]
    return F.array_join(F.array_compact(F.array(*checks)), "; ")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with their `errors` text (empty when valid)."""
    return requests.withColumn("errors", request_errors())


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_requests(requests)
    return checked.where(F.col("errors") == "").drop("errors"), checked.where(F.col("errors") != "")


def missing_fields(forms: DataFrame, fields: dict[str, str] = schema.FORM_FIELDS) -> DataFrame:
    """Shown names of the fields to fill in, in report order, joined; empty text if none.

    A day that is no day name and an hour or month that is no whole number count as missing.
    """
    readable = {"day": day_index, "hour": _whole, "month": _whole}

    def empty(c: str) -> Column:
        value = F.col(c)
        lacking = value.isNull() | (value.cast("string") == "")
        return lacking | readable[c](value).isNull() if c in readable else lacking

    gaps = [F.when(empty(c), name) for c, name in fields.items()]
    return forms.withColumn("missing", F.array_join(F.array_compact(F.array(*gaps)), ", "))


def _whole(value: Column) -> Column:
    return value.try_cast("int")


def _request_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"is_weekend": flag(is_weekend(F.col("day_of_week"))), "is_night": flag(is_night(F.col("hour_of_day")))}
    )


def _one_hot_saved(features: list[str], sources: dict[str, Column]) -> dict[str, Column]:
    """Saved one-hot columns from upper-cased request fields; an unknown value leaves all at 0."""
    found = {}
    for name in features:
        for prefix, value in sources.items():
            if name.startswith(f"{prefix}_"):
                found[name] = F.coalesce(flag(F.upper(value) == name[len(prefix) + 1 :]), F.lit(0))
    return found


def _model_row(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    present = set(df.columns)
    columns = [quoted(c) if c in present else F.lit(0).alias(c) for c in features]
    return df.select(*map(quoted, keep), *[c for c, name in zip(columns, features) if name not in keep])


def prepare_requests(requests: DataFrame, encoding: DataFrame, features: list[str]) -> DataFrame:
    """Requests beside the saved feature columns a model expects, in saved order."""
    filled = _request_flags(with_defaults(requests))
    kept = {f"_{c}": F.col(c) for c in schema.ENCODED}
    hot = _one_hot_saved(features, {"agency": F.col("agency"), "borough": F.col("borough"), "channel": F.col("channel")})
    encoded = apply_encoding(filled.withColumns(kept | hot), encoding).withColumnsRenamed({f"_{c}": c for c in schema.ENCODED})
    return _model_row(encoded, features, requests.columns)


def lookup_agency(df: DataFrame, mapping: dict[str, str] = schema.PROBLEM_AGENCY) -> DataFrame:
    """Agency that handles the problem type, empty text when none is known.

    The 29 fixed pairs are a literal map, so no join is needed.
    """
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn("agency", F.coalesce(F.try_element_at(pairs, F.col("problem_type")), F.lit("")))


def day_index(day: Column) -> Column:
    """Monday = 0; an unknown name gives null."""
    place = F.array_position(F.array(*[F.lit(d) for d in schema.DAY_NAMES]), day)
    return F.when(place > 0, (place - 1).cast("int"))


def prepare_forms(forms: DataFrame, encoding: DataFrame, features: list[str]) -> DataFrame:
    """Form answers beside the saved feature columns: agency by problem type, location unknown to the
    encoding, day given by name."""
    requests = lookup_agency(forms).withColumns(
        {
            "hour_of_day": _whole(F.col("hour")),
            "day_of_week": day_index(F.col("day")),
            "month": _whole(F.col("month")),
            "location_type": F.lit(None).cast("string"),
            "_problem": F.col("problem_type"),
        }
    )
    hot = _one_hot_saved(features, {"agency": F.col("agency"), "borough": F.col("borough"), "channel": F.col("channel")})
    encoded = apply_encoding(_request_flags(requests).withColumns(hot), encoding, ["problem_type"])
    encoded = encoded.withColumn("location_type_encoded", F.lit(global_mean(encoding))).withColumnRenamed("_problem", "problem_type")
    return _model_row(encoded, features, [*forms.columns, "agency"])


def band(hours: Column, mae: float) -> tuple[Column, Column]:
    low = F.when(hours.isNotNull(), F.greatest(F.lit(0.0), round_half_up(hours - mae, 1)))
    return low, round_half_up(hours + mae, 1)


def band_text(hours: Column, mae: float) -> Column:
    low, high = band(hours, mae)
    return F.concat(number_text(low, 1), F.lit("h – "), number_text(high, 1), F.lit("h"))


def days(hours: Column) -> Column:
    return round_half_up(hours / 24, 1)


def summary(hours: Column) -> Column:
    about = F.concat(F.lit("(~"), number_text(hours, 0), F.lit(" hours)"))
    in_days = F.concat(number_text(hours / 24, 1), F.lit(" days "))
    return (
        F.when(hours < 2, "Expected to resolve in under 2 hours.")
        .when(hours < 24, F.concat(F.lit("Expected to resolve within the same day "), about, F.lit(".")))
        .when(hours < 72, F.concat(F.lit("Expected to resolve in "), in_days, about, F.lit(".")))
        .otherwise(F.concat(F.lit("Expected to take "), in_days, about, F.lit(" to resolve.")))
    )


def verdict(hours: Column) -> Column:
    (bound, label), *rest = schema.VERDICTS
    start = F.when(hours.isNull(), F.lit(None)).when(hours < bound, label)
    return reduce(lambda chain, v: chain.when(hours < v[0], v[1]), rest, start).otherwise(schema.LAST_VERDICT)


def responses(scored: DataFrame, mae: float) -> DataFrame:
    """Answer columns for rows with a log-scale `prediction`; `inputs` holds what was given."""
    hours = F.col("_hours")
    return scored.withColumn("_hours", F.expm1("prediction")).withColumns(
        {
            "predicted_hours": round_half_up(hours, 1),
            "predicted_days": days(hours),
            "confidence_band": band_text(hours, mae),
            "summary": summary(hours),
            "verdict": verdict(hours),
        }
    )


ANSWER = ["predicted_hours", "predicted_days", "confidence_band", "summary", "inputs"]


def score_requests(
    requests: DataFrame, model: PipelineModel, encoding: DataFrame, features: list[str], mae_hours: float
) -> tuple[DataFrame, DataFrame]:
    """Answers for valid requests, and the refused ones with their reasons.

    Extra columns of the requests (such as an id) are carried along. `inputs` echoes the request as
    given, before defaults.
    """
    valid, rejected = split_valid(requests.withColumn("inputs", F.struct(*REQUEST)))
    scored = model.transform(prepare_requests(valid, encoding, features))
    extra = [c for c in requests.columns if c not in REQUEST]
    return responses(scored, mae_hours).select(*extra, *ANSWER), rejected.drop("inputs")


def answer_requests(
    requests: DataFrame, model: PipelineModel, encoding: DataFrame, features: list[str], mae_hours: float
) -> DataFrame:
    """One answer per request: the answer columns, or the reasons of a refusal in `errors` (else empty)."""
    answers, refused = score_requests(requests, model, encoding, features, mae_hours)
    extra = [c for c in requests.columns if c not in REQUEST]
    reasons = refused.select(*extra, "errors", F.struct(*REQUEST).alias("inputs"))
    return answers.withColumn("errors", F.lit("")).unionByName(reasons, allowMissingColumns=True)


def score_forms(
    forms: DataFrame, model: PipelineModel, encoding: DataFrame, features: list[str], mae_hours: float
) -> tuple[DataFrame, DataFrame]:
    """Answers with verdict for complete forms, and the incomplete ones with the missing fields."""
    checked = missing_fields(forms)
    complete = checked.where(F.col("missing") == "").drop("missing").withColumn("inputs", F.struct(*schema.FORM_FIELDS))
    scored = model.transform(prepare_forms(complete, encoding, features))
    extra = [c for c in forms.columns if c not in schema.FORM_FIELDS]
    answers = responses(scored, mae_hours).select(*extra, "agency", "verdict", *ANSWER)
    return answers, checked.where(F.col("missing") != "")
