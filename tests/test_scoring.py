import pytest
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.operators import modelling, scoring
from turnaround.streaming import scoring as stream

FEATURES = [
    "hour_of_day", "day_of_week", "month", "is_weekend", "is_night", "agency_HPD", "agency_NYPD",
    "borough_BRONX", "borough_BROOKLYN", "channel_MOBILE", "channel_ONLINE", "channel_PHONE",
    "problem_type_encoded", "location_type_encoded",
]
EXAMPLES = [
    ("noise", "NYPD", "BROOKLYN", "Noise - Residential", None, "MOBILE", 23, 5, 1),
    ("heat", "hpd", "Bronx", "HEAT/HOT WATER", None, "PHONE", 9, 0, 1),
    ("parking", "NYPD", "MANHATTAN", "Illegal Parking", None, None, 14, 2, 2),
    ("bad agency", "XX", "BRONX", "p", None, None, 14, 2, 2),
    ("bad hour", "HPD", "BRONX", "p", None, None, 24, 2, 2),
    ("bad all", None, "NOWHERE", None, None, None, -1, 7, 0),
]
LAYOUT = "name string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.REQUEST_SCHEMA)


@pytest.fixture(scope="module")
def encoding(spark):
    rows = [("problem_type", "Noise - Residential", 1.0), ("problem_type", "HEAT/HOT WATER", 4.0), ("location_type", "UNKNOWN", 2.5), (None, None, 2.0)]
    return spark.createDataFrame(rows, "`column` string, category string, encoding double").cache()


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(EXAMPLES, LAYOUT)


def test_validation(examples):
    errors = {r["name"]: r.errors for r in scoring.validate_requests(examples).collect()}
    assert errors["noise"] == errors["heat"] == errors["parking"] == ""
    assert errors["bad agency"] == "invalid agency 'XX'"
    assert errors["bad hour"] == "hour_of_day must be 0 to 23"
    assert errors["bad all"] == (
        "invalid agency ''; invalid borough 'NOWHERE'; problem_type is missing; hour_of_day must be 0 to 23; "
        "day_of_week must be 0 to 6; month must be 1 to 12"
    )


def test_feature_rows(examples, encoding):
    valid, _ = scoring.split_valid(examples)
    prepared = scoring.prepare_requests(valid, encoding, FEATURES)
    assert [c for c in prepared.columns if c in FEATURES and c not in schema.REQUEST_SCHEMA.names] == FEATURES[3:]
    rows = {r["name"]: [r[c] for c in FEATURES] for r in prepared.collect()}
    assert rows["noise"] == [23, 5, 1, 1, 1, 0, 1, 0, 1, 1, 0, 0, 1.0, 2.5]
    assert rows["heat"] == [9, 0, 1, 0, 0, 1, 0, 1, 0, 0, 0, 1, 4.0, 2.5]
    assert rows["parking"] == [14, 2, 2, 0, 0, 0, 1, 0, 0, 0, 1, 0, 2.0, 2.5]  # unseen type, unsaved borough


def test_answers(examples, encoding):
    answers, rejected = scoring.score_requests(examples, modelling.baseline(), encoding, FEATURES, 34.3)
    found = {r["name"]: r for r in answers.collect()}
    assert set(found) == {"noise", "heat", "parking"} and rejected.count() == 3
    noise, heat = found["noise"], found["heat"]
    assert (noise.predicted_hours, noise.predicted_days, noise.confidence_band) == (1.7, 0.1, "0.0h – 36.0h")
    assert noise.summary == "Expected to resolve in under 2 hours."
    assert (heat.predicted_hours, heat.confidence_band) == (53.6, "19.3h – 87.9h")
    assert heat.summary == "Expected to resolve in 2.2 days (~54 hours)."
    assert heat.inputs.borough == "Bronx" and found["parking"].inputs.channel is None


def test_forms(spark, encoding):
    forms = spark.createDataFrame(
        [
            ("ok", "HEAT/HOT WATER", "BRONX", "PHONE", 9, "Monday", 1),
            ("late", "Noise - Residential", "BROOKLYN", "MOBILE", 23, "Saturday", 1),
            ("unknown", "Something", "QUEENS", "OTHER", 0, "Sunday", 2),
            ("gaps", "", None, "PHONE", None, "", 1),
        ],
        "name string, problem_type string, borough string, channel string, hour int, day string, month int",
    )
    prepared = {r["name"]: r for r in scoring.prepare_forms(forms.where("name <> 'gaps'"), encoding, FEATURES).collect()}
    assert prepared["ok"].agency_HPD == 1 and prepared["ok"].day_of_week == 0
    assert (prepared["late"].is_weekend, prepared["late"].is_night, prepared["late"].agency_NYPD) == (1, 1, 1)
    assert (prepared["unknown"].agency, prepared["unknown"].agency_HPD, prepared["unknown"].problem_type_encoded) == ("", 0, 2.0)
    assert {r.location_type_encoded for r in prepared.values()} == {2.0}
    answers, incomplete = scoring.score_forms(forms, modelling.baseline(), encoding, FEATURES, 34.3)
    assert {r["name"]: r.verdict for r in answers.collect()} == {"ok": "🟠 A Few Days", "late": "🟢 Very Fast", "unknown": "🟡 Same Day"}
    assert incomplete.first().missing == "Problem Type, Borough, Day of Week, Hour of Day"


def test_unreadable_answers_are_reported(spark, encoding):
    forms = spark.createDataFrame(
        [("day", "Boilers", "BRONX", "PHONE", "9", "Someday", "1"), ("hour", "Boilers", "BRONX", "PHONE", "nine", "Monday", "1")],
        "name string, problem_type string, borough string, channel string, hour string, day string, month string",
    )
    answers, incomplete = scoring.score_forms(forms, modelling.baseline(), encoding, FEATURES, 34.3)
    assert answers.count() == 0
    assert {r["name"]: r.missing for r in incomplete.collect()} == {"day": "Day of Week", "hour": "Hour of Day"}


def test_stream_answers_each_request_once(spark, encoding, tmp_path, examples):
    arriving, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    valid = examples.where(F.col("name").isin("noise", "heat"))
    valid.write.parquet(arriving)

    def run():
        requests = stream.read_requests(spark, arriving, examples.schema)
        stream.start_scoring(requests, modelling.baseline(), encoding, FEATURES, 34.3, out, state).awaitTermination()
        return sorted(r["name"] for r in spark.read.parquet(out).collect())

    assert run() == ["heat", "noise"]
    assert run() == ["heat", "noise"]
    examples.where(F.col("name").isin("parking", "bad hour")).write.mode("append").parquet(arriving)
    assert run() == ["bad hour", "heat", "noise", "parking"]
    answers = {r["name"]: r for r in spark.read.parquet(out).collect()}
    assert "hour_of_day must be 0 to 23" in answers["bad hour"].errors and answers["bad hour"].predicted_hours is None
    assert answers["heat"].errors == "" and answers["heat"].predicted_hours is not None


def test_a_batch_cut_short_is_played_again_in_its_place(spark, encoding, tmp_path, examples):
    arriving, answers, refusals, state = (str(tmp_path / d) for d in ("in", "answers", "refusals", "state"))

    def run():
        requests = stream.read_requests(spark, arriving, examples.schema)
        stream.start_publishing(
            requests, modelling.baseline(), encoding, FEATURES, 34.3, answers, refusals, state
        ).awaitTermination()
        return [sorted(r["name"] for r in spark.read.parquet(d).collect()) for d in (answers, refusals)]

    examples.where(F.col("name").isin("noise", "bad hour")).write.parquet(arriving)
    assert run() == [["noise"], ["bad hour"]]
    examples.where(F.col("name").isin("heat", "bad all")).write.mode("append").parquet(arriving)
    # A batch that wrote its answers but died before its refusals, so that its commit is missing.
    kept = stream.score_requests
    try:
        def broken(*args):
            found, refused = kept(*args)
            return found, refused.select(F.raise_error(F.lit("executor lost")).alias("errors"))
        stream.score_requests = broken
        with pytest.raises(Exception, match="executor lost"):
            run()
    finally:
        stream.score_requests = kept
    assert sorted(r["name"] for r in spark.read.parquet(answers).collect()) == ["heat", "noise"]
    assert run() == [["heat", "noise"], ["bad all", "bad hour"]]
    assert run() == [["heat", "noise"], ["bad all", "bad hour"]]


def test_known_agencies(spark):
    df = spark.createDataFrame([("Boilers",), ("boilers",), (None,)], "problem_type string")
    assert [r.agency for r in scoring.lookup_agency(df).collect()] == ["DOB", "", ""]
    assert len(schema.PROBLEM_AGENCY) == 29
