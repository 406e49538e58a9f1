import pytest
from pyspark.sql import functions as F

from turnaround.functions import numbers, text
from turnaround.operators import reshape, scoring


def apply(spark, kind, cases, fn):
    """Results of a column function per input, in order."""
    rows = [(i, c) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, kind, cases",
    [
        (text.format_duration, "double", {0.0: "0 min", 0.5: "30 min", 0.99: "59 min", 1.0: "1.0 h", 12.34: "12.3 h", 47.9: "47.9 h", 48.0: "2.0 days", 60.0: "2.5 days", None: None}),
        (text.format_percent, "double", {0.092: "9.2%", 0.1: "10%", 0.411: "41%", 0.005: "0.5%", 1.0: "100%", None: None}),
        (text.title_label, "string", {"HEAT/HOT WATER": "Heat/Hot Water", "STATEN ISLAND": "Staten Island", "Noise - Residential": "Noise - Residential", "A-B c": "A-B c", "STREET-SIDE\tX": "Street-Side\tX", "": "", None: None}),
        (text.zip_text, "string", {"7001.0": "07001", "10001": "10001", "1234567": "1234567", "abc": None, "": None, None: None, "0.0": "00000"}),
        (text.standardize, "string", {" \t hpd\r\n": "HPD", "new  york": "NEW  YORK", "Closed\u00a0": "CLOSED", "\u3000x\x0b\x85": "X", None: None}),
        (text.null_if_na, "string", {"N/A": None, "NULL": None, "nan": None, "": None, "None": None, "na": "na", "x": "x", None: None}),
        (lambda c: numbers.round_half_up(c, 1), "double", {0.05: 0.1, 0.25: 0.3, 1.005: 1.0, 2.449999999999: 2.4, 0.0499999999: 0.0, 1e13: 1e13, 1e40: 1e40, float('inf'): float('inf'), -0.05: -0.1, None: None}),
        (lambda c: numbers.round_half_up(c, 2), "double", {1.005: 1.01, 2.675: 2.68}),
        (lambda c: numbers.to_whole(c, "smallint"), "string", {"12.0": 12, "12.5": None, "40000": None, "x": None, "-3": -3, None: None}),
        (numbers.to_whole, "string", {"9007199254740993": 9007199254740993, "9007199254740993.0": 9007199254740993, "1e3": 1000, "9223372036854775808": None, "7.5": None, "nan": None, "": None, None: None}),
        (lambda c: numbers.number_text(c, 1), "double", {1e13: "10000000000000.0", 2.4999996: "2.5", float("inf"): "Infinity", None: None}),
        (numbers.finite_or_null, "double", {float("inf"): None, float("-inf"): None, 2.0: 2.0, None: None}),
        (reshape.dow_label, "int", {0: "Sun", 6: "Sat", 7: None, -1: None, None: None}),
        (scoring.day_index, "string", {"Monday": 0, "Sunday": 6, "Funday": None, None: None}),
        (scoring.verdict, "double", {1.99: "🟢 Very Fast", 2.0: "🟡 Same Day", 23.99: "🟡 Same Day", 24.0: "🟠 A Few Days", 71.99: "🟠 A Few Days", 72.0: "🔴 Slow"}),
        (scoring.summary, "double", {
            1.99: "Expected to resolve in under 2 hours.",
            2.0: "Expected to resolve within the same day (~2 hours).",
            23.99: "Expected to resolve within the same day (~24 hours).",
            24.0: "Expected to resolve in 1.0 days (~24 hours).",
            71.99: "Expected to resolve in 3.0 days (~72 hours).",
            72.0: "Expected to take 3.0 days (~72 hours) to resolve.",
        }),
        (lambda c: scoring.band_text(c, 34.3), "double", {10.0: "0.0h – 44.3h", 100.04: "65.7h – 134.3h", 34.3: "0.0h – 68.6h"}),
    ],
)
def test_table(spark, fn, kind, cases):
    assert apply(spark, kind, list(cases), fn) == list(cases.values())


def test_rejected_zip(spark):
    assert apply(spark, "string", ["abc", None, "7001.0"], text.zip_rejected) == [True, False, False]
