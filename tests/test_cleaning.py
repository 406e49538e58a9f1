import pytest
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.operators import cleaning
from turnaround.plans import catalog


def requests(spark, rows):
    """Typed raw rows from (key, created, closed, status); other columns null."""
    given = spark.createDataFrame(rows, "unique_key long, created string, closed string, status string")
    values = {
        "unique_key": F.col("unique_key"),
        "created_date": F.col("created").cast("timestamp_ntz"),
        "closed_date": F.col("closed").cast("timestamp_ntz"),
        "status": F.col("status"),
    }
    return given.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.RAW_SCHEMA])


EDGES = [
    (1, "2026-01-05 10:00:00", "2026-01-05 10:00:00", "CLOSED", "3 closed at or before creation"),
    (2, "2026-01-05 10:00:00", "2026-01-05 10:00:14.4", "CLOSED", "kept"),  # 0.004 h, stored as 0.00
    (3, "2026-01-05 00:00:00", "2027-01-05 00:00:00", "CLOSED", "kept"),  # 8760 h
    (4, "2026-01-05 00:00:00", "2027-01-05 00:00:00.36", "CLOSED", "5 over one year"),  # 8760.0001 h
    (5, "2026-03-03 00:00:00", "2026-03-03 01:00:00", "CLOSED", "kept"),
    (6, "2026-03-03 00:00:01", "2026-03-03 01:00:00", "CLOSED", "4 created outside window"),
    (7, "2026-01-01 00:00:00", "2026-01-01 01:00:00", "CLOSED", "kept"),
    (8, "2025-12-31 23:59:59", "2026-01-01 01:00:00", "CLOSED", "4 created outside window"),
    (9, "2026-01-05 10:00:00", None, "CLOSED", "1 no closed date"),
    (10, None, "2026-01-05 10:00:00", "CLOSED", "2 no created date"),
    (11, "2026-01-05 10:00:00", "2026-01-04 10:00:00", "CLOSED", "3 closed at or before creation"),
    (12, "2026-01-05 10:00:00", None, None, None),
    (13, "2026-01-05 10:00:00", "2026-01-06 10:00:00", "OPEN", None),
]


def test_boundaries(spark):
    raw = requests(spark, [r[:4] for r in EDGES])
    kept = {r.unique_key: r for r in cleaning.clean_requests(raw).collect()}
    assert set(kept) == {r[0] for r in EDGES if r[4] == "kept"}
    assert float(kept[2].resolution_hours) == 0.0 and float(kept[3].resolution_hours) == 8760.0
    assert kept[5].borough == "UNKNOWN" and kept[5].incident_zip == "00000" and kept[5].problem_type is None
    reasons = {}
    for r in EDGES:
        if r[4]:
            reasons[r[4]] = reasons.get(r[4], 0) + 1
    assert {r.rule: r.rows for r in cleaning.clean_rejects(raw).collect()} == reasons
    assert {r.unique_key for r in cleaning.open_requests(raw).collect()} == {12, 13}


def test_table_layouts(spark):
    raw = requests(spark, [r[:4] for r in EDGES])
    clean, opened = cleaning.clean_requests(raw), cleaning.open_requests(raw)
    assert len(clean.columns) == 31 and len(opened.columns) == 27
    assert {f.name: f.dataType for f in clean.schema} == {f.name: f.dataType for f in schema.CLEAN_SCHEMA}
    assert {f.name: f.dataType for f in opened.schema} == {f.name: f.dataType for f in schema.OPEN_SCHEMA}


def test_every_row_is_accounted_for(spark, sf_dir):
    raw = catalog.typed(spark, sf_dir)
    closed = sum(r.rows for r in cleaning.clean_rejects(raw, **catalog.WINDOW).collect())
    assert closed + cleaning.open_requests(raw).count() == raw.count()


def test_hours_do_not_depend_on_the_session_zone(spark):
    raw = requests(spark, [(1, "2026-03-07 12:00:00", "2026-03-08 12:00:00", "CLOSED")])  # a clock change
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert cleaning.with_hours(raw).first().hours == 24.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_duplicate_and_missing_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "unique_key long")
    assert {(r.unique_key, r.rows) for r in cleaning.duplicate_keys(df).collect()} == {(2, 2), (None, 1)}


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, sf_dir, parts):
    raw = catalog.typed(spark, sf_dir).repartition(parts)
    clean = cleaning.clean_requests(raw, **catalog.WINDOW)
    assert clean.count() == 554
