import json
import os

import pytest
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.operators import cleaning, evaluation, findings, profiling
from turnaround.plans import batch, catalog
from turnaround.sources import exports, storage

HEADERS = [*schema.RENAMES, *schema.DROPPED]


def write_export(path, rows):
    """A CSV file with the export's header; each row is a dict of header -> raw CSV field."""
    lines = [",".join(HEADERS)] + [",".join(r.get(h, "") for h in HEADERS) for r in rows]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture()
def folder(tmp_path):
    first = {
        "Unique Key": "1",
        "Created Date": "01/15/2026 11:22:33 PM",
        "Closed Date": "2026-01-16 10:00:00",
        "Agency": "\t hpd ",
        "Problem (formerly Complaint Type)": '"Broken ""door""\nback, left"',
        "Incident Zip": "7001.0",
        "Council District": "12.0",
        "BBL": "N/A",
        "City": "nan",
        "X Coordinate (State Plane)": "abc",
        "Latitude": "40.1234567",
        "Location": "dropped",
    }
    second = {"Unique Key": "2", "Incident Zip": "abc", "Status": "NULL", "Council District": "70000", "Created Date": "12/31/2025 12:00:00 AM"}
    write_export(tmp_path / "a.csv", [first])
    write_export(tmp_path / "b.csv", [second])
    (tmp_path / "notes.txt").write_text("not a table")
    return str(tmp_path)


def test_export_to_typed_rows(spark, folder):
    raw = exports.conform_raw(exports.read_export(spark, folder, multi_line=True))
    assert [(f.name, f.dataType) for f in raw.schema] == [(f.name, f.dataType) for f in schema.RAW_SCHEMA]
    one, two = raw.orderBy("unique_key").collect()
    assert str(one.created_date) == "2026-01-15 23:22:33"
    assert str(two.created_date) == "2025-12-31 00:00:00"
    assert one.agency == "HPD"
    assert one.problem_type == 'Broken "door"\nback, left'
    assert one.incident_zip == "07001" and two.incident_zip is None
    assert one.council_district == 12 and two.council_district is None
    assert one.bbl is None and one.city is None and two.status is None
    assert one.x_coordinate is None and str(one.latitude) == "40.1234567"


def test_lost_cells_are_reported(spark, folder):
    lost = exports.conform_rejects(exports.read_export(spark, folder, multi_line=True)).collect()
    assert {(r.unique_key, r.column_name, r.text) for r in lost} == {
        ("1", "x_coordinate", "abc"), ("2", "incident_zip", "abc"), ("2", "council_district", "70000"),
    }


def test_findings_columns_are_pruned(spark, folder):
    short = exports.read_findings_export(spark, folder, multi_line=True)
    assert short.columns == list(exports.FINDINGS_COLUMNS.values())
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "Incident Zip" not in plan
    assert sorted(r.agency or "" for r in short.collect()) == ["", "HPD"]


def test_folder_without_csv(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a")
    with pytest.raises(FileNotFoundError):
        exports.read_export(spark, str(tmp_path))


def test_broken_records_are_kept_and_reported_when_files_are_split(spark, folder):
    rows = exports.read_export(spark, folder).collect()
    broken = [r for r in rows if r[exports.CORRUPT]]
    assert len(rows) == 3 and len(broken) == 2
    assert "Broken" in broken[0][exports.CORRUPT] + broken[1][exports.CORRUPT]
    whole = exports.read_export(spark, folder, multi_line=True).collect()
    assert len(whole) == 2 and not any(r[exports.CORRUPT] for r in whole)


@pytest.mark.parametrize("multi_line", [False, True])
def test_each_file_is_read_under_its_own_header(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text('Agency,Borough,City\nHPD,BRONX,"says ""hi"", there"\n')
    (tmp_path / "b.csv").write_text("Borough,Agency,City\nQUEENS,NYPD,x\n")
    (tmp_path / "c.csv").write_text("\ufeffAgency,More\nDOT,extra\n")
    rows = {r.Agency: r for r in exports.read_export(spark, str(tmp_path), multi_line).collect()}
    assert {a: (r.Borough, r.City, r.More) for a, r in rows.items()} == {
        "HPD": ("BRONX", 'says "hi", there', None), "NYPD": ("QUEENS", "x", None), "DOT": (None, None, "extra"),
    }


def test_drop_ignores_absent_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, Location int")
    assert exports.drop_columns(df).columns == ["a"]


def test_mixed_dates(spark):
    cases = {
        "01/15/2026 11:22:33 PM": "2026-01-15 23:22:33",
        "1/5/2026 12:00:00 AM": "2026-01-05 00:00:00",
        "01/05/2026 12:30 PM": "2026-01-05 12:30:00",
        "01/05/2026": "2026-01-05 00:00:00",
        "2026-01-05 10:00:00": "2026-01-05 10:00:00",
        "2026-01-05T10:00:00.250": "2026-01-05 10:00:00.250000",
        "2026-01-05": "2026-01-05 00:00:00",
        "13/01/2026 10:00:00 AM": None,
        "01/05/2026 13:00:00 PM": None,
        "02/30/2026": None,
        "soon": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("p", F.col("t"))
    for row in exports.parse_timestamps(df, ["p"]).collect():
        assert (None if row.p is None else str(row.p)) == cases[row.t], row.t


def test_write_replaces_and_scan_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.write_table(spark.range(5), path)
    storage.write_table(spark.range(3), path)
    assert storage.scan_table(spark, path).count() == 3


def test_list_columns_and_types(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert [tuple(r) for r in storage.list_columns(df).collect()] == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in profiling.profile_dtypes(df).collect()] == [("x", "int"), ("y", "string")]


def test_run_sql_leaves_no_view(spark):
    assert storage.run_sql(spark, "SELECT count(*) AS n FROM {t}", {"t": spark.range(4)}).first().n == 4
    assert not spark.catalog.listTables()


def test_shared_folder_follows_the_session():
    class Session:
        """Stands in for a cluster session; only settings are read."""

        def __init__(self, **settings):
            self.conf = settings

    named = {"spark.checkpoint.dir": "hdfs://shared/checkpoints/", "spark.sql.warehouse.dir": "hdfs://warehouse"}
    assert storage.shared_folder(Session(**named)) == "hdfs://shared/checkpoints"
    assert storage.shared_folder(Session(**{"spark.sql.warehouse.dir": "hdfs://warehouse"})) == "hdfs://warehouse"


def test_stored_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda session: str(tmp_path / "apart"))
    assert storage.materialize(spark.range(3), "x").count() == 3 and os.listdir(tmp_path / "apart")
    storage.drop_stored(spark)
    assert not os.listdir(tmp_path / "apart")


def test_findings_document_round_trip(spark, sf_dir, tmp_path):
    document = storage.materialize(findings.findings_document(catalog.base(spark, sf_dir)), "findings")
    path = str(tmp_path / "findings")
    findings.write_document(document, path)
    read = spark.read.schema(document.schema).json(path, multiLine=True)
    assert read.collect() == document.collect()
    parsed = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    assert sum(r["count"] for r in parsed["by_channel"]) <= parsed["total"]


def test_metrics_document_round_trip(spark, tmp_path):
    tidy = spark.createDataFrame(
        [("validation", "A", "r2", 0.5), ("validation", "A", "mae_hours", 2.0), ("validation", "A", "rmse_hours", 3.0),
         ("validation", "B", "r2", 0.6), ("validation", "B", "mae_hours", 1.0), ("validation", "B", "rmse_hours", 4.0),
         ("test", "B", "r2", 0.55), ("test", "B", "mae_hours", 1.5), ("test", "B", "rmse_hours", 4.5),
         ("deployed", "S", "r2", 0.4), ("deployed", "S", "mae_hours", 2.5)],
        "stage string, model string, metric string, value double",
    )
    path = str(tmp_path / "metrics")
    findings.write_document(evaluation.metrics_document(tidy, 10, "B"), path)
    read = evaluation.read_metrics(spark, path)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, tidy.collect()))
    assert evaluation.error_band(read) == 2.5
    assert evaluation.best_model(evaluation.compare_models(tidy, ["A", "B"])) == "B"
    update = spark.createDataFrame([("deployed", "S", "r2", 0.9)], tidy.schema)
    merged = {(r.stage, r.model, r.metric): r.value for r in evaluation.merge_metrics(tidy, update).collect()}
    assert merged[("deployed", "S", "r2")] == 0.9 and len(merged) == 11


def test_first_model_wins_a_tie(spark):
    tidy = spark.createDataFrame(
        [("validation", m, k, 0.5) for m in ("Z", "A") for k in evaluation.METRICS],
        "stage string, model string, metric string, value double",
    )
    assert evaluation.best_model(evaluation.compare_models(tidy, ["Z", "A"])) == "Z"


def test_constraint_report_is_empty_for_typed_rows(spark, sf_dir):
    report = cleaning.constraint_violations(catalog.typed(spark, sf_dir))
    assert {r.violations for r in report.collect()} == {0}


@pytest.mark.parametrize("columns", [["Unique Key"], ["Agency", "Status"], HEADERS])
def test_broken_records_are_marked_whichever_columns_are_read(spark, folder, columns):
    marked = exports.read_export(spark, folder).select(*[F.col(f"`{c}`") for c in columns], exports.CORRUPT)
    assert sum(r[exports.CORRUPT] is not None for r in marked.collect()) == 2
    assert exports.read_findings_export(spark, folder).count() == 1


def test_broken_records_go_to_quarantine(spark, folder, tmp_path):
    table = str(tmp_path / "raw")
    raw = batch.load_raw(spark, folder, table)
    assert [r.unique_key for r in raw.collect()] == [2] and raw.columns == schema.RAW_SCHEMA.names
    broken = [r.record for r in storage.scan_table(spark, f"{table}_quarantine").collect()]
    assert len(broken) == 2 and sum("Broken" in b for b in broken) == 1
    with pytest.raises(batch.LoadRefused) as refused:
        batch.load_raw(spark, folder, table, most_broken=1)
    assert refused.value.found == {"broken records": 2}
    assert batch.load_raw(spark, folder, table, multi_line=True, most_broken=0).count() == 2
    assert storage.scan_table(spark, table).count() == 2


def test_a_load_that_breaks_rules_is_not_seen(spark, sf_dir, tmp_path):
    path, rows = str(tmp_path / "raw"), catalog.typed(spark, sf_dir).limit(50)
    batch.gated_publish(rows, path)
    bad = rows.withColumn("unique_key", F.when(F.col("unique_key") % 2 == 0, F.col("unique_key")))
    long = rows.withColumn("agency", F.repeat(F.lit("x"), 500))
    for frame, name in [(rows.unionByName(rows), "repeated keys"), (bad, "null keys"), (long, "limit of agency")]:
        with pytest.raises(batch.LoadRefused) as refused:
            batch.gated_publish(frame, path)
        assert list(refused.value.found) == [name] and refused.value.found[name] > 0
        assert storage.scan_table(spark, path).count() == 50
    assert batch.gated_publish(rows.limit(20), path).count() == storage.scan_table(spark, path).count() == 20


def test_a_write_that_fails_midway_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.publish_table(spark.range(5), path)
    broken = spark.range(100, numPartitions=8).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        storage.publish_table(broken, path)
    assert storage.scan_table(spark, path).count() == 5
    for n in (7, 8, 9):
        storage.publish_table(spark.range(n), path)
        assert storage.scan_table(spark, path).count() == n
    beside = [f for f in os.listdir(tmp_path) if f.startswith("t.")]
    assert len(beside) == 1 and beside[0].startswith("t.old-")
    os.rename(path, f"{path}.lost")  # a swap cut short after its first step
    assert storage.scan_table(spark, path).count() == 8


@pytest.mark.parametrize("n", [1, 7, 400])
def test_samples_order_only_what_lies_below_a_cutoff(spark, n):
    df = spark.range(70000, numPartitions=500).withColumnRenamed("id", "unique_key")
    place = profiling.sample_order("unique_key", 42)
    expected = [r.unique_key for r in df.orderBy(place, "unique_key").limit(n).collect()]
    assert [r.unique_key for r in profiling.first_by_hash(df, n).collect()] == expected
    cut = profiling._hash_cutoff(df.select(place.alias("place")), n)
    assert n <= df.where(F.substring(place, 1, len(cut)) <= cut).count() <= 2 * n
    few = spark.createDataFrame([(None,), (3,), (3,), (1,)], "unique_key long")
    assert profiling.first_by_hash(few, 9).count() == 4 and profiling.first_by_hash(few, 1).first().unique_key is None


def test_tables_laid_out_by_key_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    left = storage.write_by_key(rows, str(tmp_path / "left"), "k", 4)
    storage.write_by_key(rows.withColumnRenamed("v", "w"), str(tmp_path / "right"), "k", 4)
    spark.sql(f"DROP TABLE {storage._table_name(str(tmp_path / 'right'))}")
    right = storage.scan_by_key(spark, str(tmp_path / "right"), "k", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = left.join(right, "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 1000 and joined.where("v = w").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
