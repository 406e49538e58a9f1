"""Registered queries: every operator over the driver's tables, whole, for a check by value.

Each query takes `(spark, sf_dir)`. `oracle.py` holds the same questions as SQL for a second engine.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnaround import schema
from turnaround.functions import dates, numbers, text
from turnaround.operators import (
    analysis,
    cleaning,
    encoding,
    evaluation,
    features,
    findings,
    modelling,
    profiling,
    reshape,
    scoring,
)
from turnaround.plans import batch
from turnaround.sources import exports, fixture, storage
from turnaround.streaming import scoring as stream

Query = Callable[[SparkSession, str], DataFrame]
WINDOW = {"start": fixture.WINDOW[0], "end": fixture.WINDOW[1]}
MIN_SEGMENT_ROWS = 100
_registered: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _registered[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_registered)


# --- Shared tables ----------------------------------------------------------------------------


def typed(spark: SparkSession, sf_dir: str, place: bool = True) -> DataFrame:
    return cleaning.zip_and_text(fixture.requests_raw(spark, sf_dir, place))


def clean(spark: SparkSession, sf_dir: str, place: bool = True) -> DataFrame:
    return cleaning.clean_requests(typed(spark, sf_dir, place), **WINDOW)


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.normalize_na(fixture.requests_export(spark, sf_dir))


def short_requests(spark: SparkSession, sf_dir: str, place: bool = True) -> DataFrame:
    names = {
        "unique_key": "unique_key",
        "created_date": "created",
        "closed_date": "closed",
        "agency": "agency",
        "problem_type": "problem",
        "borough": "borough",
        "status": "status",
        "open_data_channel_type": "channel",
    }
    return typed(spark, sf_dir, place).select(*[F.col(a).alias(b) for a, b in names.items()])


def base(spark: SparkSession, sf_dir: str, place: bool = True) -> DataFrame:
    return findings.findings_base(short_requests(spark, sf_dir, place), **WINDOW)


def stored_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean columns features are made of, stored: one-hot columns are known only after a first
    read, and models read the rows many times."""
    columns = ["unique_key", "created_date", "resolution_hours", "agency_name", *schema.ENCODED, *schema.ONE_HOT]
    return storage.materialize(clean(spark, sf_dir).select(*columns), "clean")


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.request_features(stored_clean(spark, sf_dir))


def encoder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, target, the two raw categoricals and the split."""
    logged = features.fill_unknown(features.log_target(clean(spark, sf_dir)))
    return encoding.with_split(logged.select("unique_key", schema.TARGET, *schema.ENCODED))


def of_splits(rows: DataFrame, *splits: str) -> DataFrame:
    return rows.where(F.col("split").isin(*splits)).drop("split")


def fitted(rows: DataFrame, *splits: str) -> DataFrame:
    return storage.materialize(encoding.fit_encoding(of_splits(rows, *splits)), "encoding")


def baseline_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows predicted by the encoded problem type, fitted on the other splits."""
    rows = storage.materialize(encoder_rows(spark, sf_dir), "encoder-rows")
    return baseline_of(rows, fitted(rows, "train", "validation"))


def baseline_of(rows: DataFrame, table: DataFrame) -> DataFrame:
    return modelling.baseline().transform(encoding.apply_encoding(of_splits(rows, "test"), table))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.predictions_table(baseline_scored(spark, sf_dir))


def feature_names(table: DataFrame) -> list[str]:
    """What a model is fitted on: numeric feature columns, then the encoded ones."""
    return [*modelling.feature_columns(modelling.model_inputs(table)), *schema.ENCODED.values()]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and small integers as int, for comparison across engines."""
    kinds = {T.DecimalType: "double", T.ShortType: "int"}
    return df.select(
        *[F.col(f"`{f.name}`").cast(kinds.get(type(f.dataType), f.dataType)).alias(f.name) for f in df.schema.fields]
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so the order of additions does not show."""
    return df.select(
        *[
            (numbers.round_half_up(F.col(f"`{f.name}`"), digits) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
        ]
    )


# --- Scans, sources, sinks --------------------------------------------------------------------


@query
def read_requests_csv(spark, sf_dir):
    path = storage.new_path(spark, "export")
    rows = fixture.requests_export(spark, sf_dir)
    # Two loads with different column orders, the second without the columns that are dropped anyway;
    # quoted values hold line breaks, as raw exports do.
    odd = F.col("`Unique Key`").cast("bigint") % 2 == 1
    written = F.concat(F.col("`Resolution Description`"), F.lit("\n\"more\""))
    rows = rows.withColumn("Resolution Description", written) if "Resolution Description" in rows.columns else rows
    turned = rows.select(*[f"`{c}`" for c in reversed(rows.columns) if c not in schema.DROPPED])
    for part, name in ((rows.where(~odd), "first"), (turned.where(odd), "second")):
        part.write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
    return plain(exports.conform_raw(exports.read_export(spark, f"{path}/*", multi_line=True)))


@query
def read_findings_csv(spark, sf_dir):
    path = storage.new_path(spark, "export")
    fixture.requests_export(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return exports.read_findings_export(spark, path)


@query
def parse_timestamps(spark, sf_dir):
    rows = export(spark, sf_dir).select(
        F.col("`Unique Key`").cast("bigint").alias("unique_key"),
        F.col("`Created Date`").alias("created_date"),
        F.col("`Closed Date`").alias("closed_date"),
        F.when(F.col("`Unique Key`").cast("bigint") % 71 == 0, "13/45/2024 99:00:00 AM").otherwise(F.col("`Due Date`")).alias("due_date"),
    )
    return exports.parse_timestamps(rows, ["created_date", "closed_date", "due_date"])


@query
def normalize_na(spark, sf_dir):
    rows = rename_rows(fixture.requests_export(spark, sf_dir))
    return exports.normalize_na(rows).select(
        "unique_key", "problem_detail", "council_district", "bbl", "x_coordinate", "incident_zip"
    )


def rename_rows(df: DataFrame) -> DataFrame:
    return exports.rename_columns(exports.drop_columns(df))


@query
def rename_columns(spark, sf_dir):
    return rename_rows(fixture.requests_export(spark, sf_dir)).select("unique_key", "problem_type", "agency", "open_data_channel_type", "latitude")


@query
def drop_columns(spark, sf_dir):
    left = exports.drop_columns(fixture.requests_export(spark, sf_dir))
    return left.select(
        F.col("`Unique Key`").alias("unique_key"), F.col("Agency").alias("agency"), F.col("Borough").alias("borough"),
        F.lit(len(left.columns)).alias("columns_left"),
    )


@query
def scan_table(spark, sf_dir):
    return storage.scan_table(spark, f"{sf_dir}/events.parquet")


@query
def run_sql(spark, sf_dir):
    return storage.run_sql(
        spark,
        """
        SELECT agency, hour(created_date) AS hour, count(*) AS complaints,
               cast(min(resolution_hours) AS double) AS least, cast(max(resolution_hours) AS double) AS greatest
        FROM {requests_clean} WHERE agency IN ('HPD', 'NYPD') GROUP BY agency, hour(created_date)
        """,
        {"requests_clean": clean(spark, sf_dir, place=False)},
    )


@query
def conform_raw(spark, sf_dir):
    return plain(exports.conform_raw(export(spark, sf_dir)))


@query
def conform_rejects(spark, sf_dir):
    return exports.conform_rejects(export(spark, sf_dir))


@query
def constraint_violations(spark, sf_dir):
    key = F.col("unique_key")
    rows = typed(spark, sf_dir).withColumns(
        {
            "borough": F.when(key % 71 == 0, "SOMEWHERE BEYOND EVERY BOROUGH").otherwise(F.col("borough")),
            "council_district": F.when(key % 73 == 0, 40000).otherwise(F.col("council_district").cast("int")),
            "latitude": F.when(key % 79 == 0, 40000.5).otherwise(F.col("latitude").cast("double")),
        }
    )
    return cleaning.constraint_violations(rows)


@query
def quarantined_records(spark, sf_dir):
    """Events as CSV lines, every 89th cut short: what is set apart, by the key each begins with."""
    path = storage.new_path(spark, "broken-export")
    key = F.col("event_id").cast("string")
    line = F.concat(key, F.when(F.col("event_id") % 89 == 0, "").otherwise(F.lit(",NYPD,Noise")))
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(line.alias("line"))
    lines.write.text(f"{path}/lines")
    header = ["Unique Key", "Agency", "Problem (formerly Complaint Type)"]
    broken = exports.read_lines(spark, [f"{path}/lines"], header, skip_header=False)
    _, apart = exports.split_broken(broken)
    return apart.select(F.col("record").cast("long").alias("unique_key"))


@query
def gated_load(spark, sf_dir):
    """A load that keeps the rules is seen; one with repeated keys and over-long text is refused, with counts."""
    path = storage.new_path(spark, "gated-load")
    rows = typed(spark, sf_dir, place=False)
    kept = batch.gated_publish(rows, path).count()
    key = F.col("unique_key")
    wide = rows.withColumn("agency", F.when(key % 83 == 0, F.repeat(F.lit("x"), 200)).otherwise(F.col("agency")))
    try:
        batch.gated_publish(wide.unionByName(wide.where(key % 97 == 0)), path)
        found = {}
    except batch.LoadRefused as refused:
        found = refused.found
    table = [("published rows", storage.scan_table(spark, path).count()), ("loaded rows", kept), *found.items()]
    return spark.createDataFrame(table, "name string, rows long")


@query
def duplicate_keys(spark, sf_dir):
    rows = typed(spark, sf_dir, place=False).select("unique_key")
    return cleaning.duplicate_keys(rows.unionByName(rows.where("unique_key % 97 = 0")))


@query
def write_table(spark, sf_dir):
    path = storage.new_path(spark, "requests-clean")
    storage.write_table(clean(spark, sf_dir), path)
    return plain(storage.scan_table(spark, path))


@query
def verify_load(spark, sf_dir):
    return profiling.verify_load(typed(spark, sf_dir))


@query
def reconcile_counts(spark, sf_dir):
    return cleaning.reconcile_counts(typed(spark, sf_dir, place=False), **WINDOW)


# --- Profiling --------------------------------------------------------------------------------


@query
def profile_shape(spark, sf_dir):
    return profiling.profile_shape(typed(spark, sf_dir, place=False))


@query
def profile_nulls(spark, sf_dir):
    return profiling.profile_nulls(typed(spark, sf_dir))


@query
def profile_date_range(spark, sf_dir):
    return profiling.profile_date_range(typed(spark, sf_dir, place=False))


@query
def profile_closed_share(spark, sf_dir):
    return profiling.profile_closed_share(typed(spark, sf_dir, place=False))


@query
def profile_describe(spark, sf_dir):
    return profiling.profile_describe(cleaning.with_hours(typed(spark, sf_dir, place=False)))


@query
def profile_anomalies(spark, sf_dir):
    return profiling.profile_anomalies(cleaning.with_hours(typed(spark, sf_dir, place=False)))


@query
def profile_top_values(spark, sf_dir):
    return profiling.profile_top_values(typed(spark, sf_dir))


@query
def value_counts(spark, sf_dir):
    return profiling.value_counts(typed(spark, sf_dir, place=False), "status")


@query
def sample_rows(spark, sf_dir):
    return profiling.sample_rows(typed(spark, sf_dir), columns=schema.SAMPLED)


# --- Projection, filter, cleaning -------------------------------------------------------------


@query
def normalize_zip(spark, sf_dir):
    raw = fixture.requests_raw(spark, sf_dir, place=False)
    dirty = F.when(F.col("unique_key") % 61 == 0, "abc").otherwise(F.col("incident_zip"))
    return raw.select(
        "unique_key", text.zip_text(dirty).alias("incident_zip"), text.zip_rejected(dirty).alias("rejected")
    )


@query
def coerce_numeric(spark, sf_dir):
    rows = rename_rows(export(spark, sf_dir)).select("unique_key", "x_coordinate", "council_district", "bbl")
    return plain(exports.coerce_numeric(rows, ["x_coordinate"], {"council_district": "smallint", "bbl": "bigint"}))


@query
def standardize_strings(spark, sf_dir):
    return exports.standardize_strings(fixture.requests_raw(spark, sf_dir)).select("unique_key", *schema.STANDARDIZED)


@query
def split_closed(spark, sf_dir):
    return cleaning.split_closed(typed(spark, sf_dir, place=False)).select("unique_key", "status")


@query
def split_open(spark, sf_dir):
    return cleaning.split_open(typed(spark, sf_dir, place=False)).select("unique_key", "status")


@query
def resolution_hours(spark, sf_dir):
    return rounded(cleaning.with_hours(typed(spark, sf_dir, place=False)).select("unique_key", "hours"))


@query
def clean_requests(spark, sf_dir):
    return plain(clean(spark, sf_dir))


@query
def clean_rejects(spark, sf_dir):
    return cleaning.clean_rejects(typed(spark, sf_dir, place=False), **WINDOW)


@query
def resolution_stats(spark, sf_dir):
    return profiling.resolution_stats(cleaning.keep_valid(typed(spark, sf_dir, place=False), **WINDOW))


@query
def fill_defaults(spark, sf_dir):
    return cleaning.fill_defaults(typed(spark, sf_dir)).select("unique_key", *schema.FILL_DEFAULTS)


@query
def open_requests(spark, sf_dir):
    return plain(cleaning.open_requests(typed(spark, sf_dir)))


@query
def borough_distribution(spark, sf_dir):
    return analysis.row_counts(clean(spark, sf_dir), "borough")


@query
def findings_base(spark, sf_dir):
    return rounded(base(spark, sf_dir))


# --- Features and encodings -------------------------------------------------------------------


@query
def time_features(spark, sf_dir):
    return features.time_features(typed(spark, sf_dir, place=False)).select("unique_key", *schema.TIME_FEATURES)


@query
def log_target(spark, sf_dir):
    return rounded(features.log_target(clean(spark, sf_dir, place=False)).select("unique_key", "resolution_hours", schema.TARGET))


@query
def encoding_inputs(spark, sf_dir):
    return features.encoding_inputs(clean(spark, sf_dir))


@query
def one_hot(spark, sf_dir):
    rows = stored_clean(spark, sf_dir).select("unique_key", "agency_name", *schema.ONE_HOT)
    return features.one_hot(rows, features.fit_categories(rows))


@query
def request_features(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir))


@query
def impute_median(spark, sf_dir):
    rows = typed(spark, sf_dir, place=False).select("unique_key", "x_coordinate", F.col("council_district").cast("int"))
    return rounded(features.impute_median(rows, ["x_coordinate", "council_district"]))


@query
def target_encoding_fit(spark, sf_dir):
    return rounded(encoding.fit_encoding(of_splits(encoder_rows(spark, sf_dir), "train")))


@query
def fold_assign(spark, sf_dir):
    return typed(spark, sf_dir, place=False).select("unique_key", encoding.fold(F.col("unique_key")).alias("fold"))


@query
def target_encoding_oof(spark, sf_dir):
    return rounded(encoding.encode_out_of_fold(of_splits(encoder_rows(spark, sf_dir), "train")))


@query
def target_encoding_apply(spark, sf_dir):
    rows = encoder_rows(spark, sf_dir)
    return rounded(encoding.apply_encoding(of_splits(rows, "test"), fitted(rows, "train")))


# --- Joins and lookups ------------------------------------------------------------------------


@query
def error_by_borough(spark, sf_dir):
    return analysis.error_by_segment(predictions(spark, sf_dir), clean(spark, sf_dir), "borough", MIN_SEGMENT_ROWS)


@query
def error_by_agency(spark, sf_dir):
    rows = clean(spark, sf_dir, place=False)
    return analysis.error_by_segment(predictions(spark, sf_dir), rows, "agency", MIN_SEGMENT_ROWS)


@query
def errors_by_layout(spark, sf_dir):
    """Errors by borough and by agency from tables laid out by key."""
    rows = clean(spark, sf_dir).select("unique_key", "borough", "agency")
    tables = batch.error_tables(predictions(spark, sf_dir), rows, ["borough", "agency"], min_rows=MIN_SEGMENT_ROWS)
    parts = [t.withColumn("by", F.lit(name)) for name, t in tables.items()]
    return parts[0].unionByName(parts[1])


@query
def dow_label(spark, sf_dir):
    day = dates.sunday_day(F.col("created_date"))
    return typed(spark, sf_dir, place=False).select("unique_key", reshape.dow_label(day).alias("dow_label"))


@query
def agency_lookup(spark, sf_dir):
    return scoring.lookup_agency(fixture.forms_to_score(spark, sf_dir).select("form_id", "problem_type"))


@query
def predictions_table(spark, sf_dir):
    return rounded(predictions(spark, sf_dir), 4)


@query
def borough_comparison(spark, sf_dir):
    rows = findings.with_borough(base(spark, sf_dir))
    return findings.comparison(*findings.lists_by(rows, "borough", schema.HOUSING_AGENCY))


@query
def channel_comparison(spark, sf_dir):
    rows = findings.with_channel(base(spark, sf_dir, place=False))
    return findings.comparison(*findings.lists_by(rows, "channel", schema.POLICE_AGENCY), slowest_first=False)


# --- Analysis queries -------------------------------------------------------------------------


@query
def eda_distribution(spark, sf_dir):
    return analysis.time_distribution(clean(spark, sf_dir, place=False))


@query
def eda_agency(spark, sf_dir):
    columns = ["complaints", "avg_hours", "median_hours", "max_hours"]
    return analysis.by_segment(clean(spark, sf_dir, place=False), "agency", columns)


@query
def eda_slowest_types(spark, sf_dir):
    columns = ["complaints", "median_hours", "avg_hours"]
    return analysis.ranked_types(clean(spark, sf_dir, place=False), columns=columns)


@query
def eda_fastest_types(spark, sf_dir):
    return analysis.ranked_types(clean(spark, sf_dir, place=False), slowest=False)


@query
def eda_borough(spark, sf_dir):
    return analysis.by_segment(clean(spark, sf_dir), "borough", ["complaints", "median_hours", "avg_hours"])


@query
def eda_hour(spark, sf_dir):
    return analysis.by_hour(clean(spark, sf_dir, place=False))


@query
def eda_weekend(spark, sf_dir):
    columns = ["complaints", "median_hours", "avg_hours"]
    return analysis.by_segment(clean(spark, sf_dir, place=False), analysis.day_type(), columns)


@query
def eda_channel(spark, sf_dir):
    channel = F.col("open_data_channel_type").alias("channel")
    return analysis.by_segment(clean(spark, sf_dir, place=False), channel, ["complaints", "median_hours"])


@query
def eda_agency_types(spark, sf_dir):
    return analysis.agency_types(clean(spark, sf_dir, place=False))


@query
def eda_night(spark, sf_dir):
    columns = ["complaints", "median_hours", "avg_hours"]
    return analysis.by_segment(clean(spark, sf_dir, place=False), analysis.time_of_day(), columns)


@query
def dash_agency(spark, sf_dir):
    columns = ["complaints", "median_hours", "avg_hours"]
    return analysis.by_segment(clean(spark, sf_dir, place=False), "agency", columns)


@query
def dash_hour_day(spark, sf_dir):
    return analysis.by_hour_and_day(clean(spark, sf_dir, place=False)).orderBy("dow", "hour")


@query
def dash_borough_agency(spark, sf_dir):
    return analysis.by_borough_and_agency(clean(spark, sf_dir))


@query
def dash_channel(spark, sf_dir):
    return eda_channel(spark, sf_dir)


@query
def dash_slowest(spark, sf_dir):
    return analysis.ranked_types(clean(spark, sf_dir, place=False), top=15)


@query
def dash_fastest(spark, sf_dir):
    return analysis.ranked_types(clean(spark, sf_dir, place=False), slowest=False, top=15)


@query
def dash_daily(spark, sf_dir):
    return analysis.daily_volume(clean(spark, sf_dir, place=False))


@query
def dash_daily_top(spark, sf_dir):
    return analysis.daily_volume_top(clean(spark, sf_dir, place=False), ["NYPD", "HPD", "DSNY"])


@query
def charts_of_one_scan(spark, sf_dir):
    """All charts from one scan: groups, and the count and median of each where the chart has them."""
    parts = []
    for name, table in analysis.charts(analysis.count_questions(clean(spark, sf_dir))).items():
        measures = {"complaints": "bigint", "median_hours": "double"}
        shown = [F.col(c).cast(t) if c in table.columns else F.lit(None).cast(t) for c, t in measures.items()]
        groups = [c for c in table.columns if c not in measures and not c.endswith("_hours") and c != "pct"]
        group = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in groups])
        parts.append(table.select(F.lit(name).alias("chart"), group.alias("segment"), *[c.alias(n) for c, n in zip(shown, measures)]))
    return reduce(DataFrame.unionByName, parts)


# --- Findings ---------------------------------------------------------------------------------


@query
def medians_by(spark, sf_dir):
    return findings.medians_by(base(spark, sf_dir, place=False), "agency")


@query
def findings_overall(spark, sf_dir):
    return findings.findings_overall(base(spark, sf_dir, place=False))


@query
def findings_shares(spark, sf_dir):
    return findings.findings_shares(base(spark, sf_dir, place=False))


@query
def findings_by_problem(spark, sf_dir):
    return findings.findings_by_problem(base(spark, sf_dir, place=False))


@query
def findings_by_borough(spark, sf_dir):
    return findings.medians_by(findings.with_borough(base(spark, sf_dir)), "borough")


@query
def findings_heat_by_borough(spark, sf_dir):
    return findings.medians_by(findings.heat_only(findings.with_borough(base(spark, sf_dir))), "borough")


@query
def findings_housing_share(spark, sf_dir):
    return findings.agency_share(findings.with_borough(base(spark, sf_dir)), "borough", schema.HOUSING_AGENCY)


@query
def findings_by_channel(spark, sf_dir):
    return findings.medians_by(findings.with_channel(base(spark, sf_dir, place=False)), "channel")


@query
def findings_heat_by_channel(spark, sf_dir):
    rows = findings.with_channel(base(spark, sf_dir, place=False))
    return findings.medians_by(findings.heat_only(rows), "channel")


@query
def findings_police_share(spark, sf_dir):
    rows = findings.with_channel(base(spark, sf_dir, place=False))
    return findings.agency_share(rows, "channel", schema.POLICE_AGENCY)


@query
def findings_json(spark, sf_dir):
    return findings.as_json(findings.findings_document(base(spark, sf_dir)))


@query
def scoring_options(spark, sf_dir):
    return analysis.scoring_options(clean(spark, sf_dir))


# --- Reshaping --------------------------------------------------------------------------------


@query
def predicted_vs_actual(spark, sf_dir):
    return rounded(reshape.predicted_vs_actual(predictions(spark, sf_dir)), 4)


@query
def pivot_hour_day(spark, sf_dir):
    return reshape.pivot_hour_day(analysis.by_hour_and_day(clean(spark, sf_dir, place=False)))


@query
def pivot_borough_agency(spark, sf_dir):
    return reshape.pivot_borough_agency(dash_borough_agency(spark, sf_dir))


@query
def pivot_range(spark, sf_dir):
    return reshape.value_range(analysis.by_hour_and_day(clean(spark, sf_dir, place=False)))


@query
def error_clip_mean(spark, sf_dir):
    return reshape.error_clip_mean(predictions(spark, sf_dir))


@query
def error_histogram(spark, sf_dir):
    return reshape.error_histogram(predictions(spark, sf_dir))


@query
def agency_flagged(spark, sf_dir):
    # The fixture's agencies lie closer together than the real ones; its slow mark is lower.
    return reshape.agency_flagged(dash_agency(spark, sf_dir), slow_hours=36)


@query
def type_chart_rows(spark, sf_dir):
    return reshape.type_chart_rows(clean(spark, sf_dir, place=False))


@query
def shared_scale(spark, sf_dir):
    rows = findings.with_borough(base(spark, sf_dir))
    by_borough, heat_by_borough, _ = findings.lists_by(rows, "borough", schema.HOUSING_AGENCY)
    return findings.shared_scale(by_borough=by_borough, heat_by_borough=heat_by_borough)


# --- Display texts ----------------------------------------------------------------------------


@query
def format_duration(spark, sf_dir):
    rows = cleaning.with_hours(typed(spark, sf_dir, place=False))
    return rows.select("unique_key", text.format_duration(F.col("hours")).alias("duration"))


@query
def title_label(spark, sf_dir):
    rows = typed(spark, sf_dir)
    label = F.concat_ws("/", "borough", "problem_type", F.when(F.col("unique_key") % 2 == 0, "street-side"))
    return rows.select("unique_key", text.title_label(F.upper(label)).alias("upper_label"), text.title_label(label).alias("label"))


@query
def format_percent(spark, sf_dir):
    part = F.col("value") / 250
    return fixture_events(spark, sf_dir).select("event_id", text.format_percent(part).alias("percent"))


def fixture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# --- Modelling and evaluation -----------------------------------------------------------------


def dirty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table with an infinite-valued column, a text column and some missing targets."""
    key = F.col("unique_key")
    return feature_table(spark, sf_dir).withColumns(
        {
            "load_factor": F.when(key % 53 == 0, float("inf"))
            .when(key % 59 == 0, float("-inf"))
            .when(key % 61 == 0, float("nan"))
            .otherwise(F.col("hour_of_day") * 1.5),
            "note": F.lit("text"),
            schema.TARGET: F.when(key % 67 != 0, F.col(schema.TARGET)),
        }
    )


@query
def model_inputs(spark, sf_dir):
    return rounded(modelling.model_inputs(dirty_features(spark, sf_dir)))


@query
def split_assign(spark, sf_dir):
    return encoding.with_split(typed(spark, sf_dir, place=False).select("unique_key"))


@query
def split_sizes(spark, sf_dir):
    return encoding.split_sizes(clean(spark, sf_dir, place=False).select("unique_key"))


@query
def encode_split(spark, sf_dir):
    keep = ["unique_key", schema.TARGET, *schema.ENCODED, "load_factor"]
    inputs = encoding.with_split(modelling.model_inputs(dirty_features(spark, sf_dir)).select(*keep))
    train, test, _ = encoding.encode_split(
        inputs.where("split = 'train'").drop("split"), inputs.where("split = 'test'").drop("split")
    )
    return rounded(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))))


@query
def regression_metrics(spark, sf_dir):
    return rounded(evaluation.regression_metrics(baseline_scored(spark, sf_dir)))


def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.materialize(rounded(evaluation.regression_metrics(baseline_scored(spark, sf_dir))), "metrics")


@query
def merge_metrics(spark, sf_dir):
    fresh = baseline_metrics(spark, sf_dir)
    old = fresh.withColumns({"r2": F.col("r2") / 2, "mae_hours": F.col("mae_hours") * 2})
    names = ["r2", "mae_hours"]
    stored = evaluation.tidy_metrics(fresh, "test", "Baseline", names).unionByName(
        evaluation.tidy_metrics(old, "deployed", "Baseline", names)
    )
    return evaluation.merge_metrics(stored, evaluation.tidy_metrics(fresh, "deployed", "Baseline", names))


@query
def read_metrics(spark, sf_dir):
    """A document written, updated in place and read back."""
    fresh = baseline_metrics(spark, sf_dir)
    old = fresh.withColumns({"r2": F.col("r2") / 2, "mae_hours": F.col("mae_hours") * 2})
    names = ["r2", "mae_hours"]
    tidy = evaluation.tidy_metrics(fresh, "test", "Baseline").unionByName(evaluation.tidy_metrics(old, "deployed", "Baseline", names))
    path = storage.new_path(spark, "metrics-document")
    findings.write_document(evaluation.metrics_document(tidy, 10, "Baseline"), path)
    return evaluation.update_metrics(spark, path, evaluation.tidy_metrics(fresh, "deployed", "Baseline", names))


@query
def metrics_json(spark, sf_dir):
    fresh = baseline_metrics(spark, sf_dir)
    tidy = evaluation.tidy_metrics(fresh, "validation", "Baseline").unionByName(
        evaluation.tidy_metrics(fresh, "test", "Baseline")
    ).unionByName(evaluation.tidy_metrics(fresh, "deployed", "Baseline", ["r2", "mae_hours"]))
    rows = clean(spark, sf_dir, place=False).count()
    return findings.as_json(evaluation.metrics_document(tidy, rows, "Baseline"))


def candidates() -> dict:
    """The candidates of the registered queries, all at full size."""
    return modelling.default_candidates()


_made: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, label: str, make: Callable[[], object]) -> object:
    """Fits are dear: each is made once per application and table and shared by the queries about it."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs whose target follows problem type and hour, so that what a fit must find is known.

    The tables' own durations are noise; on them a broken feature would not show.
    """

    def make() -> DataFrame:
        effect = numbers.hash_number("effect", F.col("problem_type")) % 10 / 2.0
        by_day = F.when(F.col("hour_of_day").between(6, 17), 1.5).otherwise(0.0)
        noise = numbers.hash_number("noise", F.col("unique_key")) % 1000 / 5000.0
        inputs = modelling.model_inputs(feature_table(spark, sf_dir)).withColumn(schema.TARGET, effect + by_day + noise)
        return storage.materialize(inputs, "planted")

    return _once(spark, sf_dir, "planted", make)


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training and validation rows encoded for the candidates, and the encoding."""
    inputs = planted(spark, sf_dir)
    return _once(spark, sf_dir, "split", lambda: modelling.prepared_split(inputs, ["train"], ["validation"]))


def _validation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def make() -> DataFrame:
        split = _encoded(spark, sf_dir)
        return modelling.compare_candidates(planted(spark, sf_dir), {name: candidates()[name]}, split)

    return _once(spark, sf_dir, f"validation {name}", make)


def _comparison(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Validation metrics of all candidates, fitted side by side, and their comparison."""
    _encoded(spark, sf_dir)

    @inheritable_thread_target(spark)
    def run(name: str) -> DataFrame:
        return _validation(spark, sf_dir, name)

    with ThreadPoolExecutor(len(candidates())) as pool:
        tidy = reduce(DataFrame.unionByName, pool.map(run, candidates()))
    return tidy, evaluation.compare_models(tidy, list(candidates()))


def _refitted(spark: SparkSession, sf_dir: str, name: str, estimator) -> dict:
    inputs = planted(spark, sf_dir)
    return _once(spark, sf_dir, f"refit {name}", lambda: modelling.refit(inputs, estimator))


def _final(spark: SparkSession, sf_dir: str, name: str, estimator) -> dict:
    def make() -> dict:
        result = modelling.score_test(_refitted(spark, sf_dir, name, estimator), name)
        return {**result, "metrics": storage.materialize(result["metrics"], "test-metrics")}

    return _once(spark, sf_dir, f"test {name}", make)


def _beside_baseline(spark: SparkSession, sf_dir: str, tidy: DataFrame, stage: str, *fitted_on: str) -> DataFrame:
    """Per model: rows scored, the R² of the encoded problem type alone, and whether the model beats it."""
    rows = encoding.with_split(planted(spark, sf_dir).select("unique_key", schema.TARGET, *schema.ENCODED))
    encoded = encoding.apply_encoding(of_splits(rows, stage), fitted(rows, *fitted_on))
    least = rounded(evaluation.regression_metrics(modelling.baseline().transform(encoded)))
    named = least.select(F.lit(stage).alias("stage"), "rows", F.col("r2").alias("baseline_r2"))
    scores = tidy.where((F.col("metric") == "r2") & (F.col("stage") == stage))
    return scores.join(named, "stage").select(
        "stage", "model", "rows", "baseline_r2", (F.col("value") > F.col("baseline_r2")).alias("beats_baseline")
    )


def _validated(name: str) -> Query:
    def run(spark, sf_dir):
        return _beside_baseline(spark, sf_dir, _validation(spark, sf_dir, name), "validation", "train")

    return run


_registered["model_linear"] = _validated(modelling.LINEAR)
_registered["model_forest"] = _validated(modelling.FOREST)
_registered["model_boosted"] = _validated(modelling.BOOSTED)


@query
def model_linear_residuals(spark, sf_dir):
    """Least squares leaves residuals that average to nothing, alone and times every feature."""
    names = ["hour_of_day", "day_of_week", "is_weekend", "is_night", *schema.ENCODED.values()]
    train, _, _ = modelling.prepared_split(
        planted(spark, sf_dir).select("unique_key", schema.TARGET, *names[:4], *schema.ENCODED), ["train"], ["validation"]
    )
    scored = modelling.fit(modelling.linear(), train, names).transform(train)
    left = F.col(schema.TARGET) - F.col("prediction")
    moments = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(left).alias("intercept"), *[F.avg(left * F.col(c)).alias(c) for c in names]
    )
    return rounded(moments.unpivot(["rows"], ["intercept", *names], "feature", "moment")).withColumn("moment", F.abs("moment"))


def _flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.log_target(features.time_features(clean(spark, sf_dir, place=False)))
    return storage.materialize(
        encoding.with_split(rows.select("unique_key", schema.TARGET, "hour_of_day", "is_weekend", "is_night")), "flags"
    )


def _checkable(estimator: Callable, names: list[str]) -> Query:
    """A candidate in a setting whose fit has a closed form, so its scores can be checked by value."""

    def run(spark, sf_dir):
        rows = _flag_rows(spark, sf_dir)
        train, validation = of_splits(rows, "train"), of_splits(rows, "validation")
        return rounded(modelling.fit_and_score("Candidate", estimator(), train, validation, names, "validation")[1])

    return run


# Least squares on one feature is a slope and an intercept; an unsampled tree of depth 2 on two flags
# is the mean of each of their four combinations, and so is the first round of boosting.
_registered["model_linear_hour"] = _checkable(modelling.linear, ["hour_of_day"])
_registered["model_forest_flags"] = _checkable(
    lambda: modelling.forest(trees=3, depth=2, min_leaf=1, bootstrap=False), ["is_weekend", "is_night"]
)
_registered["model_boosted_flags"] = _checkable(
    lambda: modelling.boosted(rounds=1, depth=2, row_share=1.0, column_share=1.0), ["is_weekend", "is_night"]
)


@query
def model_small_forest(spark, sf_dir):
    tidy = _final(spark, sf_dir, modelling.SMALL_FOREST, modelling.small_forest())["metrics"]
    return _beside_baseline(spark, sf_dir, tidy, "test", "train", "validation")


@query
def model_comparison(spark, sf_dir):
    """Candidates and whether they are ahead of the line by validation R²: the planted step over the day
    is for trees. Which tree model wins is not planted; it changes with the rows."""
    _, ranked = _comparison(spark, sf_dir)
    line = F.max(F.when(F.col("model") == modelling.LINEAR, F.col("r2"))).over(Window.partitionBy())  # one row per candidate
    return ranked.withColumn("line", line).select("model", (F.col("r2") > F.col("line")).alias("ahead_of_line"))


def _winner(spark: SparkSession, sf_dir: str) -> tuple:
    """Name and estimator of the comparison's winner."""
    name = evaluation.best_model(_comparison(spark, sf_dir)[1])
    return name, candidates()[name]


def _best(spark: SparkSession, sf_dir: str) -> dict:
    """The winner of the comparison, refitted and tested once."""
    return _final(spark, sf_dir, *_winner(spark, sf_dir))


@query
def final_test_metrics(spark, sf_dir):
    tidy = _comparison(spark, sf_dir)[0].unionByName(_best(spark, sf_dir)["metrics"])
    validation = _beside_baseline(spark, sf_dir, tidy, "validation", "train")
    tested = _beside_baseline(spark, sf_dir, tidy, "test", "train", "validation")
    return validation.unionByName(tested.withColumn("model", F.lit("winner")))


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _refitted(spark, sf_dir, *_winner(spark, sf_dir))  # its test scores are not asked for
    return modelling.feature_importance(spark, result["model"], result["features"])


@query
def feature_importance(spark, sf_dir):
    """The two planted features, most telling first, and the total over all features."""
    table = _importance(spark, sf_dir)
    total = F.sum("importance").over(Window.partitionBy())  # one row per feature
    return rounded(table.withColumn("total", total)).where("rank <= 2").select("rank", "feature", "total")


@query
def headline_metrics(spark, sf_dir):
    tidy = _best(spark, sf_dir)["metrics"]
    headline = evaluation.headline_metrics(tidy, planted(spark, sf_dir).count(), _importance(spark, sf_dir))
    least = _beside_baseline(spark, sf_dir, tidy, "test", "train", "validation").first()["baseline_r2"]
    return headline.select(
        "rows", (F.col("test_r2") > least).alias("beats_baseline"), (F.col("problem_type_pct") > 50).alias("mostly_problem_type")
    )


# --- Scoring ----------------------------------------------------------------------------------


@query
def score_validate(spark, sf_dir):
    return scoring.validate_requests(fixture.requests_to_score(spark, sf_dir)).select("request_id", "errors")


@query
def score_missing(spark, sf_dir):
    return scoring.missing_fields(fixture.forms_to_score(spark, sf_dir)).select("form_id", "missing")


@query
def score_prepare(spark, sf_dir):
    valid, _ = scoring.split_valid(fixture.requests_to_score(spark, sf_dir))
    stored = feature_table(spark, sf_dir)
    table, names = fitted(encoding.with_split(stored), "train"), feature_names(stored)
    return rounded(scoring.prepare_requests(valid, table, names).select("request_id", *[f"`{c}`" for c in names]))


def deployed(spark: SparkSession, sf_dir: str) -> tuple:
    """Baseline model, its encoding, the saved feature list and its test error in hours."""
    stored = feature_table(spark, sf_dir)
    rows = encoding.with_split(stored.select("unique_key", schema.TARGET, *schema.ENCODED))
    table = fitted(rows, "train", "validation")
    metrics = rounded(evaluation.regression_metrics(baseline_of(rows, table)))
    tidy = evaluation.tidy_metrics(metrics, "deployed", "Baseline")
    return modelling.baseline(), table, feature_names(stored), evaluation.error_band(tidy)


@query
def score_requests(spark, sf_dir):
    answers, _ = scoring.score_requests(fixture.requests_to_score(spark, sf_dir), *deployed(spark, sf_dir))
    return answers.select(
        "request_id", "predicted_hours", "predicted_days", "confidence_band", "summary",
        F.col("inputs.agency").alias("input_agency"), F.col("inputs.channel").alias("input_channel"),
    )


@query
def save_model(spark, sf_dir):
    """The deployed model stored and loaded again, then scoring."""
    model, table, names, mae = deployed(spark, sf_dir)
    path = storage.new_path(spark, "model")
    modelling.save_model(path, model, names, table)
    loaded, features_, encoding_ = modelling.load_model(spark, path)
    answers, _ = scoring.score_requests(fixture.requests_to_score(spark, sf_dir), loaded, encoding_, features_, mae)
    return answers.select("request_id", "predicted_hours", "predicted_days")


@query
def score_form(spark, sf_dir):
    answers, _ = scoring.score_forms(fixture.forms_to_score(spark, sf_dir), *deployed(spark, sf_dir))
    return answers.select("form_id", "agency", "verdict", "predicted_hours", "predicted_days", "confidence_band", "summary")


@query
def score_band(spark, sf_dir):
    low, high = scoring.band(F.col("hours"), 34.3)
    rows = cleaning.with_hours(typed(spark, sf_dir, place=False))
    return rows.select("unique_key", low.alias("low"), high.alias("high"), scoring.band_text(F.col("hours"), 34.3).alias("band"))


@query
def score_summary(spark, sf_dir):
    rows = cleaning.with_hours(typed(spark, sf_dir, place=False))
    hours = F.col("hours")
    return rows.select(
        "unique_key", scoring.summary(hours).alias("summary"), scoring.verdict(hours).alias("verdict"),
        scoring.days(hours).alias("predicted_days"),
    )


@query
def score_stream(spark, sf_dir):
    arrived = storage.materialize(fixture.requests_to_score(spark, sf_dir), "arrived")
    folder = arrived.inputFiles()[0].rsplit("/", 1)[0]
    output = storage.new_path(spark, "answers")
    running = stream.start_scoring(
        stream.read_requests(spark, folder, arrived.schema),
        *deployed(spark, sf_dir),
        output=output,
        checkpoint=storage.new_path(spark, "stream"),
    )
    running.awaitTermination()
    return storage.scan_table(spark, output).select("request_id", "predicted_hours", "confidence_band", "errors")


@query
def score_stream_tables(spark, sf_dir):
    """A stream's answers and refusals, each from its own table."""
    arrived = storage.materialize(fixture.requests_to_score(spark, sf_dir), "arrived")
    folder = arrived.inputFiles()[0].rsplit("/", 1)[0]
    answers, refusals, state = (storage.new_path(spark, label) for label in ("answers", "refusals", "stream"))
    requests = stream.read_requests(spark, folder, arrived.schema)
    stream.start_publishing(requests, *deployed(spark, sf_dir), answers, refusals, state).awaitTermination()
    answered = storage.scan_table(spark, answers).select(
        "request_id", "predicted_hours", "confidence_band", F.lit("").alias("errors")
    )
    return answered.unionByName(storage.scan_table(spark, refusals).select("request_id", "errors"), allowMissingColumns=True)
