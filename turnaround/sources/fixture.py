"""Service requests derived from the driver's `events`, `customer` and `nation` tables.

One request per event, every rule a function of the event, so any engine derives the same rows.
Text is dirty on purpose: mixed case, outer blanks, float-like zips, missing and impossible dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.operators.joins import lookup_join

WINDOW = ("2024-01-02 00:00:00", "2024-01-29 00:00:00")


_OFFICE = """CASE event_type WHEN 'error' THEN 'HPD' WHEN 'click' THEN 'NYPD' WHEN 'view' THEN 'DSNY'
    WHEN 'signup' THEN 'DOT' WHEN 'purchase' THEN 'DEP' END"""

# Column -> rule over an event and its customer's place; columns without a rule are null.
_RULES = {
    "unique_key": "event_id",
    "created_date": "if(event_id % 101 = 0, NULL, ts)",
    "closed_date": """if(event_id % 97 = 0, NULL, ts + INTERVAL '1' HOUR * CASE WHEN event_id % 89 = 0 THEN -value
        WHEN event_id % 83 = 0 THEN value + 9000 WHEN event_id % 41 = 0 THEN value + 800 ELSE value END)""",
    "agency": "concat(' ', lower(office))",
    "agency_name": "event_type",
    "problem_type": f"""CASE WHEN event_id % 59 = 0 THEN NULL WHEN office = 'HPD' AND k < 40 THEN '{schema.HEAT}'
        ELSE concat(office, ' TYPE ', k div 20) END""",
    "problem_detail": "if(event_id % 31 = 0, NULL, concat('Detail ', k))",
    "location_type": "if(event_id % 19 = 0, NULL, segment)",
    "incident_zip": "if(event_id % 29 = 0, NULL, concat(user_id + 1000, '.0'))",
    "city": "if(event_id % 37 = 0, NULL, n_name)",
    "status": """CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'In Progress'
        WHEN event_id % 5 = 0 THEN 'Open' ELSE ' Closed ' END""",
    "due_date": "ts + INTERVAL '30' DAY",
    "council_district": "event_id % 51 + 1",
    "police_precinct": "concat('Precinct ', user_id % 77)",
    "bbl": "if(event_id % 47 = 0, NULL, 1000000000 + user_id)",
    "borough": """CASE WHEN event_id % 11 = 0 THEN 'Unspecified' WHEN event_id % 13 = 0 THEN NULL
        ELSE CASE n_regionkey WHEN 0 THEN 'BRONX' WHEN 1 THEN 'BROOKLYN' WHEN 2 THEN 'MANHATTAN'
            WHEN 3 THEN 'QUEENS' WHEN 4 THEN 'STATEN ISLAND' END END""",
    "x_coordinate": "if(event_id % 43 = 0, NULL, value * 100)",
    "open_data_channel_type": """CASE WHEN event_id % 23 = 0 THEN NULL ELSE
        CASE user_id % 4 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'online' WHEN 2 THEN 'PHONE' ELSE 'OTHER' END END""",
    "latitude": "40 + (event_id % 10000) / 10000",
}


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS user_id", "c_nationkey AS n_nationkey", "c_mktsegment AS segment"
    )
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    return lookup_join(customer, nation, ["n_nationkey"]).drop("n_nationkey")


def requests_raw(spark: SparkSession, sf_dir: str, place: bool = True) -> DataFrame:
    """Requests with typed dates and dirty text, before standardising.

    `place=False` leaves out what needs the customer table (borough by region, location type, city).
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "*", "CAST(get_json_object(props, '$.k') AS INT) AS k", f"{_OFFICE} AS office"
    )
    if place:
        located = lookup_join(events, _dimensions(spark, sf_dir), ["user_id"])
    else:
        nothing = "CAST(NULL AS STRING)"
        located = events.selectExpr("*", f"{nothing} AS segment", f"{nothing} AS n_name", "CAST(NULL AS INT) AS n_regionkey")
    return located.selectExpr(
        *[f"CAST({_RULES.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.RAW_SCHEMA]
    )


def _date_text(c: str) -> str:
    return f"""CASE unique_key % 3 WHEN 0 THEN date_format({c}, 'MM/dd/yyyy hh:mm:ss a')
        WHEN 1 THEN date_format({c}, 'yyyy-MM-dd HH:mm:ss') ELSE date_format({c}, "yyyy-MM-dd'T'HH:mm:ss") END"""


# Export text of columns that are not simply the value as text.
_TEXTS = {
    "created_date": _date_text("created_date"),
    "closed_date": _date_text("closed_date"),
    "due_date": _date_text("due_date"),
    "problem_detail": "coalesce(problem_detail, 'N/A')",
    "council_district": "if(unique_key % 43 = 0, 'NaN', concat(council_district, '.0'))",
    "bbl": "concat(bbl, '.0')",
    "x_coordinate": "if(unique_key % 53 = 0, 'unknown', CAST(floor(x_coordinate) AS STRING))",
    "incident_zip": "if(unique_key % 61 = 0, 'abc', incident_zip)",
}


def requests_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as the CSV export would hold them: header names, all text, NA tokens."""
    kept = [f"CAST({_TEXTS.get(name, name)} AS STRING) AS `{header}`" for header, name in schema.RENAMES.items()]
    unused = [f"CAST(NULL AS STRING) AS `{header}`" for header in schema.DROPPED]
    return requests_raw(spark, sf_dir).selectExpr(*kept, *unused)


def requests_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests, some of them invalid: unknown agency or borough, hour, day or month out of range."""
    raw = requests_raw(spark, sf_dir)
    key, created = F.col("unique_key"), F.col("created_date")

    def spoiled(n: int, wrong: object, value: Column) -> Column:
        return F.when(key % n == 0, F.lit(wrong)).otherwise(value)

    return raw.select(
        key.alias("request_id"),
        spoiled(37, "XYZ", F.btrim("agency")).alias("agency"),
        "borough",
        "problem_type",
        "location_type",
        F.col("open_data_channel_type").alias("channel"),
        spoiled(41, 25, F.hour(created)).alias("hour_of_day"),
        spoiled(43, 7, F.weekday(created)).alias("day_of_week"),
        spoiled(47, 13, F.month(created)).alias("month"),
    )


def forms_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled-in forms, some with gaps; problem types cycle through the known ones, one unknown, none."""
    raw = requests_raw(spark, sf_dir)
    key, created = F.col("unique_key"), F.col("created_date")
    problems = F.array(*[F.lit(p) for p in sorted(schema.PROBLEM_AGENCY)], F.lit("Other Problem"), F.lit(None))
    days = F.array(*[F.lit(d) for d in schema.DAY_NAMES])
    return raw.select(
        key.alias("form_id"),
        F.get(problems, (key % 31).cast("int")).alias("problem_type"),
        "borough",
        F.col("open_data_channel_type").alias("channel"),
        F.hour(created).alias("hour"),
        F.when(key % 53 == 0, "").otherwise(F.get(days, F.weekday(created))).alias("day"),
        F.month(created).alias("month"),
    )
