"""CSV exports: reading as text, then typing in one projection."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnaround import schema
from turnaround.functions.dates import parse_timestamp
from turnaround.functions.numbers import to_double, to_whole
from turnaround.functions.text import null_if_na, standardize, zip_text
from turnaround.sources.storage import materialize

#: Holds the text of records that do not fit their file's header.
CORRUPT = "_corrupt_record"


def read_export(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """All CSV files of a folder as text columns, NA tokens as null.

    Files are grouped by their header line and each group is read under its own header, so files may
    order their columns differently, lack some or have more; a column a file lacks is null.

    `multi_line` says that quoted values may hold line breaks: each file is then read by one task.
    Without it large files are split. A record that does not fit its header, such as the parts of one
    that runs over a line end, is kept and shown whole in the column `_corrupt_record`, whichever
    columns are read. (Spark refuses to read that column alone; `split_broken` stores the records.)
    """
    groups: dict[str, list[str]] = {}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    for path in sorted(r.path for r in files.collect()):
        groups.setdefault(_first_line(spark, path), []).append(path)
    if not groups:
        raise FileNotFoundError(f"no CSV file in {folder}")
    read = []
    for line, paths in groups.items():
        read.append(read_lines(spark, paths, next(csv.reader([line]), []), multi_line))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)
    return normalize_na(whole.select(*[F.col(f"`{c}`") for c in whole.columns if c != CORRUPT], CORRUPT))


def read_lines(
    spark: SparkSession, paths: list[str], header: list[str], multi_line: bool = False, skip_header: bool = True
) -> DataFrame:
    """CSV files under one header as text columns, and `_corrupt_record`. All fields are parsed, so that
    a record is marked by its fields, not by the columns a query happens to need."""
    kind = T.StructType([T.StructField(n, T.StringType()) for n in [*header, CORRUPT]])
    options = {"escape": '"', "multiLine": multi_line, "columnNameOfCorruptRecord": CORRUPT, "columnPruning": False}
    return spark.read.options(header=skip_header, **options).schema(kind).csv(paths)


def split_broken(export: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of `read_export` that fit their header, and the text of those that do not, `(record)`.

    The export is stored once, so both come from one reading of the files.
    """
    stored = materialize(export, "export")
    broken = stored.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"))
    return stored.where(F.col(CORRUPT).isNull()).drop(CORRUPT), broken


def _first_line(spark: SparkSession, path: str) -> str:
    """A file's header line, read by the driver like any other file metadata."""
    jvm = spark._jvm
    address = jvm.org.apache.hadoop.fs.Path(path)
    stream = address.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(address)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return (reader.readLine() or "").removeprefix("\ufeff")
    finally:
        reader.close()


def normalize_na(df: DataFrame) -> DataFrame:
    """NA tokens become null in every text column."""
    return df.select(
        *[
            (null_if_na(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
        ]
    )


def drop_columns(df: DataFrame, columns: list[str] = schema.DROPPED) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: dict[str, str] = schema.RENAMES) -> DataFrame:
    return df.withColumnsRenamed(names)


def parse_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: parse_timestamp(F.col(c)) for c in columns})


def standardize_strings(df: DataFrame, columns: list[str] = schema.STANDARDIZED) -> DataFrame:
    return df.withColumns({c: standardize(F.col(c)) for c in columns})


def coerce_numeric(df: DataFrame, doubles: list[str], wholes: dict[str, str]) -> DataFrame:
    """Text to numbers: `doubles` to double, `wholes` to the integer type given per column."""
    return df.withColumns(
        {c: to_double(F.col(c)) for c in doubles} | {c: to_whole(F.col(c), kind) for c, kind in wholes.items()}
    )


def conform_raw(df: DataFrame) -> DataFrame:
    """Header-named text columns to the typed 35-column table, in one projection."""
    named = rename_columns(drop_columns(df))
    columns = []
    for field in schema.RAW_SCHEMA.fields:
        name, kind = field.name, field.dataType
        c = F.col(name)
        if name == "unique_key":
            typed = to_whole(c)
        elif name in schema.DATE_COLUMNS:
            typed = parse_timestamp(c)
        elif name == "incident_zip":
            typed = zip_text(c)
        elif name in schema.STANDARDIZED:
            typed = standardize(c)
        elif isinstance(kind, (T.ShortType, T.LongType)):
            typed = to_whole(c, kind.simpleString())
        elif isinstance(kind, T.DoubleType):
            typed = to_double(c)
        elif isinstance(kind, T.DecimalType):
            typed = c.try_cast(kind.simpleString())
        else:
            typed = c
        columns.append(typed.alias(name))
    return named.select(*columns)


def conform_rejects(df: DataFrame) -> DataFrame:
    """Cells whose text was lost by typing: key, column, text. One row per lost cell."""
    named = rename_columns(drop_columns(df))
    typed = {f.name: f.dataType for f in schema.RAW_SCHEMA.fields if not isinstance(f.dataType, T.StringType)}

    def parsed(name: str, kind: T.DataType):
        c = F.col(name)
        if name in schema.DATE_COLUMNS:
            return parse_timestamp(c)
        if isinstance(kind, (T.ShortType, T.LongType)):
            return to_whole(c, kind.simpleString())
        return c.try_cast(kind.simpleString())

    checks = {name: parsed(name, kind) for name, kind in typed.items()} | {"incident_zip": zip_text(F.col("incident_zip"))}
    lost = [
        F.when(F.col(name).isNotNull() & value.isNull(), F.struct(F.lit(name).alias("column_name"), F.col(name).alias("text")))
        for name, value in checks.items()
    ]
    return named.select("unique_key", F.explode(F.array_compact(F.array(*lost))).alias("cell")).select("unique_key", "cell.*")


# Columns the findings need, with their short names.
FINDINGS_COLUMNS = {
    "Created Date": "created",
    "Closed Date": "closed",
    "Agency": "agency",
    "Problem (formerly Complaint Type)": "problem",
    "Borough": "borough",
    "Status": "status",
    "Open Data Channel Type": "channel",
}


def read_findings_export(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """The seven columns of the findings, of the records that fit their header."""
    export = read_export(spark, folder, multi_line)
    first = F.col(f"`{export.columns[0]}`")
    # Always true; it keeps a second column in the scan, which the mark alone may not make up.
    second = first.isNull() | (F.length(first) >= 0)
    return findings_columns(export.where(F.col(CORRUPT).isNull() & second))


def findings_columns(export: DataFrame) -> DataFrame:
    short = export.select(*[F.col(f"`{a}`").alias(b) for a, b in FINDINGS_COLUMNS.items()])
    return parse_timestamps(
        standardize_strings(short, ["agency", "borough", "status", "channel"]), ["created", "closed"]
    )
