"""Published findings: medians and shares of closed requests on unrounded hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnaround import schema
from turnaround.functions.dates import day_text
from turnaround.functions.numbers import round_half_up, share
from turnaround.functions.text import format_duration, format_percent, title_label
from turnaround.operators.cleaning import keep_valid
from turnaround.operators.quantiles import count_values, medians
from turnaround.sources.storage import materialize, publish


def findings_base(requests: DataFrame, **window) -> DataFrame:
    """Valid closed requests straight from the export's short columns: no fills, unrounded hours."""
    dates = {"created": "created_date", "closed": "closed_date"}
    return keep_valid(requests.withColumnsRenamed(dates), **window).withColumnsRenamed({v: k for k, v in dates.items()})


def with_borough(base: DataFrame) -> DataFrame:
    return base.where(F.col("borough") != schema.UNSPECIFIED)


def with_channel(base: DataFrame) -> DataFrame:
    return base.where(F.col("channel").isin(schema.FINDINGS_CHANNELS))


def heat_only(base: DataFrame) -> DataFrame:
    return base.where(F.col("problem") == schema.HEAT)


def top_values(df: DataFrame, column: str, n: int = 15, weight: str | None = None) -> DataFrame:
    """The `n` most frequent non-null values."""
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(rows.alias("_rows"))
    return counts.orderBy(F.desc("_rows"), column).limit(n).select(column)


def medians_by(
    df: DataFrame, column: str, value: str = "hours", keep: DataFrame | None = None, ordered: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Median and count per value, shortest first; `keep` (one column) restricts the values, `weight`
    says how often a row counts."""
    chosen = df.where(F.col(column).isNotNull())
    if keep is not None:
        chosen = chosen.join(keep, column, "left_semi")
    found = medians(chosen, [column], value, weight=weight).select(
        F.col(column).alias("label"), F.col("median").alias("median_hours"), F.col("rows").alias("count")
    )
    return found.orderBy("median_hours", "label") if ordered else found


def findings_by_problem(base: DataFrame, top: int = 15) -> DataFrame:
    counted = count_values(base, ["problem"], "hours")
    # The allow-list has at most `top` rows by construction.
    return medians_by(counted, "problem", keep=F.broadcast(top_values(counted, "problem", top, "n")), weight="n")


def agency_share(df: DataFrame, column: str, agency: str) -> DataFrame:
    """Part of the requests of each value that one agency handles."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("label"))
        .agg(share(F.col("agency") == agency).alias("share"), F.count(F.lit(1)).alias("count"))
    )


def lists_by(base: DataFrame, column: str, agency: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Medians of all requests by a column, of heat requests alone, and the agency's share.

    One scan: requests are counted by label, heat or not, and exact hours; all three lists come from
    the counted rows.
    """
    marked = base.withColumn("_heat", F.coalesce(F.col("problem") == schema.HEAT, F.lit(False)))
    counted = count_values(marked, [column, "_heat"], "hours", handled=F.count_if(F.col("agency") == agency))
    shares = counted.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(
        round_half_up(F.sum("handled") / F.sum("n"), 3).alias("share"), F.sum("n").alias("count")
    )
    return (
        medians_by(counted, column, ordered=False, weight="n"),
        medians_by(counted.where("_heat"), column, ordered=False, weight="n"),
        shares,
    )


def _within(hours: Column) -> dict[str, Column]:
    return {
        "share_within_2h": share(hours <= 2),
        "share_within_24h": share(hours <= 24),
        "share_over_7d": share(hours > 168),
    }


def findings_shares(base: DataFrame) -> DataFrame:
    return base.agg(*[c.alias(name) for name, c in _within(F.col("hours")).items()])


def findings_overall(base: DataFrame) -> DataFrame:
    """Total, first and last day and median in one row."""
    counted = count_values(
        base.withColumn("_all", F.lit(1)), ["_all"], "hours", first=F.min("created"), last=F.max("created")
    )
    totals = counted.groupBy("_all").agg(
        F.sum("n").alias("total"),
        day_text(F.min("first")).alias("first_created"),
        day_text(F.max("last")).alias("last_created"),
    )
    middle = medians(counted, ["_all"], "hours", weight="n").select("_all", F.col("median").alias("median_hours"))
    return totals.join(middle, "_all").drop("_all")


def findings_document(base: DataFrame, top: int = 15) -> DataFrame:
    """All findings as one nested row.

    Every request is tagged with the lists it counts in, so one grouping and one median pass serve
    the totals and all seven lists. The most frequent problem types are found first; only their
    requests are tagged for that list. Only the grouped rows, one per list and label, are assembled.
    """
    columns = ["problem", "borough", "channel", "agency", "hours", "created"]
    base = materialize(base.select(*columns), "findings-base")
    # At most `top` rows by construction.
    frequent = top_values(base, "problem", top).withColumn("_frequent", F.lit(True))
    base = base.join(F.broadcast(frequent), "problem", "left")
    heat, borough_known = F.col("problem") == schema.HEAT, F.col("borough") != schema.UNSPECIFIED
    channel_known = F.col("channel").isin(schema.FINDINGS_CHANNELS)

    def entry(name: str, label: Column, condition: Column) -> Column:
        return F.when(condition & label.isNotNull(), F.struct(F.lit(name).alias("list"), label.alias("label")))

    lists = F.array_compact(
        F.array(
            entry("all", F.lit("all"), F.lit(True)),
            entry("by_problem", F.col("problem"), F.col("_frequent").isNotNull()),
            entry("by_borough", F.col("borough"), borough_known),
            entry("heat_by_borough", F.col("borough"), borough_known & heat),
            entry("by_channel", F.col("channel"), channel_known),
            entry("heat_by_channel", F.col("channel"), channel_known & heat),
        )
    )
    tagged = base.select(F.explode(lists).alias("_e"), "hours", "agency", "created").select("_e.*", "hours", "agency", "created")
    grouped = tagged.groupBy("list", "label").agg(
        F.count(F.lit(1)).alias("count"),
        day_text(F.min("created")).alias("first_created"),
        day_text(F.max("created")).alias("last_created"),
        share(F.col("agency") == schema.HOUSING_AGENCY).alias("housing"),
        share(F.col("agency") == schema.POLICE_AGENCY).alias("police"),
        *[c.alias(name) for name, c in _within(F.col("hours")).items()],
    )
    middle = medians(tagged, ["list", "label"], "hours").select("list", "label", F.col("median").alias("median_hours"))
    rows = grouped.join(middle, ["list", "label"])

    def listed(name: str, value: str, published: str, sort_by_label: bool) -> Column:
        order = ["label"] if sort_by_label else [value, "label"]
        entry_row = F.struct(*order, F.col(value).alias("_value"), "count")
        ordered = F.sort_array(F.collect_list(F.when(F.col("list") == name, entry_row)))
        return F.transform(
            ordered,
            lambda r: F.struct(r["label"].alias("label"), r["_value"].alias(published), r["count"].alias("count")),
        )

    def ranked(name: str) -> Column:
        return listed(name, "median_hours", "median_hours", False)

    def overall(name: str) -> Column:
        return F.max(F.when(F.col("list") == "all", F.col(name)))

    headline = ["first_created", "last_created", "median_hours", *_within(F.col("hours"))]
    return rows.agg(
        overall("count").alias("total"),
        *[overall(c).alias(c) for c in headline],
        ranked("by_problem").alias("by_problem"),
        ranked("by_borough").alias("by_borough"),
        ranked("heat_by_borough").alias("heat_by_borough"),
        listed("by_borough", "housing", "share", True).alias("housing_share_by_borough"),
        ranked("by_channel").alias("by_channel"),
        ranked("heat_by_channel").alias("heat_by_channel"),
        listed("by_channel", "police", "share", True).alias("police_share_by_channel"),
    )


def as_json(document: DataFrame, pretty: bool = False) -> DataFrame:
    """One-row document as JSON text."""
    options = {"pretty": "true", "ignoreNullFields": "false"} if pretty else {"ignoreNullFields": "false"}
    return document.select(F.to_json(F.struct("*"), options).alias("json"))


def write_document(document: DataFrame, path: str) -> None:
    """Write a one-row document as one JSON file."""
    as_json(document, pretty=True).coalesce(1).write.mode("overwrite").text(path)


def publish_document(document: DataFrame, path: str) -> None:
    """Publish a one-row document as one JSON file: readers see the old one until the new one is whole."""
    publish(document.sparkSession, path, as_json(document, pretty=True).coalesce(1).write.text)


def comparison(overall: DataFrame, alike: DataFrame, shares: DataFrame, slowest_first: bool = True) -> DataFrame:
    """Per label: median of all requests, median like for like and the agency's share, as texts.

    A label missing from a list shows null there.
    """
    order = F.desc("all_hours") if slowest_first else F.asc("all_hours")
    return (
        overall.select("label", F.col("median_hours").alias("all_hours"))
        .join(alike.select("label", F.col("median_hours").alias("alike_hours")), "label", "left")
        .join(shares.select("label", "share"), "label", "left")
        .orderBy(order, "label")
        .select(
            title_label(F.col("label")).alias("label"),
            format_duration(F.col("all_hours")).alias("all_requests"),
            format_duration(F.col("alike_hours")).alias("heat_only"),
            format_percent(F.col("share")).alias("share"),
        )
    )


def shared_scale(**lists: DataFrame) -> DataFrame:
    """Rows of several lists with their part of the greatest median over all of them."""
    parts = [df.select(F.lit(name).alias("list"), "label", "median_hours") for name, df in lists.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # The greatest median is one row, found by a pre-aggregated pass.
    rows = materialize(rows, "scale-rows").withColumn("_all", F.lit(1))
    greatest = rows.groupBy("_all").agg(F.max("median_hours").alias("scale_max"))
    scaled = rows.join(F.broadcast(greatest), "_all").drop("_all")
    return scaled.withColumn("part", round_half_up(F.col("median_hours") / F.col("scale_max"), 4))
