"""Mixing to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnaround.operators.joins import quoted
from turnaround.sources.storage import materialize

#: Rounds of fitting; a round rakes to every margin once.
ROUNDS = 10
#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UNKNOWN = "unknown"
#: The registered mix: exponents that temper present shares of tokens, and the share of all tokens that stays.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SHARE = 0.7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def form(text: Column) -> Column:
    """The form of a text, which stands for its topic where documents name none."""
    words = word_count(text)
    marks = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")
    return (
        F.when(marks * 10 > words, "marked").when(words < 100, "brief").when(words >= 1000, "long").otherwise("prose")
    )


def cells(docs: DataFrame, by: list[str], tokens: str = "n_tokens") -> DataFrame:
    """Tokens per combination of the margins' values: documents are added up before anything is fitted."""
    return docs.groupBy(*by).agg(F.sum(tokens).cast("double").alias("tokens")).where("tokens > 0")


def tempered(cells_: DataFrame, margin: str, exponent: float) -> DataFrame:
    """`(margin, target)`: shares in proportion to the value's tokens to the power `exponent`."""
    totals = cells_.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(exponent)).alias("p"))
    return totals.select(margin, (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("target"))


def rake(cells_: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Adds `weight`, shares of the mix that meet the targets of every margin (the last exactly).

    Each step scales the cells of a margin's value so that they add up to its target. Only cells are
    moved, one row per combination of values, never documents.
    """
    fitted = cells_
    for margin, target in targets.items():
        fitted = fitted.join(target.select(margin, F.col("target").alias(f"target_{margin}")), margin)
    total = F.sum("tokens").over(Window.partitionBy())
    fitted = materialize(fitted.withColumn("weight", F.col("tokens") / total), "mix-cells")
    for _ in range(rounds):
        for margin in targets:
            share = F.sum("weight").over(Window.partitionBy(margin))
            fitted = fitted.withColumn("weight", F.col("weight") * F.col(f"target_{margin}") / share)
    return materialize(fitted.drop(*(f"target_{m}" for m in targets)), "mix-weights")


def calibrate(weighted: DataFrame, share: float) -> DataFrame:
    """Adds `probability`, of keeping a document of the cell: in proportion to weight / tokens, at most
    1, such that `share` of all tokens is kept on average.

    Cells that would need more than they have are kept whole and the rest is scaled again; every
    round reads one aggregate row, and the set of whole cells only grows.
    """
    ratio, scale, whole = F.col("weight") / F.col("tokens"), 0.0, -1
    while True:
        full = ratio * F.lit(scale) >= 1
        row = weighted.agg(
            F.sum("tokens").alias("all"),
            F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("whole"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if not row["all"] or row["n"] == whole:
            break
        whole = row["n"]
        if not row["open"]:
            break
        scale = max(scale, (share * row["all"] - row["whole"]) / row["open"])
    return weighted.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale)))


def draw(key: Column, salt: str = "mix") -> Column:
    """A number in [0, 1) that a document's id fixes."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


ADDED = ("weight", "probability", "kept")


def _weighted(
    docs: DataFrame, targets: dict[str, DataFrame | float], share: float, key: str, tokens: str | Column,
    rounds: int, margins: dict[str, Column] | None,
) -> DataFrame:
    """`(row, weight, probability, kept)`: every row of `docs`, whole and apart from what is computed."""
    margins = margins or {}
    by = {m: f"margin_{i}" for i, m in enumerate(targets)}
    named = docs.select(
        F.struct(*map(quoted, docs.columns)).alias("row"), draw(quoted(key)).alias("draw"),
        (quoted(tokens) if isinstance(tokens, str) else tokens).alias("n"),
        *[F.coalesce((margins[m] if m in margins else quoted(m)).cast("string"), F.lit(UNKNOWN)).alias(c) for m, c in by.items()],
    )
    counted = materialize(cells(named, list(by.values()), "n"), "mix-tokens")
    goals = {
        by[m]: t.select(quoted(m).alias(by[m]), "target") if isinstance(t, DataFrame) else tempered(counted, by[m], float(t))
        for m, t in targets.items()
    }
    fitted = calibrate(rake(counted, goals, rounds), share).select(*by.values(), "weight", "probability")
    has = F.col("n") > 0
    added = {c: F.when(has, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in ("weight", "probability")}
    joined = named.join(fitted, list(by.values()), "left").withColumns(added)
    return joined.select("row", "weight", "probability", (F.col("draw") < F.col("probability")).alias("kept"))


def mix(
    docs: DataFrame, targets: dict[str, DataFrame | float], share: float, key: str = "doc_id",
    tokens: str | Column = "n_tokens", rounds: int = ROUNDS, margins: dict[str, Column] | None = None,
) -> DataFrame:
    """Every row of `docs` with `weight` (of its cell), `probability` and `kept`.

    `targets` names a margin each, with its shares (`margin`, `target`) or the exponent that tempers its
    present shares. A margin is the column of its name, or the expression `margins` gives for it. A null
    margin is the value `unknown`. Rows without tokens (null or empty texts) are in no mix: weight and
    probability 0, not kept. A row is kept if the number its key fixes lies below its probability, so
    repeated rows share a fate and a rerun draws the same; rows with a null key share one number. An
    empty table gives an empty result. Columns of `docs` named like the three added ones are read where
    they are margins or tokens, but not returned; `sample` returns rows as they came.
    """
    weighted = _weighted(docs, targets, share, key, tokens, rounds, margins)
    own = [c for c in docs.columns if c.lower() not in ADDED]
    return weighted.select(*[F.col("row")[c].alias(c) for c in own], *ADDED)


def sample(
    docs: DataFrame, targets: dict[str, DataFrame | float], share: float, key: str = "doc_id",
    tokens: str | Column = "n_tokens", rounds: int = ROUNDS, margins: dict[str, Column] | None = None,
) -> DataFrame:
    """The rows of `docs` that `mix` keeps, with the columns they came with, whatever their names."""
    kept = _weighted(docs, targets, share, key, tokens, rounds, margins).where("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
