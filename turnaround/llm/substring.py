"""Substring dedup: paragraphs, lines and sentences hashed, the earliest of equal ones kept, the others removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnaround.llm import common
from turnaround.sources.storage import materialize

#: Units with fewer words are never duplicates: short lines recur by chance in clean texts.
MIN_WORDS = 6
#: Characters that count as a word in scripts written without blanks.
UNSPACED_CHARS = 2
# A sentence ends with its line, or with the blank run behind its mark; full-width marks need no blank.
_BREAK = re.compile(r"\n|(?<=[.!?])[ \t]+|(?<=[。！？])(?!\n)")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

Piece = tuple[int, int, list[str]]


def _long(words: list[str], min_words: int) -> bool:
    return len(words) >= min_words or sum(
        max(1, len(_UNSPACED.findall(w)) // UNSPACED_CHARS) for w in words if not w.isascii()
    ) + sum(map(str.isascii, words)) >= min_words


def _whole(pieces: list[Piece]) -> Piece:
    return pieces[0][0], pieces[-1][1], [w for p in pieces for w in p[2]]


def _line_units(line: list[Piece], min_words: int) -> Iterator[Piece]:
    """The sentences of a line, the line, and sentences with the short ones between them."""
    at = -1
    for i, piece in enumerate(line):
        if _long(piece[2], min_words):
            yield piece
            if 0 <= at < i - 1 and i - at + 1 < len(line):
                yield _whole(line[at : i + 1])
            at = i
    if len(line) > 1 and _long((whole := _whole(line))[2], min_words):
        yield whole


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """`(start, end, digest)` of each unit of `min_words` words or more, offsets in code points, by
    start and end.

    Units are paragraphs (lines without an empty one between), lines and sentences, so a passage quoted
    within a line is found by its sentences and short sentences go with the line that repeats; two
    sentences are also one unit with the short ones between them. Units overlap; one that adds no
    words to another is left out. Digests are 128-bit, of the words in lower case with single blanks
    between them.
    """
    at, line, block, found = 0, [], [], []
    for m in _BREAK.finditer(text + "\n"):
        start, end = at, m.start()
        at = m.end()
        if words := text[start:end].lower().split():
            line.append((start, end, words))
        if m[0] != "\n":
            continue
        found += _line_units(line, min_words)
        if line:
            block.append(_whole(line))
        if not line or end == len(text):
            if len(block) > 1 and _long((whole := _whole(block))[2], min_words):
                found.append(whole)
            block = []
        line = []
    for start, end, words in sorted(found, key=lambda x: x[:2]):
        yield start, end, xxhash.xxh3_128_digest(" ".join(words).encode())


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS, with_text: bool = False) -> DataFrame:
    """A stored row per document: `row_id` (unique, also where ids repeat), `doc_id`, `n_chars`, and
    `units`, arrays of starts, ends and digests; `text` on demand. Ranks and removals are taken from
    here, not from the texts."""
    texts_too = [("text", "string")] if with_text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [[{"start": s, "end": e, "digest": d} for s, e, d in units(t, min_words)] for t in texts]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary())]))
            columns = [batch.column("row_id"), batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(rows, kind)]
            columns += [batch.column("text") for _ in texts_too]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "doc_id", "n_chars", "units", *(n for n, _ in texts_too)])

    numbered = common.keyed_texts(docs, F.monotonically_increasing_id().alias("row_id"))
    schema = "row_id long, doc_id long, n_chars long, units array<struct<start: long, end: long, digest: binary>>"
    schema += "".join(f", {n} {t}" for n, t in texts_too)
    return materialize(common.map_batches(numbered, run, schema), "text-units")


def removals(table: DataFrame) -> DataFrame:
    """`(row_id, spans)`: the units to remove from each row, by start.

    Units with equal digests are ranked by document id (null last), row and start; the first stays.
    Digests are counted by a pre-aggregated shuffle, and only those that occur twice meet the units
    again, in a join whose large keys adaptive execution splits; a unit is never moved as text.
    """
    flat = table.select("row_id", "doc_id", F.explode("units").alias("u")).select(
        "row_id", F.struct(F.col("doc_id").isNull(), "doc_id", "row_id", "u.start").alias("place"), "u.digest", "u.start", "u.end"
    )
    repeated = (
        flat.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    later = flat.join(repeated, "digest").where(~F.col("place").eqNullSafe(F.col("first")))
    return later.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def duplicates(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`(doc_id, n_chars, n_units, n_removed, removed_chars, removed)` for every row of `docs`.

    `removed` lists `start:end` of the units to remove, offsets in code points of the original text;
    units overlap (a line and its sentences), and `removed_chars` counts their union.
    A null text is an empty one (no units). Rows with a null id come last in rank; rows that repeat
    an id are ranked among each other in table order, so a repeated row loses its units and the first
    keeps them. Texts are read whole; an empty table gives an empty result; other columns are not read.
    """
    stored = unit_table(docs, min_words)
    found = stored.select("row_id", "doc_id", "n_chars", F.size("units").alias("n_units")).join(
        removals(stored), "row_id", "left"
    )
    spans = F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))
    return found.withColumn("s", spans).select(
        "doc_id", "n_chars", F.col("n_units").cast("long").alias("n_units"), F.size("s").cast("long").alias("n_removed"),
        F.expr(
            "aggregate(s, struct(0L as done, 0L as n), (a, x) -> struct(greatest(a.done, x.end) as done, "
            "a.n + greatest(0L, x.end - greatest(a.done, x.start)) as n), a -> a.n)"
        ).alias("removed_chars"),
        F.expr("array_join(transform(s, x -> concat(x.start, ':', x.end)), ',')").alias("removed"),
    )


def cut_out(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the original offsets of what is left."""
    kept, at = [], 0
    for start, end in spans:
        if start > at:
            kept.append((at, start))
        at = max(at, end)
    if at < len(text):
        kept.append((at, len(text)))
    return "".join(text[s:e] for s, e in kept), kept


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`(doc_id, text, kept)`: every row with repeated units taken out, and the original offsets of
    what is left as `kept`, `start:end` comma-joined. Same rules as `duplicates`."""
    stored = unit_table(docs, min_words, with_text=True)
    removed = removals(stored).select(
        "row_id", F.expr("array_join(transform(spans, x -> concat(x.start, ':', x.end)), ',')").alias("removed")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
                cut = [tuple(map(int, s.split(":"))) for s in spans.split(",")] if spans else []
                out.append(cut_out(text, cut))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t for t, _ in out], pa.string()),
                 pa.array([",".join(f"{s}:{e}" for s, e in k) for _, k in out], pa.string())],
                ["doc_id", "text", "kept"],
            )

    joined = stored.select("row_id", "doc_id", "text").join(removed, "row_id", "left")
    return common.map_batches(joined.select("doc_id", "text", "removed"), run, "doc_id long, text string, kept string")
