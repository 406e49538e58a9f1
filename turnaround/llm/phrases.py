"""Phrases whose words come together more often than apart, mined by Rabin-Karp fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnaround.llm import common
from turnaround.llm.grams import Polynomial, Words, chunks
from turnaround.sources.storage import materialize

#: Words of a phrase at most, occurrences at least, and the share of them that a longer phrase may hold.
MOST_WORDS, LEAST_COUNT, INSIDE_PERCENT = 3, 10, 50
#: Phrases returned per language.
TOP = 2000
UNKNOWN = "und"
#: A filter has 16 bits a member, 2^28 bits (32 MB) at most: beyond 2^24 members it lets more pass. What
#: passes is counted exactly, so a fuller filter costs shuffle, never a result.
FILTER_BITS = (16, 28)
_SPREAD = 64
_PRINT, _CHECK = Polynomial(11), Polynomial(12)
_SIGNED = 1 << 63


class _Filter:
    """A set of numbers that may answer yes wrongly, never no."""

    def __init__(self, members: DataFrame, column: str):
        low, high = FILTER_BITS
        bits = min(max((16 * members.count()).bit_length(), low), high)
        place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        words = members.select(place.alias("place")).selectExpr(
            "cast(shiftright(place, 6) as int) at", "shiftleft(1L, cast(place & 63 as int)) bit"
        )
        found = words.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
        table = np.zeros(1 << (bits - 6), np.int64)
        table[found.column("at").to_numpy()] = found.column("bit").to_numpy()
        self.shared = members.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def has(self, values: np.ndarray) -> np.ndarray:
        table = self.shared.value
        place = values & np.uint64(len(table) * 64 - 1)
        return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _keyed(docs: DataFrame) -> DataFrame:
    return common.keyed_texts(docs, F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")).select("lang", "text")


def _identity(lang: str, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), xxhash.xxh32_intdigest(lang.encode()))


class _Batch:
    """The n-grams of some texts: fingerprints of language and words, `bits` wide."""

    def __init__(self, langs: list[str], texts: list[str], widths: list[int], bits: int):
        self.words = Words(texts)
        salts = {lang: xxhash.xxh64_intdigest(lang.encode(), 1) for lang in set(langs)}
        salt = np.array([salts[lang] for lang in langs], np.uint64)[self.words.text]
        mask = np.uint64((1 << bits) - 1)
        self.prints = {k: (h ^ salt ^ np.uint64(k)) & mask for k, h in _PRINT.hashes(self.words, widths).items()}

    def places(self, width: int, shorter: _Filter | None = None) -> np.ndarray:
        """Where an n-gram lies whole in a piece, and all it holds of one word less passes the filter."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        piece = self.words.piece
        whole = piece[:n] == piece[width - 1 :]
        if shorter is not None:
            known = shorter.has(self.prints[width - 1])
            whole &= known[:n] & known[1 : n + 1]
        return np.flatnonzero(whole)

    def checks(self, width: int) -> np.ndarray:
        """A second, unrelated hash of the n-grams, 31 bits."""
        return (_CHECK.hashes(self.words, [width])[width] >> np.uint64(33)).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], widths: list[int], bits: int) -> Iterator[tuple[list, list, _Batch]]:
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for a, b in chunks([len(t) for t in texts]):
            yield langs[a:b], texts[a:b], _Batch(langs[a:b], texts[a:b], widths, bits)


def _counted(docs: DataFrame, width: int, shorter: _Filter | None, bits: int) -> DataFrame:
    """Fingerprints of all n-grams of a width with count, least and greatest check, and a pointer to a
    text that holds one. For single words also a row per language with the number of its words."""
    widths = [width - 1, width] if shorter is not None else [width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts, grams in _batches(batches, widths, bits):
            at = grams.places(width, shorter)
            prints = grams.prints[width][at]
            order = np.argsort(prints)
            at, prints = at[order], prints[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), prints[1:] != prints[:-1])))
            total = {}
            if width == 1:
                for lang, n in zip(langs, grams.words.counts.tolist()):
                    total[lang] = total.get(lang, 0) + n
            pointer = np.array([_identity(*p) for p in zip(langs, texts)], np.uint64).view(np.int64)[grams.words.text[at]]
            check = grams.checks(width)[at]
            low = np.minimum.reduceat(check, first) if len(first) else check
            high = np.maximum.reduceat(check, first) if len(first) else check
            where = np.minimum.reduceat(pointer, first) if len(first) else pointer
            names = list(total)
            zeros = pa.nulls(len(names), pa.int64())
            columns = [prints[first].view(np.int64), np.diff(first, append=len(at)), low, high, where]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.string()), *arrays], _COLUMNS)
            if names:
                known = pa.array(list(total.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names), zeros, known, zeros, zeros, zeros], _COLUMNS)

    rows = common.map_batches(_keyed(docs), run, "lang string, print long, n long, low long, high long, pointer long")
    return rows.groupBy("lang", "print").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("pointer").alias("pointer")
    )


_COLUMNS = ["lang", "print", "n", "low", "high", "pointer"]


def _texts(docs: DataFrame, wanted: _Filter) -> DataFrame:
    """The texts pointed to, with their identity; copies within a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()))
            ids = np.array([_identity(*p) for p in pairs], np.uint64)
            take = []
            for i in np.flatnonzero(wanted.has(ids)).tolist():
                if ids[i] not in seen:
                    seen.add(ids[i])
                    take.append(i)
            part = batch.take(pa.array(take, pa.int64()))
            pointers = pa.array(ids[take].view(np.int64))
            yield pa.RecordBatch.from_arrays([pointers, part.column("lang"), part.column("text")], ["pointer", "lang", "text"])

    return common.map_batches(_keyed(docs), run, "pointer long, lang string, text string")


def _spelled(docs: DataFrame, frequent: DataFrame, most: int, bits: int) -> DataFrame:
    """The words behind each frequent fingerprint, read from the text its pointer names."""
    wanted = frequent.groupBy("pointer").agg(F.collect_list("print").alias("prints"))
    both = _texts(docs, _Filter(frequent.select("pointer").distinct(), "pointer")).join(wanted, "pointer")
    widths = list(range(1, most + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            out = [[], [], [], [], []]
            for lang, text, prints in zip(langs, texts, batch.column("prints")):
                grams = _Batch([lang], [text], widths, bits)
                sought = np.sort(prints.values.to_numpy().view(np.uint64))
                for k in widths:
                    at = grams.places(k)
                    found, first = np.unique(grams.prints[k][at], return_index=True)
                    hit = np.isin(found, sought, assume_unique=True)
                    at, found = at[first[hit]], found[hit]
                    check = grams.checks(k)[at]
                    out[0] += found.view(np.int64).tolist()
                    out[1] += [lang] * len(at)
                    out[2] += [grams.words.phrase(i, k) for i in at.tolist()]
                    out[3] += [k] * len(at)
                    out[4] += check.tolist()
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["print", "lang", "phrase", "width", "seen"])

    read = common.map_batches(both.select("lang", "text", "prints"), run, "print long, lang string, phrase string, width int, seen long")
    return read.dropDuplicates(["print", "width"])


def _recounted(docs: DataFrame, doubtful: DataFrame, most: int, bits: int) -> DataFrame:
    """Counts by the words themselves of all n-grams whose fingerprint is in doubt."""
    suspects = _Filter(doubtful, "print")
    widths = list(range(1, most + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, _, grams in _batches(batches, widths, bits):
            counts: dict[tuple, int] = {}
            for k in widths:
                at = grams.places(k)
                at = at[suspects.has(grams.prints[k][at])]
                for i, p, t in zip(at.tolist(), grams.prints[k][at].view(np.int64).tolist(), grams.words.text[at].tolist()):
                    key = (p, langs[t], grams.words.phrase(i, k), k)
                    counts[key] = counts.get(key, 0) + 1
            columns = list(zip(*counts)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["print", "lang", "phrase", "width", "n"])

    rows = common.map_batches(_keyed(docs), run, "print long, lang string, phrase string, width int, n long")
    return rows.join(doubtful, ["print", "width"], "left_semi").groupBy("lang", "phrase", "width").agg(F.sum("n").alias("n"))


def frequent_phrases(
    docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT, bits: int = 64
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to `most` words that occur `least` times in a language, and all languages' words.

    `(lang, phrase, width, n)` and `(lang, total)`, both stored. Fingerprints of n-grams are counted by a
    shuffle, a word more each round; a phrase can only be frequent if both of one word less are, which a
    filter of bounded size tells. A fingerprint carries the least and greatest of a second hash and a
    pointer to a text; the words read there must hash to both. Where they do not, phrases share a
    fingerprint, and those are counted by their words. `bits` narrows fingerprints, for tests.
    """
    shorter, found, totals = None, None, None
    for width in range(1, most + 1):
        counted = _counted(docs, width, shorter, bits)
        if width == 1:
            counted = counted.where(F.col("print").isNull() | (F.col("n") >= least))
            stored = materialize(counted.withColumn("width", F.lit(1)), "phrase-counts")
            totals = stored.where("print is null").select("lang", F.col("n").alias("total"))
            stored = stored.where("print is not null").drop("lang")
        else:
            stored = materialize(counted.where(F.col("n") >= least).drop("lang").withColumn("width", F.lit(width)), "phrase-counts")
        shorter = _Filter(stored, "print") if width < most else None
        found = stored if found is None else found.unionByName(stored)
    spelled = _spelled(docs, found, most, bits)
    sure = F.coalesce((F.col("low") == F.col("high")) & (F.col("low") == F.col("seen")), F.lit(False))
    joined = found.join(spelled, ["print", "width"], "left").withColumn("sure", sure)
    checked = materialize(joined.select("print", "width", "lang", "phrase", "n", "sure"), "phrase-texts")
    doubtful = checked.where("not sure").select("print", "width")
    phrases = checked.where("sure").select("lang", "phrase", "width", "n")
    if doubtful.count():
        again = _recounted(docs, doubtful, most, bits).where(F.col("n") >= least)
        phrases = materialize(phrases.unionByName(again), "phrase-texts")
    return phrases, totals


def collocations(
    docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT, inside: int = INSIDE_PERCENT,
    top: int = TOP, bits: int = 64,
) -> DataFrame:
    """Each language's first `top` phrases: `(lang, rank, phrase, a, l, r, n, score)`.

    Texts are split into pieces at `.,;:!?` and line ends, and these into words at blanks and tabs; only
    A-Z are lower-cased. `a` counts a phrase, `l` and `r` the parts of its lowest-scoring cut, score is
    floor(10^6 a^2 / (l r)) in exact decimals (counts under 10^16), `n` counts the language's words. A
    phrase of which `inside` percent or more lie in one longer frequent phrase is left out. A null text
    is empty, a null language is `und`; repeated rows count each; an empty table gives no rows. Only
    `text` and `lang` are read (`doc_id` must be there).
    """
    phrases, totals = frequent_phrases(docs, most, least, bits)
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    worded = phrases.where("width > 1").withColumn("words", F.split("phrase", " "))
    cuts = worded.select(
        "lang", "phrase", F.col("n").alias("a"), "width",
        F.explode(F.expr("transform(sequence(1, width - 1), k -> struct(k, "
                         "array_join(slice(words, 1, k), ' ') as head, array_join(slice(words, k + 1, width), ' ') as tail))")).alias("cut"),
    ).select("lang", "phrase", "width", "a", "cut.*")
    scored = (
        cuts.join(known.withColumnsRenamed({"part": "head", "times": "l"}), ["lang", "head"])
        .join(known.withColumnsRenamed({"part": "tail", "times": "r"}), ["lang", "tail"])
        .withColumn("score", F.expr("(cast(a as decimal(19, 0)) * a * 1000000bd) div (cast(l as decimal(19, 0)) * r)"))
        .groupBy("lang", "phrase", "width", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    )
    holds = worded.where("width > 2").select(
        "lang", "n",
        F.explode(F.expr("flatten(transform(sequence(2, width - 1), m -> "
                         "transform(sequence(1, width - m + 1), s -> array_join(slice(words, s, m), ' '))))")).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    free = scored.join(holds, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside)
    ).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SPREAD))).orderBy(*order)
    first = free.withColumn("rank", F.row_number().over(spread)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
