"""Quality rules: counts of words, symbols and repeats, and bands of n-gram perplexity by language."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnaround.llm import characters, common
from turnaround.operators.joins import quoted
from turnaround.sources.storage import drop, materialize

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: N-grams are of characters, folded to 2**BITS classes; ORDER classes make an n-gram. A language has
#: 2**(BITS * ORDER) n-grams at most, which bounds its model whatever the corpus.
BITS = 5
ORDER = 4
GRAMS = 1 << (BITS * ORDER)
#: Languages scored in one pass; a broadcast holds so many models at most.
LANGUAGES_A_PASS = 16
UNKNOWN = "und"
#: Bands: robust deviations around the language's median, and their least half width (log perplexity).
DEVIATIONS = 2.5
LEAST_WIDTH = 0.05
#: A text of n characters gets this over the square root of n on top: its perplexity is a mean of n terms.
SHORT_TEXT = 2.0
#: Log perplexities are compared in steps, so a language has few distinct values and exact quantiles.
STEP = 1000.0
_loaded: dict = {}
common.keeps(__name__, _loaded.clear)


def _classes() -> np.ndarray:
    """The class of every code point up to U+FFFF: 0 is the boundary, 1-26 letters (others than a-z by
    their base letter, else dealt over the 26), 27 digits, 28 blanks, 29 ASCII marks, 30 the rest."""
    out = np.full(1 << 16, 30, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if cp >= 0x3400 and not 0xA640 <= cp < 0xD7FF:
            out[cp] = 1 + cp % 26 if c.isalpha() else 30
        elif c.isspace():
            out[cp] = 28
        elif c.isdigit():
            out[cp] = 27
        elif c.isalpha():
            base = unicodedata.normalize("NFD", c.lower())[0]
            out[cp] = ord(base) - 96 if "a" <= base <= "z" else 1 + cp % 26
        elif cp < 128:
            out[cp] = 29
    return out


def _class_table() -> np.ndarray:
    if "classes" not in _loaded:
        _loaded["classes"] = _classes()
    return _loaded["classes"]


def grams(text: str) -> np.ndarray:
    """The n-grams that predict each character of a text and its end, as packed class numbers."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    x = np.zeros(len(points) + ORDER, np.int32)
    x[ORDER - 1 : -1] = _class_table()[np.minimum(points, 0xFFFF)]
    n = len(points) + 1
    out = x[:n].copy()
    for i in range(1, ORDER):
        out <<= BITS
        out |= x[i : i + n]
    return out


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text.

    Words are runs of anything but the six ASCII blanks. A line with a word that equals an earlier
    line counts as duplicate. A word counts as repeated if it lies in a window of five words that
    the text holds twice or more; windows are found by hash and compared as words.
    """
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    if n > REPEAT_WINDOW:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        m = n - REPEAT_WINDOW + 1
        key = h[:m].copy()
        for i in range(1, REPEAT_WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            at = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            seen: dict[tuple, int] = {}
            windows = [(i, tuple(words[i : i + REPEAT_WINDOW])) for i in at.tolist()]
            for _, w in windows:
                seen[w] = seen.get(w, 0) + 1
            marked = np.zeros(n + 1, np.int64)
            for i, w in windows:
                if seen[w] > 1:
                    marked[i] += 1
                    marked[min(i + REPEAT_WINDOW, n)] -= 1
            repeated = int((np.cumsum(marked)[:n] > 0).sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


# --- The model ------------------------------------------------------------------------------------


def gram_counts(docs: DataFrame) -> DataFrame:
    """`(lang, gram, n)` over all texts. A task adds up its texts first, in one array per language,
    so the shuffle holds each n-gram once per task and language at most."""

    def flush(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                ["lang", "gram", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                if lang not in held:
                    if len(held) >= LANGUAGES_A_PASS:
                        yield from flush(held)
                        held.clear()
                    held[lang] = np.zeros(GRAMS, np.int64)
                for part in _portions([texts[i] for i in np.flatnonzero(langs == lang)]):
                    held[lang] += np.bincount(np.concatenate([grams(t) for t in part]), minlength=GRAMS)
        yield from flush(held)

    counted = common.map_batches(_with_language(docs), run, "lang string, gram int, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _portions(texts: list[str], chars: int = 1 << 22) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _with_language(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), *more
    )


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash (splitmix64), so that hashed n-grams never collide."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([min(max(d, 0.0), float(k)) for k, d in enumerate(found)])


def kneser_ney(gram: np.ndarray, n: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The model of one language as `(order, sorted hashes, log probability, log back-off)`.

    The highest order takes raw counts, lower ones the number of different classes seen before an
    n-gram. Probabilities are interpolated; a hash holds the n-gram's probability and, as a context
    of the next order, its back-off weight. Order 0 is the uniform distribution.
    """
    k = 1 << BITS
    counts = np.zeros(GRAMS, np.int64)
    counts[gram] = n
    by_order = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        by_order[order] = (by_order[order + 1].reshape(k, -1) > 0).sum(axis=0)
    lower = np.full(1, 1.0 / k)
    probability, gamma = {}, {}
    for order in range(1, ORDER + 1):
        c = by_order[order].reshape(-1, k)
        d = discounts(c)
        total = c.sum(axis=1)
        kinds = np.minimum(c, 3)
        left = sum(d[j] * (kinds == j).sum(axis=1) for j in (1, 2, 3))
        gamma[order] = np.where(total > 0, left / np.maximum(total, 1), 1.0)
        back = np.tile(lower.reshape(-1, k) if order > 1 else np.full((1, k), lower[0]), (k if order > 1 else 1, 1))
        lower = np.where(
            total[:, None] > 0,
            np.maximum(c - d[kinds], 0) / np.maximum(total, 1)[:, None] + gamma[order][:, None] * back,
            back,
        ).ravel()
        probability[order] = lower
    out = []
    for order in range(1, ORDER + 1):
        weight = np.ones(len(probability[order])) if order == ORDER else gamma[order + 1]
        seen = by_order[order] > 0
        if order < ORDER:
            seen |= by_order[order + 1].reshape(-1, k).sum(axis=1) > 0
        at = np.flatnonzero(seen)
        keys = mix(at.astype(np.uint64) | np.uint64(order << 32))
        by_key = np.argsort(keys)
        with np.errstate(divide="ignore"):
            p, w = np.log(probability[order][at]), np.log(np.maximum(weight[at], 1e-30))
        out.append((order, keys[by_key], p[by_key].astype(np.float32), w[by_key].astype(np.float32)))
    return out


MODEL = "lang string, part int, keys binary, probabilities binary, weights binary"


def models(docs: DataFrame) -> DataFrame:
    """A row per language and order: sorted hash array, log probabilities, log back-off weights. A
    language is one group of 2**20 counts at most."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = kneser_ney(pdf["gram"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame(
            [(pdf["lang"].iloc[0], o, k.astype("<u8").tobytes(), p.tobytes(), w.tobytes()) for o, k, p, w in parts],
            columns=["lang", "part", "keys", "probabilities", "weights"],
        )

    return materialize(gram_counts(docs).groupBy("lang").applyInPandas(build, MODEL), "language-models")


class Scorer:
    """Looks n-grams up in a language's sorted hash arrays, backing off to shorter ones. The answers
    for all 2**20 n-grams are kept, so each is looked up once per worker."""

    def __init__(self, parts: dict[int, tuple[bytes, bytes, bytes]]):
        arrays = {
            o: (np.frombuffer(k, "<u8"), np.frombuffer(p, np.float32), np.frombuffer(w, np.float32))
            for o, (k, p, w) in parts.items()
        }
        self.table = self._log(arrays, np.arange(GRAMS, dtype=np.uint64), ORDER)

    def _find(self, arrays: dict, gram: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        keys = arrays[order][0]
        h = mix(gram | np.uint64(order << 32))
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        return at, (keys[at] == h) if len(keys) else np.zeros(len(h), bool)

    def _log(self, arrays: dict, gram: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full(len(gram), -np.log(1 << BITS), np.float32)
        at, hit = self._find(arrays, gram, order)
        out = np.where(hit, arrays[order][1][at], np.float32(0)) if len(arrays[order][1]) else np.zeros(len(gram), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest = gram[miss]
            back = self._log(arrays, rest & np.uint64((1 << (BITS * (order - 1))) - 1), order - 1)
            if order > 1:
                context, known = self._find(arrays, rest >> np.uint64(BITS), order - 1)
                back = back + np.where(known, arrays[order - 1][2][context], np.float32(0))
            out[miss] = back
        return out

    def log_perplexity(self, text: str) -> float:
        codes = grams(text)
        return -float(self.table[codes].sum(dtype=np.float64)) / len(codes)


def _scorer(shared, lang: str) -> Scorer | None:
    """One scorer per language of the present broadcast, kept by the worker."""
    if _loaded.get("broadcast") != shared.id_:
        _loaded["broadcast"], _loaded["scorers"] = shared.id_, {}
    if lang not in _loaded["scorers"]:
        _loaded["scorers"][lang] = Scorer(shared.broadcast.value[lang])
    return _loaded["scorers"][lang]


class _Shared:
    def __init__(self, broadcast, id_: str):
        self.broadcast, self.id_ = broadcast, id_


def _passes(models_: DataFrame) -> Iterator[tuple[list[str], _Shared]]:
    """Languages in groups whose models fit a broadcast: LANGUAGES_A_PASS models of 2**20 n-grams of
    16 bytes at most, and far less in practice. Every language is in exactly one group."""
    spark = models_.sparkSession
    langs = [r.lang for r in models_.select("lang").distinct().orderBy("lang").toLocalIterator()]
    for at in range(0, len(langs), LANGUAGES_A_PASS):
        part = langs[at : at + LANGUAGES_A_PASS]
        found: dict = {}
        for r in models_.where(F.col("lang").isin(part)).toLocalIterator():
            found.setdefault(r["lang"], {})[r["part"]] = tuple(bytes(r[c]) for c in ("keys", "probabilities", "weights"))
        yield part, _Shared(spark.sparkContext.broadcast(found), uuid.uuid4().hex)


def _both(texts: list[str], langs: list[str], shared: _Shared, spelled) -> list[tuple[float, float] | None]:
    """Per text its log perplexity by classes and by whole characters, in steps; None without a word."""
    out: list[tuple[float, float] | None] = [None] * len(texts)
    by_lang: dict[str, list[int]] = {}
    for i, (t, g) in enumerate(zip(texts, langs)):
        if t.strip(BLANKS):
            by_lang.setdefault(g, []).append(i)
    for g, at in by_lang.items():
        for i, deep in zip(at, spelled.value[g].log_perplexities([texts[i] for i in at])):
            out[i] = (round(_scorer(shared, g).log_perplexity(texts[i]) * STEP) / STEP, round(deep * STEP) / STEP)
    return out


def perplexities(docs: DataFrame, passes: list[tuple[list[str], _Shared]], spelled) -> DataFrame:
    """`(lang, log_perplexity, deep_log_perplexity)` of every row with a word, rounded to steps."""
    source, out = _with_language(docs), None
    for langs, shared in passes:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = batch.column("lang").to_pylist()
                scored = _both(batch.column("text").to_pylist(), of, shared, spelled)
                found = [(g, *s) for g, s in zip(of, scored) if s]
                columns = zip(*found) if found else [[]] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64()))],
                    ["lang", "log_perplexity", "deep_log_perplexity"],
                )

        part = common.map_batches(
            source.where(F.col("lang").isin(langs)), run, "lang string, log_perplexity double, deep_log_perplexity double"
        )
        out = part if out is None else out.unionByName(part)
    return out


def bands(scores: DataFrame, deviations: float = DEVIATIONS, least: float = LEAST_WIDTH) -> DataFrame:
    """`(lang, lower, upper)`: the median of the language's log perplexities, less and plus
    `deviations` robust deviations (a quartile's distance from the median / 0.6745), `least` at
    least. The quartiles are exact, over all texts; values come in steps, so few are distinct."""
    q = F.expr("percentile(log_perplexity, array(0.25D, 0.5D, 0.75D))")
    below = F.greatest(F.lit(least), (F.col("q")[1] - F.col("q")[0]) / 0.6745 * deviations)
    above = F.greatest(F.lit(least), (F.col("q")[2] - F.col("q")[1]) / 0.6745 * deviations)
    return (
        scores.groupBy("lang").agg(q.alias("q"))
        .select("lang", (F.col("q")[1] - below).alias("lower"), (F.col("q")[1] + above).alias("upper"))
    )


VERDICT = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "log_perplexity": "double", "kept": "boolean", "deep_log_perplexity": "double",
}


def judge(docs: DataFrame, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Every row of `docs` with its counts, its log perplexity and the verdict `kept`.

    `keep` names the columns to carry (default `doc_id`); the added ones have `prefix` before their
    names. A text fails the base rules with under 10 words or over 20 % repeated words; others are
    kept if their log perplexity, under the class model of their language, lies in that language's band,
    which is wider for short texts, and their `deep_log_perplexity`, under the model of its whole
    characters (`characters`), is not above its own band: below lie texts that others repeat.
    A null text is an empty one (fails, perplexity null); a null language is a language of its own.
    Null ids, repeated rows and very long texts are judged like any other, whole. An empty table
    gives an empty result. Only `text`, `lang` and the carried columns are read.

    Passes over the texts: the alphabets, counting n-grams of classes and of characters, scoring for the
    bands, judging.
    """
    carried = keep if keep is not None else ["doc_id"]
    own = common.free_prefix([*carried, *(prefix + n for n in VERDICT)])
    text_name, lang_name = f"{own}text", f"{own}lang"
    models_ = models(docs)
    schema = [docs.select(*map(quoted, carried)).schema.toDDL()]
    schema += [f"`{prefix}{n}` {t}" for n, t in VERDICT.items()]
    lang = F.coalesce("lang", F.lit(UNKNOWN))
    spark, out = docs.sparkSession, None
    spelled = spark.sparkContext.broadcast(characters.models(_with_language(docs)))
    passes = list(_passes(models_))  # one broadcast serves the bands and the verdicts
    drop(models_)
    scores = perplexities(docs, passes, spelled)
    if scores is None:
        return spark.createDataFrame([], ", ".join(schema))
    scores = materialize(scores, "perplexities")
    deep = bands(scores.selectExpr("lang", "deep_log_perplexity log_perplexity")).selectExpr("lang", "upper most")
    limits = materialize(bands(scores).join(deep, "lang"), "perplexity-bands")
    drop(scores)
    source = docs.select(
        *map(quoted, carried), F.coalesce("text", F.lit("")).alias(text_name), lang.alias(lang_name)
    )
    for langs, shared in passes:
        band = {r["lang"]: (r["lower"], r["upper"], r["most"]) for r in limits.where(F.col("lang").isin(langs)).toLocalIterator()}

        def run(batches: Iterator[pa.RecordBatch], shared=shared, band=band) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, texts, of = [], batch.column(text_name).to_pylist(), batch.column(lang_name).to_pylist()
                for t, g, scored in zip(texts, of, _both(texts, of, shared, spelled)):
                    counts = base_counts(t)
                    failed = base_failed(counts[0], counts[4])
                    p, deep, kept = None, None, False
                    if scored:
                        p, deep = scored
                        slack = SHORT_TEXT / len(t) ** 0.5
                        lower, upper, most = band[g]
                        kept = not failed and lower - slack <= p <= upper + slack and deep <= most + slack
                    rows.append((*counts, failed, p, kept, deep))
                types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_(), pa.float64()]
                added = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 9, types)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(carried))] + added, [*carried, *(prefix + n for n in VERDICT)]
                )

        part = common.map_batches(source.where(F.col(lang_name).isin(langs)), run, ", ".join(schema))
        out = part if out is None else out.unionByName(part)
    drop(limits)
    return out
