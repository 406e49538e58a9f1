"""Document fingerprints by SpotSigs: chains of content words behind common words, compared as sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnaround.llm import common
from turnaround.llm.grams import Polynomial, Words, chunks, mixed
from turnaround.sources.storage import materialize

#: A word is common, an anchor, if it is this share of all words: there are 1,000 at most.
ANCHOR_SHARE = 0.001
#: Content words of a chain, and from which next content word to which a chain goes.
CHAIN, DISTANCE = 2, 1
_PRINT = Polynomial(21)
_FACTORS = np.random.RandomState(22).randint(0, 1 << 31, 64, np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_NO_CUT = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " * 11)


def word_prints(words: Words) -> np.ndarray:
    return _PRINT.hashes(words, [1])[1]


def anchors(docs: DataFrame, share: float = ANCHOR_SHARE) -> np.ndarray:
    """The sorted prints of words that make up `share` or more of all words of all documents.

    All words are counted, by a pre-aggregated shuffle; no more than 1 / share prints reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks([len(t) for t in texts]):
                prints, n = np.unique(word_prints(Words(texts[a:b])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n.astype(np.int64))], ["print", "n"])

    rows = common.map_batches(common.keyed_texts(docs).select("text"), run, "print long, n long")
    counted = rows.groupBy("print").agg(F.sum("n").alias("n"))
    # A word that has the share overall has it of the total; the total comes with the counts.
    stored = materialize(counted, "word-prints")
    total = stored.agg(F.sum("n")).first()[0] or 0
    found = stored.where(F.col("n") >= share * total).select("print").toArrow().column("print").to_numpy()
    return np.sort(found.view(np.uint64))


def signatures(texts: list[str], common_words: np.ndarray, chain: int = CHAIN, distance: int = DISTANCE) -> list[np.ndarray]:
    """The sorted, distinct signatures of each text.

    A signature is an anchor with the next `chain` content words behind it, every `distance`-th, within
    the text. A text that has words but no whole chain has one signature, of all its words.
    """
    words = Words(texts)
    prints = word_prints(words)
    place = np.searchsorted(common_words, prints)
    is_anchor = np.zeros(len(prints), bool)
    if len(common_words):
        is_anchor = common_words[np.minimum(place, len(common_words) - 1)] == prints
    at, content = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
    steps = np.searchsorted(content, at)[:, None] + np.arange(chain) * distance + distance - 1
    whole = steps[:, -1] < len(content) if len(at) else np.zeros(0, bool)
    at, steps = at[whole], steps[whole]
    links = content[steps]
    same = words.text[links[:, -1]] == words.text[at] if len(at) else np.zeros(0, bool)
    at, links = at[same], links[same]
    value = prints[at] * _FACTORS[0]
    for c in range(chain):
        value = value + mixed(prints[links[:, c]] + np.uint64(c)) * _FACTORS[c + 1]
    value = mixed(value)
    limits = np.concatenate(([0], np.cumsum(words.counts)))
    cuts = np.searchsorted(at, limits)
    out = []
    for i in range(len(texts)):
        own = value[cuts[i] : cuts[i + 1]]
        if not len(own) and words.counts[i]:
            own = np.array([_sequence(words, int(limits[i]), int(limits[i + 1]))], np.uint64)
        out.append(np.unique(own))
    return out


def _sequence(words: Words, a: int, b: int) -> int:
    """A hash of the words a..b-1, whatever parts them."""
    return xxhash.xxh64_intdigest(words.compact[words.starts[a] : words.ends[b - 1]].tobytes().translate(_NO_CUT))


def fingerprint(found: np.ndarray) -> str:
    """A set of signatures as text: its size and a digest, 128 bits."""
    return f"{len(found)}:{xxhash.xxh3_128_hexdigest(found.astype('<u8').tobytes())}"


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Shared share of all signatures (Jaccard), 0 where it is below `least`; two empty sets are equal.

    Sets whose sizes alone forbid `least` are not looked at, equal ones not merged.
    """
    small, large = sorted((len(a), len(b)))
    if small < least * large or not small:
        return float(large == 0)
    if small == large and np.array_equal(a, b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (len(a) + len(b) - both)
    return found if found >= least else 0.0


def signed(docs: DataFrame, share: float = ANCHOR_SHARE, chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """`(doc_id, fingerprint, signatures)`, a row per row of `docs`; signatures are sorted longs."""
    shared = docs.sparkSession.sparkContext.broadcast(anchors(docs, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in chunks([len(t) for t in texts]):
                sets = signatures(texts[a:b], shared.value, chain, distance)
                columns = [ids.slice(a, b - a), pa.array(map(fingerprint, sets), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "fingerprint", "signatures"],
                )

    return common.map_batches(common.keyed_texts(docs), run, "doc_id long, fingerprint string, signatures array<long>")


# --- Each document against its edited text and the next document ----------------------------------

_ANSWER = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_signatures long"
)


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as much of the following one's start."""
    tail = len(text) // 3
    return text[: len(text) - tail] + following[:tail]


def _compared(ids: list, texts: list[str], following: list[str], common_words: np.ndarray) -> list[list]:
    """Answers for texts with the texts that follow them, gathered to chunks."""
    out: list[list] = [[] for _ in range(8)]
    for a, b in chunks([len(t) + len(f) for t, f in zip(texts, following)]):
        changed = [edited(t, f) for t, f in zip(texts[a:b], following[a:b])]
        # What follows a text is mostly the next text of the chunk: its set is made once.
        run = [*texts[a:b], *(f for t, f in zip([*texts[a + 1 : b], None], following[a:b]) if f is not t)]
        sets = signatures([*run, *changed], common_words)
        own, more, after = sets[: b - a], iter(sets[b - a : len(run)]), sets[len(run) :]
        for i in range(b - a):
            text = texts[a + i]
            is_next = i + 1 < b - a and following[a + i] is texts[a + i + 1]
            next_set = own[i + 1] if is_next else next(more)
            row = (
                ids[a + i], len(text), hashlib.sha256(changed[i].encode()).hexdigest(), fingerprint(own[i]),
                fingerprint(after[i]), likeness(own[i], after[i]), likeness(own[i], next_set), len(own[i]),
            )
            for column, value in zip(out, row):
                column.append(value)
    return out


def _arrays(columns: list[list]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return [pa.array(c, k) for c, k in zip(columns, kinds)]


def compare_with_next(docs: DataFrame, share: float = ANCHOR_SHARE) -> DataFrame:
    """Fingerprints of every text and its edited text (see `edited`), and how alike they are.

    Documents follow each other by descending id (null ids last, ties by text), the first follows the
    last. They are dealt to ranges of that order, their texts compressed, and each range is walked once;
    only the two texts at a range's ends meet those of other ranges, in a second small step. A null
    text is empty, rows repeat, one document follows itself, an empty table gives no rows. Only `doc_id`
    and `text` are read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(anchors(docs, share))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            tie = pa.array([xxhash.xxh64_intdigest(r) - (1 << 63) for r in raw], pa.int64())
            packed = pa.array(map(packer.compress, raw), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tie, packed], ["doc_id", "tie", "packed"])

    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = common.map_batches(common.keyed_texts(docs), squeeze, "doc_id long, tie long, packed binary")
    dealt = small.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    names = [f.split()[0] for f in _ANSWER.split(", ")] + ["range", "end", "packed"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, part, last = zstandard.ZstdDecompressor(), TaskContext.get().partitionId(), None

        def edge(doc_id, packed: bytes, end: str) -> pa.RecordBatch:
            empty = _arrays([[doc_id], *([None] for _ in range(7))])
            return pa.RecordBatch.from_arrays([*empty, pa.array([part]), pa.array([end]), pa.array([packed], pa.binary())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, packed = batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist()
            texts = [opener.decompress(p).decode() for p in packed]
            if last is None:
                yield edge(ids[0], packed[0], "first")
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = (ids[-1], texts[-1], packed[-1])
            done = _arrays(_compared(ids[:-1], texts[:-1], texts[1:], shared.value))
            n = len(done[0])
            yield pa.RecordBatch.from_arrays(
                [*done, pa.array([part] * n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], names
            )
        if last is not None:
            yield edge(last[0], last[2], "last")

    stored = materialize(common.map_batches(dealt, walk, _ANSWER + ", range long, end string, packed binary"), "compared")
    firsts = stored.where("end = 'first'").select("range", F.col("packed").alias("following"))
    lasts = stored.where("end = 'last'").select("range", "doc_id", "packed")
    # One row per range, without texts: which range comes next, the first one after the last.
    one = Window.orderBy("range")
    turns = firsts.select("range").select(
        "range", F.coalesce(F.lead("range").over(one), F.min("range").over(one.rowsBetween(Window.unboundedPreceding, 0))).alias("after")
    )
    meets = lasts.join(turns, "range").join(firsts.withColumnRenamed("range", "after"), "after")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, following = ([opener.decompress(p).decode() for p in batch.column(c).to_pylist()] for c in ("packed", "following"))
            columns = _compared(batch.column("doc_id").to_pylist(), texts, following, shared.value)
            yield pa.RecordBatch.from_arrays(_arrays(columns), names[:8])

    closed = common.map_batches(meets.select("doc_id", "packed", "following"), meet, _ANSWER)
    return stored.where("end is null").select(*names[:8]).unionByName(closed)
