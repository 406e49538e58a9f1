"""Packs tokenised documents into sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnaround.llm import common
from turnaround.sources.storage import materialize

WINDOW = 2048
END_ID = 1
#: Combinations are planned in units of so many ids, of which a piece in one loses less than one.
UNIT = 8
#: Deals of the pieces of one length at most.
SALTS = 1024
#: Pieces in an enumerated combination at most.
DEPTH = 3
#: Entries of a worker's cache. A full cache becomes the old one, from which what is met again moves on;
#: the one that was old is forgotten.
CACHE_PARTS = 5 << 16
#: Texts are split into words so many bytes at a time; a longer text is split alone.
SLICE_BYTES = 4 << 20
_GROUP = 128
#: White space to Python's split() but not to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: White space beyond ASCII, to Python's split(), to Arrow's and to the tokenizer.
_WIDE_BLANKS = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks behind letters are a pre-token of their own, which the tokenizer encodes apart.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


class Encoder:
    """Ids of texts, as unsigned 32-bit numbers.

    The tokenizer never looks across white space, so texts are split into words and every distinct word
    of a slice is met once. A word of letters with marks behind them is put together from both: the
    same letters come with many marks and, as the tokenizer folds case, in either case. What words are
    made of is cached.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _ids(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Parts are one pre-token each, and a pre-token's last id ends a word: many are encoded as one
        text and cut apart behind those ids."""
        groups = [parts[i : i + _GROUP] for i in range(0, len(parts), _GROUP)]
        for group, whole in zip(groups, self._ids([" ".join(g) for g in groups])):
            cuts = (np.flatnonzero(self.ends[np.frombuffer(whole, "<u4")]) * 4 + 4).tolist()
            if len(cuts) == len(group):
                self.cache.update(zip(group, (whole[a:b] for a, b in zip([0, *cuts], cuts))))
            else:
                self.cache.update(zip(group, self._ids(group)))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        # Words and ids hold no cycles; a collector that walks the lists of millions finds nothing.
        collects = gc.isenabled()
        gc.disable()
        try:
            column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
            coded = column.dictionary_encode()  # copies are encoded once
            unique, ids, start, size = coded.dictionary, [], 0, 0
            for i, n in enumerate(_listed(pc.binary_length(unique))):
                size += n
                if size >= SLICE_BYTES or i == len(unique) - 1:
                    ids += self._encode(unique.slice(start, i + 1 - start))
                    start, size = i + 1, 0
            return [ids[i] for i in _listed(coded.indices)]
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> list[bytes]:
        mixed = pc.match_substring_regex(texts, f"[{_SEPARATORS}]")
        plain, odd = texts.filter(pc.invert(mixed)), iter(self._ids(_listed(texts.filter(mixed))))
        wide = pc.any(pc.match_substring_regex(plain, f"[{_WIDE_BLANKS}]")).as_py()
        split = pc.utf8_split_whitespace(plain) if wide else pc.ascii_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        known, at = self._words(words.dictionary).__getitem__, _listed(words.indices)
        ends = iter(_listed(pc.cumulative_sum(pc.list_value_length(split))))
        out, start = [], 0
        for m in _listed(mixed):
            if m:
                out.append(next(odd))
            else:
                end = next(ends)
                out.append(b"".join(map(known, at[start:end])))
                start = end
        return out

    def _words(self, words: pa.Array) -> list[bytes]:
        trimmed = pc.utf8_rtrim(words, _MARKS)
        ascii_ = pc.ascii_is_alpha(trimmed)
        letters, marks, odd = _listed(pc.if_else(ascii_, pc.ascii_lower(trimmed), trimmed)), [], []
        for i, (word, part, sure) in enumerate(zip(_listed(words), letters, _listed(ascii_))):
            if sure or _plain(part):
                marks.append(word[len(part) :])
            else:
                marks.append("")
                letters[i] = word
                odd.append(word)
        if len(self.cache) > CACHE_PARTS:
            self.old, self.cache = self.cache, {}
        self.cache[""] = b""
        self._know(letters, set(odd))
        self._know(marks, set())
        get = self.cache.__getitem__
        return [a + b for a, b in zip(map(get, letters), map(get, marks))]

    def _know(self, parts: list[str], odd: set[str]) -> None:
        """Brings all parts into the cache; odd ones may be several pre-tokens and are encoded apart."""
        new = set(parts).difference(self.cache)
        new.discard("")
        old = self.old
        moved = {p: old[p] for p in new & old.keys()}
        self.cache.update(moved)
        new.difference_update(moved)
        self._learn(list(new - odd))
        apart = list(new & odd)
        for at in range(0, len(apart), 4096):
            self.cache.update(zip(apart[at : at + 4096], self._ids(apart[at : at + 4096])))


def _listed(values: pa.Array) -> list:
    """`to_pylist` by way of numpy, a tenth of its time for millions of short values."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _plain(letters: str) -> bool:
    """Whether normalising keeps these letters, not all ASCII, one pre-token of letters."""
    return letters.isalpha() and letters.lower().isalpha() and unicodedata.is_normalized("NFC", letters)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


common.keeps(__name__, _encoder.cache_clear)


def cut(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenises documents and cuts each at every `window` ids: one row per piece.

    `(doc_id, start, length, ids_crc32, doc_tokens, ids)`; each document's ids end with `end_id`, so a
    null or empty text is one piece of one id. `ids` holds little-endian unsigned 32-bit numbers and
    is left out without `with_ids`. `spread` numbers a task's pieces, to deal equal lengths out.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = _encoder(path), TaskContext.get().partitionId() * 7919
        for batch in batches:
            at, start, length, crc, total, ids = [], [], [], [], [], []
            for i, found in enumerate(encoder.encode(batch.column("text"))):
                found += end
                for s in range(0, len(found), 4 * window):
                    piece = found[s : s + 4 * window]
                    at.append(i)
                    start.append(s // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(found) // 4)
                    if with_ids:
                        ids.append(piece)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(total, pa.int64()),
                "spread": pa.array(range(n, n + len(at)), pa.int64()),
            }
            n += len(at)
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, spread long"
    return common.map_batches(common.keyed_texts(docs), run, schema + (", ids binary" if with_ids else ""))


# --- The plan: works on the histogram of lengths alone, so its size is bounded by the window -------


def combinations_filling(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every multiset of up to `depth` lengths, in units, that fills a window exactly."""
    out: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            for u in range(min(left, parts[-1] if parts else units), 0, -1):
                if u * (depth - len(parts)) >= left:
                    grow((*parts, u), left - u)

    grow((), units)
    return out


def nnls(columns: list[tuple[int, ...]], target: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' lengths nearest to the histogram.

    Active-set least squares: the column with the steepest descent joins, the others of the set are
    solved again, and columns that turn negative leave.
    """
    a = np.zeros((len(target), len(columns)))
    for j, parts in enumerate(columns):
        for u in parts:
            a[u, j] += 1
    x, active = np.zeros(len(columns)), np.zeros(len(columns), bool)
    tolerance = 1e-6 * max(1.0, float(np.abs(target).max()))
    for _ in range(3 * len(target)):
        gradient = np.where(active, -np.inf, a.T @ (target - a @ x))
        best = int(gradient.argmax())
        if gradient[best] <= tolerance:
            break
        active[best] = True
        while active.any():
            at = np.flatnonzero(active)
            part = a[:, at]  # the ridge keeps dependent columns solvable
            solved = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(at)), part.T @ target)
            low = solved <= 1e-12
            if not low.any():
                x[:] = 0
                x[at] = solved
                break
            old = x[at]
            step = np.min(old[low] / np.maximum(old[low] - solved[low], 1e-300))
            x[at] = old + step * (solved - old)
            gone = at[low & (x[at] <= 1e-9)]
            if not len(gone):
                gone = at[[int(np.argmin(np.where(low, x[at], np.inf)))]]
            active[gone] = False
            x[gone] = 0
    return x


def fill(histogram: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that fill windows exactly: histogram[u] pieces of u units, of which some stay.

    The least-squares repeats are rounded to what is there.
    """
    left, out = histogram.astype(np.int64).copy(), []

    def take(parts: tuple[int, ...], repeats: int) -> None:
        if repeats > 0:
            out.append((parts, int(repeats)))
            for u in parts:
                left[u] -= repeats

    def room(parts: tuple[int, ...]) -> int:
        return min(int(left[u]) // parts.count(u) for u in set(parts))

    if left[units]:
        take((units,), int(left[units]))
    if left.any():
        columns = [c for c in combinations_filling(units) if len(c) > 1 and all(left[u] for u in c)]
        if columns:
            x = nnls(columns, left.astype(float))
            for j in np.argsort(-x, kind="stable"):
                take(columns[j], min(int(round(x[j])), room(columns[j])))
    return out


def greedy(histogram: np.ndarray, space: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) for all pieces of a histogram of lengths: longest that fit first, a whole
    run of equal windows at a time."""
    left, out = histogram.astype(np.int64).copy(), []
    while left.any():
        parts, room, used = [], space, np.zeros_like(left)
        while True:
            fits = np.flatnonzero((left - used)[: room + 1] > 0)
            if not len(fits):
                break
            u = int(fits[-1])
            many = min(room // u, int(left[u] - used[u]))
            parts += [u] * many
            used[u] += many
            room -= many * u
        repeats = int(min(left[u] // used[u] for u in np.flatnonzero(used)))
        out.append((tuple(parts), repeats))
        left -= used * repeats
    return out


def plan(histogram: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) so that every counted piece has its place: what fills windows, then the rest."""
    out, left = fill(histogram, units), histogram.astype(np.int64).copy()
    for parts, repeats in out:
        for u in parts:
            left[u] -= repeats
    return out + greedy(left, units)


def _segments(patterns: list[tuple[tuple[int, ...], int]], sequence: int = 0) -> tuple[dict[int, np.ndarray], int]:
    """For each length the ranges of ranks: from, first sequence, repeats, first slot; and the sequences."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    for parts, repeats in patterns:
        slot = 0
        for u in sorted(set(parts), reverse=True):
            many = parts.count(u)
            rows.setdefault(u, []).append((taken.get(u, 0), sequence, repeats, slot))
            taken[u] = taken.get(u, 0) + repeats * many
            slot += many
        sequence += repeats
    return {u: np.array(r, np.int64) for u, r in rows.items()}, sequence


def places(histogram: np.ndarray, window: int, unit: int) -> tuple:
    """Where every piece of a histogram of exact lengths goes: combinations are planned in units, of a
    unit's pieces the longest take part in them, and the rest is packed greedily by exact lengths.

    `(unit_of, before, inside, filled, rest)`: a length's unit, how many pieces of the unit are longer,
    how many of the length combinations hold, and the segments of both parts."""
    units = -(-window // unit)
    lengths = np.arange(window + 1)
    unit_of = -(-lengths // unit)
    by_unit = np.bincount(unit_of, histogram, units + 1).astype(np.int64)
    patterns = fill(by_unit, units)
    filled, n = _segments(patterns)
    taken = np.zeros(units + 1, np.int64)
    for parts, repeats in patterns:
        for u in parts:
            taken[u] += repeats
    before = np.cumsum(by_unit)[unit_of] - np.cumsum(histogram)
    inside = np.clip(taken[unit_of] - before, 0, histogram)
    rest, _ = _segments(greedy(histogram - inside, window), n)
    return unit_of, before, inside, filled, rest


def locate(length: np.ndarray, rank: np.ndarray, planned: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and slot of the rank-th pieces of given lengths in a plan of `places`."""
    unit_of, before, inside, filled, rest = planned
    sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    for x in np.unique(length):
        mine = length == x
        for at, table, first in (
            (np.flatnonzero(mine & (rank < inside[x])), filled.get(int(unit_of[x])), before[x]),
            (np.flatnonzero(mine & (rank >= inside[x])), rest.get(int(x)), -inside[x]),
        ):
            if len(at):
                own = rank[at] + first
                row = table[np.searchsorted(table[:, 0], own, side="right") - 1]
                own = own - row[:, 0]
                sequence[at] = row[:, 1] + own % row[:, 2]
                slot[at] = row[:, 3] + own // row[:, 2]
    return sequence, slot


def pack(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces of at most `window` ids (columns `doc_id`, `start`,
    `length`, `spread`); `pieces` should be a stored table, it is read three times.

    The plan is made from the histogram of lengths: at most a window's counts for each of SALTS salts
    reach the driver, and the plan broadcast back is bounded by them. Pieces of a length are ranked
    within salts, so a length that a third of all pieces share is dealt to many tasks.
    """
    spark = pieces.sparkSession
    salts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8), SALTS)
    keyed = pieces.withColumn("salt", F.pmod("spread", F.lit(salts)).cast("int"))
    counts = np.zeros((window + 1, salts), np.int64)
    for r in keyed.groupBy("length", "salt").count().collect():
        counts[r["length"], r["salt"]] = r["count"]
    base = np.cumsum(counts, axis=1) - counts
    shared = spark.sparkContext.broadcast((base, places(counts.sum(axis=1), window, unit)))
    ranked = keyed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "spread")) - 1
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, planned = shared.value
        for batch in batches:
            length, salt = batch.column("length").to_numpy(), batch.column("salt").to_numpy()
            sequence, slot = locate(length, batch.column("rank").to_numpy() + base[length, salt], planned)
            keep = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    names = [c for c in pieces.columns if c != "spread"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "spread"]
    placed = common.map_batches(ranked, place, ", ".join([*fields, "sequence_id long", "slot long"]))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: `(sequence_id, n_ids, ids, pieces)`, ids little-endian unsigned
    32-bit, pieces in order. A sequence has a window's ids at most, so its group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("pieces")).select(
        "sequence_id", "n_ids",
        F.expr("aggregate(pieces, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"),
        F.expr("transform(pieces, p -> struct(p.doc_id, p.start, p.length, p.offset))").alias("pieces"),
    )


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """All documents packed: one row per piece, see `cut` and `pack`.

    A null text is an empty document (its end id alone is a piece). Null ids and repeated rows are
    documents like any other; ties in length are ordered by id. An empty table packs to no rows.
    Columns besides `doc_id` and `text` are not read.
    """
    return pack(materialize(cut(docs, path, window, with_ids=with_ids), "pieces"), window)
