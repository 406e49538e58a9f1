"""Spelling variants: words one edit apart, found by dynamic programming down a sorted list."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnaround.llm import common
from turnaround.sources.storage import materialize

#: Shortest word and rarest that count, and how much more often a word's form must occur.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Entries of a slice of the sorted list, and words sought in it at once.
SLICE, BLOCK = 1 << 14, 1 << 13
#: Of the words a slice begins and ends with, so many letters are kept to find it.
_EDGE = 64
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_FAR = 2


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH, damage: int = 199) -> DataFrame:
    """`(word, n)`: words of all texts, lower-cased (A-Z only), after the stated damage.

    Of a run, one letter goes if `damage` divides h, the crc32 of `<doc_id>:<run>`: that at h modulo the
    length. A null id is written `null`, a null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUNS.findall(text.translate(_LOWER))).items():
                    if len(word) >= least_length:
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        counts[word] += n
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

    return common.map_batches(common.keyed_texts(docs), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class SortedList:
    """Entries in order, as flat bytes (letters up to U+00FF are a byte each), with the length of the
    prefix each shares with the one before, and where the list leaves each of an entry's prefixes."""

    def __init__(self, entries: list[bytes]):
        self.entries, n = entries, len(entries)
        self.flat = np.frombuffer(b"".join(entries) + b"\0", np.uint8)
        self.length = np.fromiter(map(len, entries), np.int64, n)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        shared = [0] * (n + 1)
        for i in range(1, n):
            a, b = entries[i - 1], entries[i]
            k, most = 0, min(len(a), len(b))
            if a[:most] == b[:most]:
                k = most
            else:
                while a[k] == b[k]:
                    k += 1
            shared[i] = k
        self.shared = np.array(shared, np.int64)
        # leave[place(i, d)]: the first entry after i that does not begin with the d letters i begins with.
        starts = (self.offset[:n] + np.arange(n)).tolist()
        leave = np.empty(int(self.offset[n]) + n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            at, k, size = starts[i], shared[i + 1], len(entries[i])
            leave[at : at + size + 1] = i + 1
            if k:
                after = starts[i + 1]
                leave[at : at + k + 1] = leave[after : after + k + 1]
            leave[at] = n
        self.leave = leave

    def near(self, words: list[bytes], fixed: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, entry) one edit apart whose first `fixed` letters agree.

        Every word goes down its range of the list, all words in step. It holds a row of the edit matrix
        per letter, three cells wide; the row at the prefix shared with the next entry is taken up again.
        Where a row exceeds one edit, all entries with that prefix are skipped.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        fixed_at = np.array(fixed, np.int64)
        low = np.array([bisect_left(self.entries, w[:f]) for w, f in zip(words, fixed)], np.int64)
        # Letters sought, with a zero before and two behind each word.
        flat = np.frombuffer(b"".join(b"\0" + w + b"\0\0" for w in words) + b"\0", np.uint8)
        base = np.concatenate(([0], np.cumsum(size + 3)))[:-1] + 1
        place = np.concatenate(([0], np.cumsum(size + 3)))[:-1]  # a word's rows: one per letter and two more
        rows = np.full((int((size + 3).sum()) + 1, 3), _FAR, np.int8)
        first = place + fixed_at
        rows[first] = (1, 0, 1)
        rows[first[fixed_at == 0], 0] = _FAR
        q = np.array([i for i, (w, f, j) in enumerate(zip(words, fixed, low)) if j < len(self.entries) and self.entries[j][:f] == w[:f]], np.int64)
        j, d = low[q], fixed_at[q]
        found_q, found_j = [], []
        while len(q):
            # An entry that ends here: its distance is the row's cell at the word's end.
            done = d == self.length[j]
            if done.any():
                qe, je = q[done], j[done]
                cell = size[qe] - self.length[je] + 1
                ok = (cell >= 0) & (cell <= 2)
                hit = np.flatnonzero(ok)[rows[place[qe[ok]] + self.length[je[ok]], cell[ok]] == 1]
                found_q.append(qe[hit])
                found_j.append(je[hit])
            open_ = ~done
            nxt = j + 1
            skip = done.copy()
            if open_.any():
                qo, jo, do = q[open_], j[open_], d[open_]
                c = self.flat[self.offset[jo] + do]
                at = place[qo] + do
                old, letters = rows[at], base[qo] + do
                new = np.empty_like(old)
                new[:, 0] = np.minimum(old[:, 0] + (flat[letters - 1] != c), old[:, 1] + 1)
                new[:, 1] = np.minimum(np.minimum(old[:, 1] + (flat[letters] != c), old[:, 2] + 1), new[:, 0] + 1)
                new[:, 2] = np.minimum(old[:, 2] + (flat[np.minimum(letters + 1, len(flat) - 1)] != c), new[:, 1] + 1)
                new[:, 0][do == 0] = np.minimum(1, old[:, 1][do == 0] + 1)
                np.minimum(new, _FAR, out=new)
                new[:, 1][do + 1 > size[qo]] = _FAR
                new[:, 2][do + 2 > size[qo]] = _FAR
                rows[at + 1] = new
                over = new.min(axis=1) > 1
                where = np.flatnonzero(open_)
                skip[where[over]] = True
                nxt[where[over]] = self.leave[self.offset[jo[over]] + jo[over] + do[over] + 1]
                d[where[~over]] += 1
            j = np.where(skip, nxt, j)
            d = np.where(skip, self.shared[np.minimum(j, len(self.entries))], d)
            alive = (j < len(self.entries)) & (d >= fixed_at[q])
            q, j, d = q[alive], j[alive], d[alive]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_j])


def _entries(word: str) -> tuple[tuple[bytes, int], tuple[bytes, int]]:
    """A word as two entries of the list, as it is and backwards, each with the letters that must agree.

    Of two words one edit apart, either the first half of one (rounded down) begins the other or the
    rest of it ends the other.
    """
    code = word.encode("latin-1")
    half = len(code) // 2
    return (b"\1" + code, half + 1), (b"\2" + code[::-1], len(code) - half + 1)


def near_words(words: DataFrame) -> DataFrame:
    """`(word, n_near, best_n, best)` for the words that have near ones, `words` a stored `(word, n)`.

    The sorted list of all words, forwards and backwards, is dealt to slices of about SLICE entries.
    Every word goes to the slices that hold entries with its fixed letters, nearly always one each way;
    of more, those go out whose shared prefix is over one edit away. A task holds one slice and streams
    the words sought in it. The list of slices (two words cut to 64 letters each) is broadcast: a
    SLICE-th of the vocabulary.
    """
    spark = words.sparkSession
    slices = max(1, -(-2 * words.count() // SLICE))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names, counts = [], batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for word in names:
                out += [e for e, _ in _entries(word)]
            n = pa.array(np.repeat(np.array(counts, np.int64), 2))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), n], ["entry", "n"])

    dealt = common.map_batches(words, listed, "entry binary, n long").repartitionByRange(slices, "entry")
    stored = materialize(dealt.withColumn("slice", F.spark_partition_id().cast("long")), "word-list")
    edges = stored.groupBy("slice").agg(F.min("entry").alias("low"), F.max("entry").alias("high")).select(
        "slice", F.expr("substring(low, 1, {0})".format(_EDGE)).alias("low"), F.expr(f"substring(high, 1, {_EDGE})").alias("high")
    ).orderBy("low").collect()
    table = spark.sparkContext.broadcast([(r["slice"], bytes(r["low"]), bytes(r["high"])) for r in edges])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lows, highs = zip(*table.value) if table.value else ((), (), ())
        common_ = [_shared(a, b) for a, b in zip(lows, highs)]
        for batch in batches:
            to, entry, fixed = [], [], []
            for word in batch.column("word").to_pylist():
                for code, f in _entries(word):
                    prefix = code[:f][:_EDGE]
                    first = bisect_left(highs, prefix)
                    last = bisect_right(lows, prefix + b"\xff" * (_EDGE - len(prefix)))
                    for s in range(first, last):
                        if last - first == 1 or _reachable(code, f, common_[s]):
                            to.append(ids[s])
                            entry.append(code)
                            fixed.append(f)
            columns = [pa.array(to, pa.int64()), pa.array(entry, pa.binary()), pa.array([0] * len(to), pa.int64()), pa.array(fixed, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "entry", "n", "fixed"])

    sought = common.map_batches(words, routed, "slice long, entry binary, n long, fixed int")
    rows = stored.select("slice", "entry", "n", F.lit(-1).alias("fixed")).unionByName(sought)
    dealt = rows.repartition(max(slices, 2), "slice").sortWithinPartitions("slice", (F.col("fixed") >= 0), "entry")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, entries, counts, block = None, [], [], []
        listing = None
        for s, entry, n, fixed in _flat(batches):
            if s != here:
                if block:
                    yield _answers(listing, counts, block)
                here, entries, counts, block, listing = s, [], [], [], None
            if fixed < 0:
                entries.append(entry)
                counts.append(n)
                continue
            if listing is None:
                listing = SortedList(entries)
            block.append((entry, fixed))
            if len(block) == BLOCK:
                yield _answers(listing, counts, block)
                block = []
        if block:
            yield _answers(listing, counts, block)

    found = common.map_batches(dealt, search, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("slice", "entry", "n", "fixed")])


def _shared(a: bytes, b: bytes) -> bytes:
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[:k]


def _reachable(code: bytes, fixed: int, prefix: bytes) -> bool:
    """Whether some entry that begins with `prefix` can be one edit or less from `code`."""
    k = len(_shared(code, prefix))
    if k == len(prefix) or k < min(fixed, len(prefix)):
        return k == len(prefix)
    rest = prefix[k + 1 :]
    return code[k + 1 :].startswith(rest) or code[k:].startswith(rest) or code[k + 1 :].startswith(prefix[k:])


def _answers(listing: SortedList, counts: list[int], block: list[tuple[bytes, int]]) -> pa.RecordBatch:
    """Per word of a block its near words in a slice: how many, and the one of most occurrences."""
    block.sort()
    codes = [e for e, _ in block]
    out: dict[int, tuple[int, int, str]] = {}
    for i, j in zip(*(x.tolist() for x in listing.near(codes, [f for _, f in block]))):
        code, other = codes[i], listing.entries[j]
        if code[0] == 2:
            half = (len(code) - 1) // 2
            if code[: -half - 1 : -1] == other[: -half - 1 : -1]:
                continue  # the first halves agree too: found forwards
            other = other[:0:-1]
        else:
            other = other[1:]
        word, n = other.decode("latin-1"), counts[j]
        near, most, name = out.get(i, (0, -1, ""))
        if n > most or n == most and word < name:
            most, name = n, word
        out[i] = (near + 1, most, name)
    words = [(codes[i][1:] if codes[i][0] == 1 else codes[i][:0:-1]).decode("latin-1") for i in out]
    near, most, names = zip(*out.values()) if out else ((), (), ())
    arrays = [pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array(most, pa.int64()), pa.array(names, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "best_n", "best"])


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)` for every word of `least_length` letters that occurs
    `least_count` times.

    Words are near if one inserted, deleted or replaced letter parts them. A word's form is its near word
    of most occurrences (ties: the first in code-point order) if it occurs `ratio` times as often, else
    null; `root` follows forms to the last. Rows repeat and count each; a null text has no words; an
    empty table gives no rows. Only `doc_id` and `text` are read.
    """
    words = materialize(corpus_words(docs, least_length).where(F.col("n") >= least_count), "corpus-words")
    near = near_words(words)
    known = words.join(near, "word", "left").withColumn("form", F.expr(f"if(best_n >= {int(ratio)} * n, best, null)"))
    table = materialize(
        known.selectExpr("word", "form", "n", "coalesce(n_near, 0L) n_near", "if(form is null, null, best_n) form_n"), "word-forms"
    )
    # A form occurs more often than its word, so chains end; every round doubles the steps followed.
    steps = materialize(table.where("form is not null").selectExpr("word", "form root"), "word-roots")
    while True:
        ahead = steps.selectExpr("word root", "root further")
        joined = materialize(steps.join(ahead, "root", "left").selectExpr("word", "coalesce(further, root) root", "further"), "word-roots")
        steps = joined.select("word", "root")
        if not joined.where("further is not null").count():
            break
    return table.join(steps, "word", "left").selectExpr(
        "word", "form", "coalesce(root, word) root", "n", "n_near", "form_n"
    )
