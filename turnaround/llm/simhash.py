"""Near-duplicate texts by 64-bit SimHash fingerprints, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnaround.llm import common
from turnaround.sources.storage import materialize

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16
_PAIRS = 1 << 20


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text's word shingles (repeats count), unsigned; zero without words.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage
    return; only A-Z are lower-cased. A text of fewer words than a shingle is one shingle.
    """
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """`(doc_id, fp)` for every row of `docs`, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return common.map_batches(common.keyed_texts(docs), run, "doc_id long, fp long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """The 64 bits as max_bits + 2 blocks (shift, bits): two fingerprints that differ in at most
    max_bits bits agree in two whole blocks at least."""
    n, out, shift = max_bits + 2, [], 0
    for i in range(n):
        bits = 64 // n + (i < 64 % n)
        out.append((shift, bits))
        shift += bits
    return out


def bucketed(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Every distinct fingerprint once per pair of blocks, keyed by the bits of both."""

    def block(shift: int, bits: int) -> Column:
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))

    keys = [
        F.shiftleft(block(*a), b[1]).bitwiseOR(block(*b)).bitwiseOR(F.lit(i << 56))
        for i, (a, b) in enumerate(combinations(_blocks(max_bits), 2))
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))


class Trie:
    """Path-compressed binary tries over sorted, distinct fingerprints, one trie per bucket.

    A node is a range of the sorted array; `known` masks the leading bits its members share.
    """

    def __init__(self, fps: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.fps = fps
        lo, hi, known, child = [], [], [], []
        frontier, first = (starts, ends), 0
        self.roots = np.arange(len(starts))
        while len(frontier[0]):
            a, b = frontier
            first += len(a)
            differ = fps[a] ^ fps[b - 1]
            top = np.frexp((differ >> np.uint64(11)).astype(np.float64))[1] + 10
            small = differ < np.uint64(1 << 11)
            top[small] = np.frexp(differ[small].astype(np.float64))[1] - 1
            inner = b - a > 1
            shift = np.where(inner, top, -1) + 1
            mask = np.where(shift > 63, np.uint64(0), ~np.uint64(0) << np.minimum(shift, 63).astype(np.uint64))
            lo.append(a), hi.append(b), known.append(mask)
            kids = np.full(len(a), -1)
            kids[inner] = first + 2 * np.arange(inner.sum())
            child.append(kids)
            a, b = a[inner], b[inner]
            bit = np.uint64(1) << top[inner].astype(np.uint64)
            left, right = a.copy(), b.copy()  # the first member whose deciding bit is set
            while (open_ := left < right).any():
                mid = (left + right) // 2
                is_set = (fps[np.minimum(mid, len(fps) - 1)] & bit) != 0
                right = np.where(open_ & is_set, mid, right)
                left = np.where(open_ & ~is_set, mid + 1, left)
            frontier = np.ravel(np.column_stack((a, left))), np.ravel(np.column_stack((left, b)))
        self.lo, self.hi = np.concatenate(lo), np.concatenate(hi)
        self.known, self.child = np.concatenate(known), np.concatenate(child)

    def forest(self, max_bits: int = MAX_BITS) -> np.ndarray:
        """For each fingerprint the least member it is connected to by links of max_bits or fewer.

        Pairs of nodes are traversed together. Bits known of both that differ count against the
        budget, and a pair beyond it is dropped with all below it. Budgets rise from one bit, and a
        pair whose members already hang together is dropped too, so a dense group of near copies
        costs about its size and not all its pairs.
        """
        label = np.arange(len(self.fps))
        for budget in range(1, max_bits + 1):
            todo = [(self.roots, self.roots)]
            while todo:
                a, b = todo.pop()
                if len(a) > _PAIRS:
                    todo += [(a[i : i + _PAIRS], b[i : i + _PAIRS]) for i in range(0, len(a), _PAIRS)]
                    continue
                change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
                whole = change[self.hi - 1] == change[self.lo]
                group = np.where(whole, label[self.lo], -1)
                bits = (self.fps[self.lo[a]] ^ self.fps[self.lo[b]]) & self.known[a] & self.known[b]
                keep = np.bitwise_count(bits) <= budget
                keep &= (group[a] < 0) | (group[a] != group[b])
                a, b = a[keep], b[keep]
                leaf_a, leaf_b = self.child[a] < 0, self.child[b] < 0
                done = leaf_a & leaf_b
                if done.any():
                    label = merge(label, self.lo[a[done]], self.lo[b[done]])
                a, b = a[~done], b[~done]
                same = a == b
                if same.any():
                    x = self.child[a[same]]
                    todo.append((np.concatenate((x, x + 1, x)), np.concatenate((x, x + 1, x + 1))))
                a, b = a[~same], b[~same]
                if len(a):
                    swap = self.known[a] > self.known[b]  # split the node of which less is known
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    x = self.child[a]
                    todo.append((np.concatenate((x, x + 1)), np.concatenate((b, b))))
        return label


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the groups of a[i] and b[i]; labels point to the least member."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links `(u, v)` that span every group of distinct fingerprints `fp` within max_bits bits."""

    def emit(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        starts, ends = cuts, np.concatenate((cuts[1:], [len(bucket)]))
        many = ends - starts > 1
        if not many.any():
            return None
        keep = np.repeat(many, ends - starts)
        fp, sizes = fp[keep].view(np.uint64), (ends - starts)[many]
        ends = np.cumsum(sizes)
        order = np.lexsort((fp, np.repeat(np.arange(len(sizes)), sizes)))
        fp = fp[order]
        label = Trie(fp, ends - sizes, ends).forest(max_bits)
        tied = np.flatnonzero(label != np.arange(len(label)))
        if not len(tied):
            return None
        u, v = fp[label[tied]].view(np.int64), fp[tied].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("bucket").to_numpy(), batch.column("fp").to_numpy()))
            size += len(held[-1][0])
            if size >= 1 << 18 and held[-1][0][-1] != held[0][0][0]:
                bucket, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if (out := emit(bucket[:cut], fp[:cut])) is not None:
                    yield out
                held, size = [(bucket[cut:], fp[cut:])], len(bucket) - cut
        if size:
            if (out := emit(*(np.concatenate(x) for x in zip(*held)))) is not None:
                yield out

    spread = bucketed(fps, max_bits).repartition("bucket").sortWithinPartitions("bucket")
    return common.map_batches(spread, run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, width: int = SHINGLE_WORDS) -> DataFrame:
    """`(doc_id, fp, component_id)`: one row per row of `docs`.

    Fingerprints that differ in at most `max_bits` bits are linked, equal ones included, and
    `component_id` is the smallest document id that links reach. A null text is an empty one
    (fingerprint zero, linked like any other). Rows with a null id are fingerprinted and linked;
    they never name a component unless none of its rows has an id (then it is null). Repeated rows
    stay repeated; an empty table gives an empty result. Only `doc_id` and `text` are read.

    Copies are one trie entry: fingerprints are reduced to distinct ones first, by a pre-aggregated
    shuffle, and only those are bucketed, joined and connected.
    """
    prints = materialize(fingerprints(docs, width), "fingerprints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    linked = materialize(common.components(links(firsts.select("fp"), max_bits)), "linked-fingerprints")
    named = linked.join(firsts.withColumnRenamed("fp", "node"), "node")
    least = named.groupBy("component").agg(F.min("first_id").alias("least_id"))
    reached = linked.join(least, "component").select(F.col("node").alias("fp"), "least_id", F.lit(True).alias("linked"))
    classes = firsts.join(reached, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("least_id")).otherwise(F.col("first_id")).alias("component_id")
    )
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
