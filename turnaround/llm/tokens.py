"""Token counts of whole texts: a broadcast table of frequent pre-tokens, a worker cache for the rest."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnaround.llm import common

#: Bounds of the broadcast table: entries, and bytes of one entry (16.8 MB at most).
TABLE_ENTRIES = 1 << 18
ENTRY_BYTES = 64
#: Entries of a task's own summary, and of a worker's cache.
SUMMARY_ENTRIES = 1 << 15
CACHE_ENTRIES = 1 << 19
TOKEN_LIMIT = 4096
#: Code points that the library reads as a space.
_SPACE = "▁"
_UNIT = re.compile(" *[^ ]+| +")
_loaded: dict = {}
common.keeps(__name__, _loaded.clear)


def pre_tokens(text: str) -> list[str]:
    """A text's pre-tokens: each run of spaces with the word behind it, less its first space.

    The library puts a space before a text, and no piece of the vocabulary goes on with a space after
    another character, so that no merge crosses into the next run of spaces.
    """
    if not text:
        return []
    if _SPACE in text:
        text = text.replace(_SPACE, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [u[1:] for u in _UNIT.findall(" " + text)]


class TokenCounter:
    """Lengths of pre-tokens in tokens: the broadcast table first, then a bounded cache."""

    def __init__(self, path: str, table: dict[str, int]):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = table
        self.cache = dict(table)

    def counts(self, texts: list[str]) -> list[int]:
        split = [pre_tokens(t) for t in texts]
        missing = list(set().union(*split).difference(self.cache)) if split else []
        if missing:
            if len(self.cache) + len(missing) > CACHE_ENTRIES + len(self.table):
                self.cache = dict(self.table)
                missing = list(set().union(*split).difference(self.cache))
            for at in range(0, len(missing), 4096):
                part = missing[at : at + 4096]
                self.cache.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
            self.cache[""] = 1  # a space with no word behind it
        get = self.cache.__getitem__
        return [sum(map(get, words)) for words in split]


def frequent(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The most frequent pre-tokens of all texts with their lengths in tokens.

    Every task reads all its texts and keeps a bounded summary (rare entries go when it is full);
    only the summaries are added up. What the table holds decides speed, never results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(pre_tokens(text))
            if len(seen) > 8 * SUMMARY_ENTRIES:
                seen = Counter(dict(seen.most_common(SUMMARY_ENTRIES)))
        top = [(w, n) for w, n in seen.most_common(SUMMARY_ENTRIES) if n > 1 and len(w.encode()) <= ENTRY_BYTES]
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    summaries = common.map_batches(docs.select(F.coalesce("text", F.lit("")).alias("text")), run, "word string, n long")
    top = summaries.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries)
    words = [r.word for r in top.select("word").toLocalIterator()]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    lengths = dict(zip(words, map(len, model.encode(words, num_threads=1)))) if words else {}
    lengths[""] = 1
    return lengths


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """`(doc_id, n_bytes, n_tokens, over_limit)` for every row: UTF-8 bytes, and tokens of the whole
    text as the library at `path` gives them, without begin, end or added special tokens.

    A null text is an empty one (zero tokens). Null ids, repeated rows and very long texts are rows
    like any other; an empty table gives an empty result; columns besides `doc_id` and `text` are not
    read. No pre-token is shuffled: texts are counted where they are read.
    """
    table, mark = docs.sparkSession.sparkContext.broadcast(frequent(docs, path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _loaded.get("table") != mark:  # a worker keeps its cache from task to task
            _loaded["counter"], _loaded["table"] = TokenCounter(path, table.value), mark
        counter = _loaded["counter"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = counter.counts(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([x > limit for x in n], pa.bool_()),
                }
            )

    return common.map_batches(
        common.keyed_texts(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
