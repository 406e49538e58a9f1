"""SpotSigs fingerprints against a plain reading of the method, and documents against the next."""

import re
from collections import Counter
from hashlib import sha256

import pytest

import __spark_entry__ as contract
from turnaround.llm import spotsigs


def plain_sets(texts, anchors, chain=2, distance=1):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        found = set()
        for i, w in enumerate(words):
            if w in anchors:
                content = [v for v in words[i + 1 :] if v not in anchors][distance - 1 :: distance][:chain]
                if len(content) == chain:
                    found.add((w, *content))
        out.append(found or ({tuple(words)} if words else set()))
    return out


def plain_anchors(texts, share=0.001):
    counts = Counter()
    for text in texts:
        counts.update(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    return {w for w, n in counts.items() if n >= share * sum(counts.values())}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """(doc_id, n_chars, edited sha, near_edited, near_next, size) of rows in their order."""
    texts = [t or "" for _, t in rows]
    following = texts[1:] + texts[:1]
    changed = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following)]
    common = plain_anchors(texts)
    own, after, nxt = (plain_sets(x, common) for x in (texts, changed, following))
    return [
        (d, len(t), sha256(c.encode()).hexdigest(), jaccard(a, b), jaccard(a, n), len(a))
        for (d, _), t, c, a, b, n in zip(rows, texts, changed, own, after, nxt)
    ]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def answers(frame):
    return sorted(
        ((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_signatures) for r in frame.collect()), key=key
    )


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)


def test_the_whole_table_equals_brute_force(spark, sf_dir, documents):
    frame = contract.queries()["op12_spotsigs"](spark, sf_dir)
    assert answers(frame) == sorted(plain(documents), key=key)
    rows = frame.collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(dict(documents)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert {r.fingerprint == r.edited_fingerprint for r in rows if r.near_edited < 1} == {False}


@pytest.mark.parametrize("ranges", ["1", "2", "50"])
def test_any_dealing_gives_the_same(spark, documents, ranges):
    some = documents[:23]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        frame = spotsigs.compare_with_next(spark.createDataFrame(some, "doc_id long, text string").repartition(3))
        assert answers(frame) == sorted(plain(some), key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("chain, distance", [(1, 1), (3, 2)])
def test_chains_as_written(documents, chain, distance):
    import numpy as np

    texts = [t or "" for _, t in documents[:40]] + ["", " . ", "the", "one two", "One\ttwo!"]
    common = sorted(plain_anchors(texts, 0.01))
    prints = np.sort(np.array([spotsigs.word_prints(spotsigs.Words([w]))[0] for w in common], np.uint64))
    found = spotsigs.signatures(texts, prints, chain, distance)
    assert [len(f) for f in found] == [len(p) for p in plain_sets(texts, set(common), chain, distance)]
    assert spotsigs.fingerprint(found[-1]) == spotsigs.fingerprint(found[-2]) != spotsigs.fingerprint(found[-3])


def test_likeness_prunes_by_size_only_what_is_below():
    import numpy as np

    a, b = np.arange(10, dtype=np.uint64), np.arange(2, 12, dtype=np.uint64)
    assert spotsigs.likeness(a, b) == 8 / 12 and spotsigs.likeness(a, b, 0.7) == 0 and spotsigs.likeness(a, a[:8], 0.8) == 0.8
    assert spotsigs.likeness(a[:0], a[:0], 0.8) == 1 and spotsigs.likeness(a, a[:0]) == 0 and spotsigs.likeness(a, a, 1) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    found = spotsigs.compare_with_next(odd_docs)
    assert found.count() == odd_docs.count() and spotsigs.compare_with_next(no_docs).collect() == []
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[1]) == 2 and by[1][0].fingerprint == by[1][1].fingerprint and max(r.near_next for r in by[1]) == 1
    assert by[2][0].n_chars == by[3][0].n_chars == 0 and by[2][0].near_edited == 1
    one = spark.createDataFrame([(None, "alone here")], "doc_id long, text string")
    assert [(r.doc_id, r.near_next) for r in spotsigs.compare_with_next(one).collect()] == [(None, 1.0)]
    signed = {r.doc_id: r for r in spotsigs.signed(odd_docs).collect()}
    assert signed[2].signatures == [] and signed[2].fingerprint == signed[3].fingerprint != signed[1].fingerprint
