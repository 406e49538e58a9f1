"""Spelling variants against brute force: all pairs, hot prefixes, chains of forms, odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from turnaround.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows, length=6, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def plain(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(tuple(r) for r in spelling.variants(docs).collect())


def vocabulary(rng, many, letters, lengths=(5, 10), stem=""):
    words = {stem + "".join(rng.choice(letters) for _ in range(rng.randrange(*lengths))) for _ in range(many)}
    return sorted(words)


@pytest.mark.parametrize("slice_, block", [(1 << 14, 1 << 13), (40, 7)])
def test_variants_equal_brute_force(spark, monkeypatch, slice_, block):
    monkeypatch.setattr(spelling, "SLICE", slice_)
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(slice_)
    rows, i = [], 0
    for words in (vocabulary(rng, 150, "abé"), vocabulary(rng, 100, "abc", (4, 7), "internat"), ["x" * 300, "x" * 301, "y" + "x" * 300]):
        for w in words:
            for _ in range(rng.choice([4, 5, 6, 30, 200])):
                rows.append((i % 37, w))
                i += 1
    rng.shuffle(rows)
    docs = [(d, " ".join(w for e, w in rows[k::20] if e == d)) for k in range(20) for d in range(37)]
    expected = plain(docs)
    assert any(r[1] not in (None, r[2]) for r in expected)  # chains of two and more
    assert found(spark, docs) == expected


def test_pairs_of_a_list_equal_all_pairs():
    rng = random.Random(9)
    for letters in ("ab", "abcdef"):
        words = [w.encode() for w in vocabulary(rng, 200, letters, (1, 7))]
        listing = spelling.SortedList(words)
        for fixed in (0, 1, 2):
            q, j = listing.near(words, [min(fixed, len(w)) for w in words])
            pairs = [(words[a], words[b]) for a, b in zip(q.tolist(), j.tolist())]
            expected = {
                (a, b) for a in words for b in words
                if one_edit(a.decode(), b.decode()) and a[:fixed] == b[: min(fixed, len(a))]
            }
            assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_letters_go_where_the_hash_says(spark):
    words = [f"{a}{b}{c}lettered" for a in "abcde" for b in "fghij" for c in "klmno"]
    rows = [(d, " ".join(words)) for d in range(40)]
    expected = plain(rows)
    assert any(len(r[0]) < len(words[0]) for r in plain(rows * 5))
    assert found(spark, rows) == expected and found(spark, rows * 5) == plain(rows * 5)


def test_variants_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in spelling.variants(odd_docs).collect()) == plain(rows)
    assert spelling.variants(no_docs).collect() == []
    assert found(spark, [(None, "spelling Spelling spellings " * 6), (1, None), (1, "")]) == plain([(None, "spelling Spelling spellings " * 6)])
