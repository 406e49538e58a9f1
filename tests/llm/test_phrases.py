"""Phrase mining against brute force, with shared fingerprints, odd rows and repeated words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from turnaround.llm import grams, phrases


def plain(rows, most=3, least=10, inside=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                found = counts.setdefault(lang, Counter())
                found.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        frequent = [p for p in f if 2 <= len(p) and f[p] >= least]
        for p in frequent:
            a = f[p]
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = [
                q for q in frequent
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f[q] >= inside * a
            ]
            if not longer:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        kept.sort()
        out += [
            (lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(kept[:top], start=1)
        ]
    return sorted(out)


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    return sorted(tuple(r) for r in phrases.collocations(docs.repartition(5), **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["Éa", "éa", "X", "x", "\x1cz", " "]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n"]) for _ in range(n))
    return [(rng.choice(["en", "de", None, ""]), text(rng.randrange(60))) for _ in range(300)] + [("en", None), (None, "")]


def test_phrases_equal_brute_force(spark, rows):
    expected = plain(rows)
    assert expected and mined(spark, rows) == expected
    assert mined(spark, rows, most=4, least=4, inside=70, top=7) == plain(rows, 4, 4, 70, 7)


@pytest.mark.parametrize("bits", [3, 9])
def test_shared_fingerprints_are_told_apart_by_the_words(spark, rows, bits):
    assert mined(spark, rows, bits=bits) == plain(rows)


def test_filters_that_let_everything_pass_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", (6, 6))
    assert mined(spark, rows) == plain(rows)


def test_texts_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(grams, "CHUNK", 50)
    texts = ["abc def " * 40, "x" * 400 + " abc def abc", "abc def ghi. " * 30]
    words = grams.Words(texts)
    small = grams.Polynomial(11).hashes(words, [1, 2, 3])
    monkeypatch.setattr(grams, "CHUNK", 1 << 16)
    for k, h in grams.Polynomial(11).hashes(words, [1, 2, 3]).items():
        assert np.array_equal(h, small[k])
    assert grams.chunks([10, 1 << 20, 5, 5]) == [(0, 1), (1, 2), (2, 4)]


def test_repeats_overlap_and_hot_phrases(spark):
    rows = [("en", "la la la la " * 50)] * 40 + [("en", "rare thing here")] * 3 + [("fr", "la la")] * 10
    assert mined(spark, rows) == plain(rows)


def test_phrases_of_odd_rows(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd_docs).collect()) == plain(rows)
    assert phrases.collocations(no_docs).collect() == []
