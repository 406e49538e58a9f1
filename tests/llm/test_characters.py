"""The language model over whole alphabets against brute force, and what it tells that classes do not."""

import random
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest

from turnaround.llm import characters, quality


def brute(texts, order):
    """By dictionaries: counts, continuation counts, discounts; a count of one goes to the lower order."""
    pad = "\0" * (order - 1)
    levels = {order: Counter()}
    for t in texts:
        s = pad + t + "\0"
        levels[order].update(s[i : i + order] for i in range(len(t) + 1))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    size = len(set("".join(texts))) + 1
    lower = {"": 1 / size}
    for k in range(1, order + 1):
        n = Counter(levels[k].values())
        two, many = characters._discounts(n[1], n[2], n[3], n[4])
        held = {g: c - many if c > 2 else 2 - two if c == 2 else 0.0 for g, c in levels[k].items()}
        total, kept = defaultdict(int), defaultdict(float)
        for g, c in levels[k].items():
            total[g[:-1]] += c
            kept[g[:-1]] += held[g]
        lower = {g: held[g] / total[g[:-1]] + (1 - kept[g[:-1]] / total[g[:-1]]) * lower[g[1:]] for g in held}
    return [-sum(log(lower[(pad + t + "\0")[i : i + order]]) for i in range(len(t) + 1)) / (len(t) + 1) for t in texts]


def test_perplexities_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["straße", "été", "haus", "größe", "ein", "zwei", "\U0001f600", "naïf"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))), "de") for i in range(40)]
    rows += [(100 + i, "".join(chr(0x4E00 + rng.randrange(1500)) for _ in range(200)), "zh") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = characters.models(docs)
    assert found["de"].alphabet.order == 6 and found["zh"].alphabet.order == 5
    for lang, model in found.items():
        texts = [t for _, t, g in rows if g == lang]
        assert model.log_perplexities(texts) == pytest.approx(brute(texts, model.alphabet.order), abs=1e-4)


def test_no_characters_are_folded():
    points = sorted({*map(ord, "aàáäb12"), 0x4E00, 0x4E00 + 26, 0x1F600, 0x1F601})
    alphabet = characters.Alphabet(points)
    assert len({int(alphabet.grams(chr(p))[0]) for p in points}) == len(points)
    assert np.array_equal(quality.grams("aà"), quality.grams("aa"))  # the classes fold these


def test_other_characters_of_the_same_classes_are_rejected(spark):
    rng = random.Random(9)
    words = ["".join(chr(0x4E00 + rng.randrange(200)) for _ in range(4)) for _ in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(60)]
    # Each character gives way to one 260 to 260 * 20 further on, of the same class, as often another.
    other = "".join(chr(ord(c) + 260 * rng.randrange(1, 20)) if c != " " else c for c in texts[0])
    assert np.array_equal(quality.grams(other), quality.grams(texts[0]))
    rows = [(i, t, "zh") for i, t in enumerate([*texts, other])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert kept[0] and not kept[60] and sum(kept.values()) >= 55
