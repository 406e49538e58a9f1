"""The packing encoder against the tokenizer library itself, and the blanks that its splitting relies on."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from turnaround.llm import packing

LETTERS = list("abcXYZéÉßσΣİıñ,.!*#$%&'`~_-019 \t\n\x0b　日本語еﬁǅ") + ["é", "\x1d", "  ", "\xa0", "​", "́"]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def library(encoder, texts):
    return [packing.array("I", encoder.model.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def some_texts(n, seed=11):
    pick = random.Random(seed)
    return ["".join(pick.choices(LETTERS, k=pick.randint(0, 80))) for _ in range(n)]


def test_ids_are_the_librarys(encoder):
    texts = some_texts(2000)
    assert encoder.encode(texts) == library(encoder, texts)
    assert encoder.encode(pa.array(texts[5:9] * 2)) == library(encoder, texts[5:9] * 2)


def test_empty_odd_and_long_texts(encoder):
    texts = ["", " ", "\x1c", "a\x1cb", "x" * 30000, "word, " * 20000, " ", "a"]
    assert encoder.encode(texts) == library(encoder, texts)
    assert encoder.encode([]) == []


def test_small_slices_and_caches_change_no_id(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 200)
    monkeypatch.setattr(packing, "CACHE_PARTS", 50)
    small, texts = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), some_texts(500, 12)
    assert small.encode(texts + texts[::-1]) == library(small, texts + texts[::-1])
    assert len(small.old) > 0


def test_all_code_points_split_alike():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in packing._SEPARATORS]
    texts = pa.array([f"a{c}b" for c in points])
    expected = [f"a{c}b".split() for c in points]
    assert [[w for w in words if w] for words in pc.utf8_split_whitespace(texts).to_pylist()] == expected
    wide = [c for c, words in zip(points, expected) if len(words) == 2 and ord(c) > 127]
    assert [c for c in points if re.match(f"[{packing._WIDE_BLANKS}]", c)] == wide
    ascii_texts = pa.array([f"a{c}b" for c in points if ord(c) < 128])
    assert pc.ascii_split_whitespace(ascii_texts).to_pylist() == [f"a{c}b".split() if c.isspace() else [f"a{c}b"] for c in points if ord(c) < 128]
