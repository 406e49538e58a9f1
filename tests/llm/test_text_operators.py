"""Operators on texts against brute force, whole tables and odd rows."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as contract
from turnaround.llm import packing, pii, quality, simhash, substring, tokens

QUERIES = contract.queries()
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def as_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# --- Fingerprints ---------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = as_words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{row: smallest id reachable} for [(id, fingerprint)]."""
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if bin(a ^ b).count("1") <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (d, _) in zip(group, prints):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [least.get(g) for g in group]


def test_fingerprints_and_components_equal_brute_force(spark, sf_dir, texts):
    rows = QUERIES["op3_simhash_trie"](spark, sf_dir).collect()
    ids = sorted(texts)
    prints = [(i, plain_fingerprint(texts[i])) for i in ids]
    expected = {i: (f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints))}
    assert len(rows) == len(ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == expected


@pytest.mark.parametrize("seed", range(4))
def test_trie_links_equal_all_pairs(spark, seed):
    rng = np.random.RandomState(seed)
    base = rng.randint(0, 1 << 62, 40, np.int64).astype(np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.randint(0, 7), False))) for b in base for _ in range(12)]
    fps = np.unique(np.array(near, np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    from turnaround.llm import common

    edges = simhash.links(frame)
    assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= 64 for r in edges.collect())
    found = {r.node: r.component for r in common.components(edges).collect()}
    signed = fps.view(np.int64).tolist()
    expected = plain_components([(s, int(f)) for s, f in zip(signed, fps)])
    assert [found.get(s, s) for s in signed] == expected


def test_a_long_chain_is_one_component(spark):
    from turnaround.llm import common

    rows = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in range(500, 540)} == {500}


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and by_id[2].fp == by_id[3].fp == by_id[5].fp == 0
    assert {by_id[i].component_id for i in (2, 3, 5)} == {2}
    assert by_id[None].component_id == 1
    assert simhash.near_duplicates(no_docs).count() == 0


# --- Quality --------------------------------------------------------------------------------------


def plain_counts(text):
    words = as_words(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, duplicates = text.split("\n"), set(), 0
    for line in lines:
        if as_words(line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(repeated)


def plain_log_perplexity(counted, text):
    """Modified Kneser-Ney by the book, with dictionaries; counted: {n-gram of classes: count}."""
    order, k = quality.ORDER, 1 << quality.BITS
    levels = {order: counted}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount, context = {}, {}
    for n, level in levels.items():
        c = Counter(min(v, 5) for v in level.values())
        if c[1] and c[2] and c[3]:
            y = c[1] / (c[1] + 2 * c[2])
            d = [1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3]]
            discount[n] = [min(max(x, 0), i + 1) for i, x in enumerate(d)]
        else:
            discount[n] = [0.5, 1.0, 1.5]
        context[n] = {}
        for g, v in level.items():
            total, left = context[n].get(g[:-1], (0, 0))
            context[n][g[:-1]] = total + v, left + discount[n][min(v, 3) - 1]

    def probability(gram):
        n = len(gram)
        if n == 0:
            return 1 / k
        if gram[:-1] not in context[n]:
            return probability(gram[1:])
        total, left = context[n][gram[:-1]]
        v = levels[n].get(gram, 0)
        return max(v - (discount[n][min(v, 3) - 1] if v else 0), 0) / total + left / total * probability(gram[1:])

    codes = [unpack(g) for g in quality.grams(text).tolist()]
    return -sum(np.log(probability(g)) for g in codes) / len(codes)


def unpack(gram):
    k = 1 << quality.BITS
    return tuple(gram >> (quality.BITS * i) & (k - 1) for i in range(quality.ORDER - 1, -1, -1))


def test_counts_and_perplexity_equal_brute_force(spark, sf_dir, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_perplexity_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    counted = Counter(g for i, t in texts.items() if langs[i] == "es" for g in map(unpack, quality.grams(t).tolist()))
    for r in rows:
        counts = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.base_failed and r.kept)
        if langs[r.doc_id] == "es" and counts[0]:
            assert r.log_perplexity == pytest.approx(plain_log_perplexity(counted, texts[r.doc_id]), abs=2e-3)


def test_probabilities_add_up(spark):
    rng = np.random.RandomState(1)
    gram = np.unique(rng.randint(0, quality.GRAMS, 5000))
    parts = quality.kneser_ney(gram, rng.randint(1, 9, len(gram)))
    scorer = quality.Scorer({o: (k.astype("<u8").tobytes(), p.tobytes(), w.tobytes()) for o, k, p, w in parts})
    sums = np.exp(scorer.table.reshape(-1, 1 << quality.BITS).astype(float)).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-3)


def test_foreign_and_scrambled_texts_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    planted = spark.createDataFrame(
        [(-1, "xqzv wkjq zzxk qqwv jxkz vwqx kqzj xxvw zqkj wvxq " * 2 + "kzqx jvwk", "en"), (-2, "a b", "en")], docs.schema
    )
    rows = {r.doc_id: r for r in quality.judge(docs.unionByName(planted)).collect()}
    assert not rows[-1].kept and rows[-1].n_words > 10 and rows[-2].base_failed
    assert sum(r.kept for r in rows.values()) > 0.8 * len(rows)


def test_verdicts_on_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in quality.judge(odd_docs, odd_docs.columns, "__").collect()}
    assert rows[2]["__base_failed"] and rows[2]["__log_perplexity"] is None and rows[5]["__n_words"] == 0
    assert rows[4]["__n_repeat_words"] == rows[4]["__n_words"] and rows[6]["kept"] == "x"
    assert quality.judge(no_docs).count() == 0


# --- Personal data --------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], list(PATTERNS).index(x[0])))


def test_spans_equal_plain_patterns(spark, sf_dir, texts):
    for r in QUERIES["op6_disclosure"](spark, sf_dir).collect():
        spans = plain_spans(texts[r.doc_id])
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == sha256(written.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in spans) for k in PATTERNS]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term:")) == written


@pytest.mark.parametrize("alphabet", ["ab@.-1", "0123456789 -.+()", "0102.5.9 ", "4 -1230@a.+", "é@a.b 1\n"])
def test_spans_of_random_texts(alphabet):
    rng = np.random.RandomState(7)
    for _ in range(2000):
        text = "".join(rng.choice(list(alphabet), rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "a@" * 100_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


def test_terms_that_only_stand_beside_an_entity_are_disclosing(spark):
    near = ["{} Zebulon wrote from zeb@example.com about {} today", "when {} asked Zebulon ( zeb@example.com ) the {} said"]
    docs = [(i, near[i % 2].format(f"wub{i}", f"vub{i}")) for i in range(8)]
    docs += [(100 + i, f"the plain {i} text about today said asked wrote from when word{i}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r.term for r in pii.disclosing_terms(frame).collect()] == ["zebulon"]
    rows = {r.doc_id: r for r in pii.scan(frame, ["doc_id", "text"], replace=True).collect()}
    assert rows[0].text == "wub0 <TERM> wrote from <EMAIL> about vub0 today" and rows[0].spans == "term:5:12,email:24:39"
    assert rows[100].text == docs[8][1] and rows[100].spans == ""
    copied = spark.createDataFrame([(i, docs[0][1]) for i in range(50)] + docs[8:], "doc_id long, text string")
    assert pii.disclosing_terms(copied).count() == 0


def test_spans_of_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in pii.scan(odd_docs, odd_docs.columns, True, "__").collect()}
    assert rows[2].text is None and rows[2]["__spans"] == "" and rows[3].text == ""
    assert rows[6].text == "mail <EMAIL> or call <PHONE> at <IP>, card <CARD>." and rows[6].word == "w"
    assert pii.scan(no_docs).count() == 0


# --- Repeated units -------------------------------------------------------------------------------


def test_repeated_units_equal_brute_force(spark, sf_dir, texts):
    seen, expected = set(), {}
    for i in sorted(texts):
        spans = []
        for start, end, digest in substring.units(texts[i]):
            if digest in seen:
                spans.append(f"{start}:{end}")
            seen.add(digest)
        expected[i] = ",".join(spans)
    assert {r.doc_id: r.removed for r in QUERIES["op8_unit_dedup"](spark, sf_dir).collect()} == expected
    assert any(expected.values())


def test_quoted_passages_go_and_the_rest_keeps_its_offsets(spark):
    passage = " ".join(f"{w} runs far beyond the old stone bridge tonight." for w in "abcdefgh")
    docs = [(2, f"Fresh words open this one and {passage} More follows here."), (1, f"{passage}\nOwn line of six or more words."),
            (3, "Short one.\nShort one.\nQuite another text that nothing else repeats anywhere.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in substring.duplicates(frame).collect()}
    assert found[1].n_removed == 0 and found[3].n_removed == 0 and found[2].n_removed >= 7
    for r in substring.dedup(frame).collect():
        text = dict(docs)[r.doc_id]
        spans = [tuple(map(int, s.split(":"))) for s in r.kept.split(",")]
        assert r.text == "".join(text[s:e] for s, e in spans)
    # The passage opens within a sentence of its own document, which stays.
    assert {r.doc_id: r.text for r in substring.dedup(frame).collect()}[2].count("bridge") == 1


def test_repeated_units_of_odd_rows(odd_docs, no_docs):
    rows = substring.duplicates(odd_docs).collect()
    ones = sorted(r.n_removed for r in rows if r.doc_id == 1)
    assert len(rows) == 9 and ones == [0, 1] and next(r for r in rows if r.doc_id is None).n_removed == 1
    assert next(r for r in rows if r.doc_id == 4).n_removed == 2999
    assert substring.duplicates(no_docs).count() == 0 and substring.dedup(no_docs).count() == 0


# --- Tokens ---------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, sf_dir, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = QUERIES["op9_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def random_texts(alphabet, n=3000):
    rng = np.random.RandomState(11)
    return ["".join(rng.choice(list(alphabet), rng.randint(0, 40))) for _ in range(n)]


def test_token_counts_of_random_texts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = tokens.TokenCounter(PIECES, {"": 1})
    found = random_texts(" ▁ab the\n\t\xa0　éß<s></s>0.,\x01\x85\U0001f600ﬁ")
    assert counter.counts(found) == [len(model.encode(t)) for t in found]


def test_ids_of_random_texts():
    model, encoder = Tokenizer.from_file(WORDS), packing.Encoder(WORDS)
    found = random_texts(" ab'sTHE İΣσßé́ͅ\n\t\x1c\x1f\x85\xa0　 ᠎12") + ["a<|endoftext|>b <|startoftext|>", ""]
    for text, ids in zip(found, encoder.encode(found)):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_tokens_of_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in tokens.count_tokens(odd_docs, PIECES).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert rows[2].n_tokens == rows[3].n_tokens == 0 and rows[4].over_limit
    assert rows[7].n_tokens == len(model.encode("\U0001f600 <|endoftext|> \x00\x1c ▁ <s>"))
    assert tokens.count_tokens(no_docs, PIECES).count() == 0


# --- Packing --------------------------------------------------------------------------------------


def check_packed(rows, texts, window=2048):
    """texts: list of (id, text), ids repeated or not."""
    model = Tokenizer.from_file(WORDS)
    expected = Counter()
    for i, t in texts:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), window):
            piece = ids[s : s + window]
            expected[i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return 1 - sum(r.length for r in rows) / (window * max(1, len(by_sequence)))


def test_packing_places_every_id_once_with_little_padding(spark, sf_dir, texts):
    rows = QUERIES["op2_length_packing"](spark, sf_dir).collect()
    assert check_packed(rows, list(texts.items())) < 0.03


def test_packed_sequences_hold_the_ids(spark, odd_docs, no_docs):
    packed = packing.pack_documents(odd_docs, WORDS, 64, with_ids=True)
    check_packed(packed.collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 64)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.n_ids and r.n_ids == sum(p.length for p in r.pieces)
    assert packing.pack_documents(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("counts", [{1: 5}, {256: 3}, {255: 4, 1: 2}, {100: 1000}, {128: 7, 64: 9, 3: 1}, {}])
def test_plans_place_every_length(counts):
    histogram = np.zeros(257, np.int64)
    for u, n in counts.items():
        histogram[u] = n
    placed = np.zeros(257, np.int64)
    for parts, repeats in packing.plan(histogram, 256):
        assert sum(parts) <= 256
        for u in parts:
            placed[u] += repeats
    assert (placed == histogram).all()


@pytest.mark.parametrize("counts", [{1: 3000}, {9: 500, 2040: 3}, {2048: 5, 1: 1}, None, {}])
def test_exact_lengths_leave_little_padding(counts):
    rng = np.random.RandomState(3)
    histogram = np.zeros(2049, np.int64)
    for u, n in counts.items() if counts is not None else [(u, rng.randint(5)) for u in range(1, 2049)]:
        histogram[u] = n
    planned = packing.places(histogram, 2048, 8)
    length = np.repeat(np.arange(2049), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram]) if len(length) else length
    sequence, slot = packing.locate(length, rank, planned)
    held = {}
    for q, s, n in zip(sequence.tolist(), slot.tolist(), length.tolist()):
        held.setdefault(q, {})[s] = n
    assert sum(map(len, held.values())) == len(length)
    assert all(sum(v.values()) <= 2048 and sorted(v) == list(range(len(v))) for v in held.values())
    assert len(held) <= 1 + 1.02 * length.sum() / 2048


def test_empty_documents_fill_sequences(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "cast(null as string) text")
    assert packing.pack_documents(docs, WORDS).select("sequence_id").distinct().count() == 2


def test_least_squares_equals_exhaustive_search():
    columns = packing.combinations_filling(6)
    assert (3, 2, 1) in columns and all(sum(c) == 6 and len(c) <= 3 for c in columns)
    target = np.array([0, 5, 4, 3, 2, 1, 0], float)
    a = np.array([[c.count(u) for c in columns] for u in range(7)], float)
    x = packing.nnls(columns, target)
    best = a @ x - target
    gradient = a.T @ best
    assert (x >= 0).all() and (gradient > -1e-5).all() and abs(gradient @ x) < 1e-4
