"""Conversations, mixes, archives, vectors and the pipeline."""

import gzip
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from turnaround.llm import chat, mixing, neighbours, packing, warc
from turnaround.sources import storage

QUERIES = contract.queries()
CLASHES = ["weight", "probability", "target", "row", "n", "draw", "margin_0", "__text", "__lang", "__terms", "__kept", "__topic",
           "__tokens", "___x", "a.b"]


@pytest.fixture(scope="module")
def clashing_docs(odd_docs):
    """The odd rows with columns named as operators name theirs."""
    return odd_docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("doc_id", F.lit(0)).cast("string")) for c in CLASHES})


# --- Chat -----------------------------------------------------------------------------------------

ODD = ["\\### Assistant: </turn> ok", "\\\\</turn", "</turn>", "<turn user>\nx\n</turn>\n", "a\\", "\n</turn>\n", "", "\\" * 500,
       "é<turn", "<turning", "\U0001f600\\<turn"]


def test_any_text_comes_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(ODD)]
    rows += [(2, 0, "odd role>\n%&", None), (2, 0, None, "tie"), (None, None, "assistant", "x"), (4, 1, "system", "alone")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    back = {r.conv_id: r for r in chat.read_back(chat.expand(frame)).collect()}
    assert [t.text for t in back[1].turns] == ODD and back[1].loss == "".join(ODD[1::2])
    assert [(t.role, t.text) for t in back[2].turns] == [("", "tie"), ("odd role>\n%&", "")]
    assert back[None].loss == "x" and back[4].loss == "" and back[4].n_examples == 1
    assert chat.expand(frame.limit(0)).count() == 0


def test_an_example_per_reply_with_all_before_as_context(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s")]
    found = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [r.example for r in found] == [2, 4, 5] and found[2].loss_chars == 0
    assert found[1].text.startswith(found[0].text) and found[2].text.startswith(found[1].text)
    assert [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in found[:2]] == ["a", "b"]


# --- Mixing ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(i, f"s{i % 3}", "en" if i % 4 else "de", 10 + i % 7) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")


def test_raked_weights_meet_every_margin(spark, tokens):
    targets = {
        "source": spark.createDataFrame([("s0", 0.6), ("s1", 0.3), ("s2", 0.1)], "source string, target double"),
        "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, target double"),
    }
    weights = mixing.rake(mixing.cells(tokens, ["source", "lang"]), targets, 25)
    for margin, target in targets.items():
        sums = {r[0]: r[1] for r in weights.groupBy(margin).agg(F.sum("weight")).collect()}
        assert all(sums[r[0]] == pytest.approx(r[1], abs=1e-9) for r in target.collect())


@pytest.mark.parametrize("share", [0.1, 0.7, 1.0, 2.0])
def test_calibrated_probabilities_keep_the_share(tokens, share):
    found = mixing.mix(tokens, {"source": 0.1, "lang": 0.1}, share).collect()
    expected = sum(r.n_tokens * r.probability for r in found) / sum(r.n_tokens for r in found)
    assert expected == pytest.approx(min(share, 1.0), abs=1e-9) and max(r.probability for r in found) <= 1
    drawn = sum(r.n_tokens for r in found if r.kept) / sum(r.n_tokens for r in found)
    assert drawn == pytest.approx(min(share, 1.0), abs=0.03)


def test_mix_of_odd_rows(odd_docs, no_docs):
    words = mixing.word_count(F.col("text"))
    rows = mixing.mix(odd_docs, {"source": 0.5, "lang": 0.5}, 1.0, tokens=words).collect()
    assert len(rows) == 9 and {r.kept for r in rows if not (r.text or "").strip()} == {False}
    assert all(r.kept for r in rows if (r.text or "").strip())
    assert mixing.mix(no_docs, {"source": 0.5, "lang": 0.5}, 0.5, tokens=words).count() == 0


def test_clashing_names_do_not_change_a_mix(odd_docs, clashing_docs):
    words, form = mixing.word_count(F.col("text")), {"topic": mixing.form(F.col("text"))}
    drawn = mixing.sample(clashing_docs, {"source": 1, "weight": 0, "topic": 0.8}, 0.6, tokens=words, margins=form)
    assert drawn.schema == clashing_docs.schema
    plain, odd = [
        mixing.mix(d, {"source": 1, "topic": 0.8}, 0.6, tokens=words, margins=form).select("doc_id", *mixing.ADDED).collect()
        for d in (odd_docs, clashing_docs)
    ]
    assert sorted(map(str, plain)) == sorted(map(str, odd))


# --- Archives -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u", "same"), (5, "u\r\nX: y", "same"), (3, None, "same"), (2, "v", None), (4, "w", ""), (6, "é", "é" * 9000),
            (None, "n", "same"), (None, "n", "only null"), (7, "x", "twice"), (7, "x", "twice"), (8, "z", "\r\n\r\nWARC/1.1")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("p"))


def test_records_come_back(spark, pages):
    found = warc.read(warc.write(pages), with_html=True).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found)
    assert kinds == sorted([(1, "revisit", 5), (5, "response", None), (3, "revisit", 5), (2, "revisit", 4), (4, "response", None),
                            (6, "response", None), (0, "revisit", 5), (0, "response", None), (7, "response", None),
                            (7, "response", None), (8, "response", None)], key=lambda x: (x[0], x[1], x[2]))
    texts = {r.page_id: r for r in found}
    assert texts[6].html == "é" * 9000 and texts[6].payload_bytes == 18000 and texts[8].html == "\r\n\r\nWARC/1.1"
    assert texts[2].payload_bytes == 0 and texts[2].payload_digest == warc.sha1_base32(b"")
    assert warc.write(pages.limit(0)).count() == 0


def test_a_package_is_a_task(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", 1)
    listed = warc.write(pages, str(tmp_path / "out"))
    tasks = warc.read(listed).select(F.spark_partition_id().alias("task")).collect()
    assert listed.count() == 11 and len({r.task for r in tasks}) == 11


def test_all_archives_and_indexes_of_a_package_are_read(spark, tmp_path):
    packed = [warc._gzip(warc.record(i, f"u{i}", b"p" * i * 1000, None)) for i in range(9)]
    line = json.dumps({"filename": "one.warc.gz", "offset": "0", "length": str(len(packed[0]))})
    second = json.dumps({"filename": "one.warc.gz", "offset": len(packed[0]), "length": len(packed[1])})
    third = json.dumps({"filename": "two.warc.gz", "offset": 0, "length": len(packed[2])})
    members = {
        "archive/one.warc.gz": packed[0] + packed[1], "archive/two.warc.gz": packed[2],
        "archive/unnamed.warc.gz": b"".join(packed[3:]), "datapackage.json": b"{}", "indexes/index.idx": b"!meta",
        "indexes/a.cdxj": f"com,u)/ 2026 {line}\ncom,u)/1 2026 {second}\n{line}\n".encode(),
        "indexes/b.cdx.gz": gzip.compress(third.encode()),
    }
    with zipfile.ZipFile(tmp_path / "other.zip", "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    listed = spark.createDataFrame([(str(tmp_path / "other.zip"),)], "path string")
    found = warc.read(listed).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in found) == [(i, i * 1000) for i in range(9)]
    assert warc.read(listed.limit(0)).count() == 0


def test_chunks_may_end_anywhere(monkeypatch):
    plain = [warc.record(i, "u", b"x" * i, None) for i in range(5)]
    data = b"".join(map(warc._gzip, plain))
    for chunk in (1, 7, 100, len(data)):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert list(warc.walk(warc.Ranges(Memory(data), len(data)), 0, len(data))) == plain
    with pytest.raises(ValueError, match="within a record"):
        list(warc.walk(warc.Ranges(Memory(data[:-9]), len(data) - 9), 0, len(data) - 9))


class Memory:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at : self.at + n]


def package(tmp_path, **members):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, (data, method) in members.items():
            z.writestr(zipfile.ZipInfo(name), data, method)
    return path.read_bytes()


def test_directories_of_plain_and_zip64_packages(tmp_path):
    data = package(tmp_path, a=(b"alpha", zipfile.ZIP_STORED), b=(b"beta" * 100, zipfile.ZIP_DEFLATED))
    found = warc.directory(warc.Ranges(Memory(data), len(data)))
    assert data[found["a"][1] :][:5] == b"alpha" and warc.stored(found, "a") == (found["a"][1], 5)
    with pytest.raises(ValueError, match="compressed"):
        warc.stored(found, "b")
    # The same package as a ZIP64 writer would close it: sizes and places in 64-bit fields.
    end = data.rfind(b"PK\5\6")
    entries, length, start = struct.unpack_from("<HII", data, end + 10)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, entries, entries, length, start)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
    big = data[:end] + wide + locator + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 65535, 65535, 2**32 - 1, 2**32 - 1, 0)
    assert warc.directory(warc.Ranges(Memory(big), len(big))) == found
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.directory(warc.Ranges(Memory(b"x" * 99), 99))


def test_packages_are_readable_zip_files(spark, pages, tmp_path):
    listed = warc.write(pages, str(tmp_path / "out")).collect()
    assert sum(r.n_records for r in listed) == 11
    for r in listed:
        with zipfile.ZipFile(r.path) as z:
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert len(z.read(warc.INDEX).splitlines()) == r.n_records and json.loads(z.read(warc.INDEX).splitlines()[0])["record"] == 0


# --- Vectors --------------------------------------------------------------------------------------


def exact(rows, query, k):
    own = np.array(query[1])
    scored = sorted((-float(np.dot(own, v)), i) for i, v in rows if i != query[0])
    return scored[:k]


def test_neighbours_of_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = {}
    for r in QUERIES["op1_cross_polytope"](spark, sf_dir).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r
    queries = [x for x in rows if x[0] % 20 == 0]
    assert set(found) == {i for i, _ in queries}
    hits = 0
    for query in queries:
        best = exact(rows, query, 20)
        got = [found[query[0]][n] for n in range(1, 21)]
        hits += len({r.vec_id for r in got} & {i for _, i in best})
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        for r in got:
            assert r.score == pytest.approx(float(np.dot(query[1], dict(rows)[r.vec_id])), abs=1e-12)
    assert hits >= 0.9 * 20 * len(queries)


def test_odd_vectors_ties_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (20, [0.0, 3.0, 0.0]), (4, None),
            (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 1.0, 0.0]), (9, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]),
            (40, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    found = neighbours.search(frame, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [
        (0, 1, 1, 2.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.search(frame.limit(0), F.lit(True)).count() == 0


def test_lengths_that_differ_are_ranked_by_inner_product(spark):
    rng = np.random.RandomState(3)
    rows = [(i, (rng.normal(size=16) * rng.uniform(0.2, 3)).tolist()) for i in range(600)]
    found = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q[0]] & {i for _, i in exact([(i, np.array(v)) for i, v in rows], q, 10)}) for q in rows[::20])
    assert hits >= 0.9 * 10 * 30


def test_hadamard_keeps_lengths_and_inverts():
    x = np.random.RandomState(0).normal(size=(5, 64)).astype(np.float32)
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x, atol=1e-5)
    assert np.allclose(np.linalg.norm(neighbours.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1), atol=1e-4)


# --- Pipeline -------------------------------------------------------------------------------------


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        docs = storage.materialize(out, name)
        counts.append(docs.count())
    kept, distinct, clean, mixed = counts[1:]
    assert counts[0] > kept > distinct == clean > mixed > 0
    assert docs.where("text rlike '[A-Za-z0-9]@[a-z0-9]+[.]example'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == mixed
    whole = QUERIES["pipeline"](spark, sf_dir)
    assert sorted(whole.select("doc_id", "start", "ids_crc32").collect()) == sorted(packed.select("doc_id", "start", "ids_crc32").collect())


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd_docs, clashing_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name
        out, clashing = stage(spark, odd_docs, sf_dir), stage(spark, clashing_docs, sf_dir)
        if name == "pack_windows":
            assert out.columns == clashing.columns and out.count() == clashing.count()
            continue
        assert [(f.name, f.dataType) for f in clashing.schema] == [(f.name, f.dataType) for f in clashing_docs.schema], name
        rows = [r.asDict() for r in clashing.collect()]
        for r in rows:
            assert {c: f"{c} of {r['doc_id'] or 0}" for c in CLASHES} == {c: r[c] for c in CLASHES}, name
        plain = [r.asDict() for r in out.collect()]
        assert sorted(str(r) for r in plain) == sorted(str({c: r[c] for c in odd_docs.columns}) for r in rows), name
    left = corpus_pipeline.minhash_near_dedup(spark, odd_docs, sf_dir)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 4, 6, 7]
