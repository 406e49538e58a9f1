"""Work and broadcasts that the driver is spared."""

import random

from turnaround.llm import common, quality


def stored_rounds(spark, monkeypatch, rows):
    real, rounds = common.materialize, []
    monkeypatch.setattr(common, "materialize", lambda *a: rounds.append(a) or real(*a))
    found = common.components(spark.createDataFrame(rows, "u long, v long"))
    return {r.node: r.component for r in found.collect()}, len(rounds)


def test_stars_need_no_round(spark, monkeypatch):
    rows = [(1, 5), (6, 1), (1, 6), (7, 1), (2, 3), (4, 4)]
    assert stored_rounds(spark, monkeypatch, rows) == ({1: 1, 5: 1, 6: 1, 7: 1, 2: 2, 3: 2}, 1)
    assert stored_rounds(spark, monkeypatch, [(4, 4)]) == ({}, 1)


def test_what_is_no_star_goes_on(spark, monkeypatch):
    for rows in ([(1, 3), (2, 3)], [(1, 2), (2, 3)]):  # two nodes below one, and one below and one above
        found, rounds = stored_rounds(spark, monkeypatch, rows)
        assert found == {1: 1, 2: 1, 3: 1} and rounds > 1
    path = list(range(60))
    random.Random(3).shuffle(path)
    found, _ = stored_rounds(spark, monkeypatch, list(zip(path, path[1:])))
    assert found == dict.fromkeys(range(60), 0)


def test_models_are_broadcast_once(spark, sf_dir, monkeypatch):
    docs, real, calls = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60), quality._passes, []
    monkeypatch.setattr(quality, "_passes", lambda *a: calls.append(a) or real(*a))
    assert quality.judge(docs).count() == 60
    assert len(calls) == 1
