"""What a Python worker keeps from task to task."""

import public_tokenizers

from turnaround.llm import common, packing, quality


def test_a_worker_keeps_the_caches_of_one_module():
    path = public_tokenizers.path("word_bpe_49k.json")
    common.make_room(packing.__name__)
    packing._encoder(path).encode(["one two three"])
    common.make_room(packing.__name__)
    assert packing._encoder.cache_info().currsize == 1
    common.make_room(quality.__name__)
    assert packing._encoder.cache_info().currsize == 0
    quality._class_table()
    common.make_room(packing.__name__)
    assert not quality._loaded


def test_a_module_left_and_met_again_works_as_before(spark):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "four five", "en")], "doc_id long, text string, lang string")
    path = public_tokenizers.path("word_bpe_49k.json")
    first = sorted(packing.cut(docs, path, with_ids=True).select("doc_id", "ids").collect())
    assert quality.judge(docs).count() == 2
    assert sorted(packing.cut(docs, path, with_ids=True).select("doc_id", "ids").collect()) == first
