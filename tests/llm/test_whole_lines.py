"""Repeated lines and paragraphs go whole, whatever their sentences and script."""

from turnaround.llm import substring


def left(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: r for r in substring.duplicates(frame).collect()}
    texts = {r.doc_id: r.text for r in substring.dedup(frame).collect()}
    for i, text in docs:
        assert spans[i].removed_chars == len(text) - len(texts[i])
    return texts


def test_repeated_lines_of_short_sentences_go_whole(spark):
    line = "Stay calm. Go on. Look here. No more. All done now."
    mixed = "Here runs one sentence of more than six words. Oh no. And there follows another one of such a length."
    texts = left(spark, [(1, f"{line}\nSome words."), (2, f"Other words.\n{line}"), (3, mixed), (4, mixed + " "), (5, f"Well. {mixed} Then.")])
    assert texts[1] == f"{line}\nSome words." and texts[2] == "Other words.\n" and texts[3] == mixed
    assert texts[4].strip() == "" and texts[5].split() == ["Well.", "Then."]


def test_repeated_paragraphs_of_short_lines_go_whole(spark):
    block = "Roses are red\nViolets are blue\nSugar is sweet"
    texts = left(spark, [(1, f"{block}\n\nOne."), (2, f"Two.\n\n{block}\n\nThree.")])
    assert texts == {1: f"{block}\n\nOne.", 2: "Two.\n\n\n\nThree."}


def test_scripts_without_blanks_have_units(spark):
    for line in ("今天的天气非常好我们一起去公园散步吧", "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนกันเถอะ", "きょうはとてもよいてんきなのでさんぽにいきます"):
        assert left(spark, [(1, line), (2, f"短い。\n{line}")])[2] == "短い。\n"
