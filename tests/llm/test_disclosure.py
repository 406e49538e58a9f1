"""Terms that give an entity away although they also stand elsewhere, are rare, short, long or numbers."""

import pytest

from turnaround.llm import pii

PLAIN = [(1000 + i, f"plain text wrote from number{i} goes on about the day and says nothing of anyone") for i in range(300)]


def found(spark, rows):
    frame = spark.createDataFrame(rows + PLAIN, "doc_id long, text string")
    return {r.term for r in pii.disclosing_terms(frame).collect()}


@pytest.mark.parametrize("name", ["Zebulon", "Li", "48213377", "x" * 60])
def test_one_use_elsewhere_clears_no_term(spark, name):
    near = [(i, f"plain a{i} day {name} wrote from zeb@example.com text b{i}") for i in range(6)]
    away = [(90, f"far from any address {name} says nothing")]
    assert pii.term(name) in found(spark, near) and pii.term(name) in found(spark, near + away)
    rows = pii.scan(spark.createDataFrame(near + away + PLAIN, "doc_id long, text string"), ["doc_id", "text"], True).collect()
    texts = {r.doc_id: r.text for r in rows}
    assert texts[90] == "far from any address <TERM> says nothing" and name not in "".join(texts[i] for i in range(6))
    assert all(texts[i] == text for i, text in PLAIN)  # clean documents stay as they are


def test_entities_of_two_documents_or_one_with_two_mentions_count(spark):
    two = [(1, "plain Zebulon day zeb@example.com text a1"), (2, "text a2 Zebulon says zeb@example.com goes")]
    filler = "plain text goes on about the day and says nothing of anyone " * 5
    one = [(1, f"Zebulon day zeb@example.com a1 {filler} a2 Zebulon says zeb@example.com")]
    assert found(spark, two) == found(spark, one) == {"zebulon"}
    assert found(spark, [two[0]] * 2) == set() and found(spark, two[:1]) == set()
