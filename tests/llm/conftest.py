import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, rank int, word string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    long = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam. " * 3000
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 3, "x", "y", 1, "z"),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 3, "x", "y", 1, "z"),
        (2, None, "en", None, None, None, None, None, None),
        (3, "", None, "a", 0, None, None, None, None),
        (None, "One two three four five six seven eight nine ten eleven", None, "b", 3, None, None, None, None),
        (4, long, "de", "b", len(long), None, None, None, None),
        (5, " \t\n ", "de", "b", 4, None, None, None, None),
        (6, "mail ann@example.com or call +1 (212) 555-0100 at 10.0.0.7, card 4111 1111 1111 1111.", "en", "c", 5, "x", "y", 2, "w"),
        (7, "\U0001f600 <|endoftext|> \x00\x1c ▁ <s>", "en", "c", 5, "x", "y", 2, "w"),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
