import pytest

WHITE = " \t\n\x0b\f\r"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text[, source]) rows, with extra columns whose names clash with internal ones."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x", 1.5) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, __id double"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty texts, a very long text, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    return [(1, None), (2, ""), (3, "  \n\t"), (4, "one two three four"), (4, "one two three four"), (5, "one two three four"), (None, "one two three four"), (None, None), (6, long), (7, long.upper()), (8, "a"), (9, "ünï cödé  text\n\nwith lines"), (10, "x\n" * 300)]
