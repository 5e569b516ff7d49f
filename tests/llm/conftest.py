import duckdb
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size bigint, mark string, key bigint, _key string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, blank and very long texts, ties, repeated rows, columns named as operators name theirs."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "a b\nc d\ne f\ng h", "en", "s1"),
        (2, "a b\nc d\ne f\n\ni j", "en", "s2"),
        (2, "a b\nc d\ne f\n\ni j", "en", "s2"),
        (3, None, "en", "s1"),
        (4, "", None, None),
        (5, " \t\n\x0b\x0c\r ", "de", None),
        (6, "a b\nc d\ne f\ng h", None, "s3"),
        (None, "a b\nc d\ne f\ng h", "de", "s3"),
        (None, None, None, None),
        (7, long, "de", "s1"),
        (8, long + " end", "de", "sé"),
        (9, "12 34 !!", "en", "S"),
        (10, "idiot idiot idiot", "en", "S"),
    ]
    return [(*r, None if r[0] == 9 else len(r[1] or ""), "r", 7, "m", None, "k") for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def engine(sf):
    connection = duckdb.connect()
    for name in ("documents", "labels", "conversations", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection
