import duckdb
import pytest

EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, fp string, row string, text_key string, component_id string, classes string"


def edge_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like helper columns."""
    long = " ".join(f"w{i % 977}x{i % 131}" for i in range(30_000))
    plain = "The house of the river was on the hill and it had a door for that in the wall. " * 8
    texts = [
        (1, plain, "en"), (2, plain, "en"), (3, plain + "And a roof.", None), (None, plain, "en"), (None, None, None),
        (4, "", "en"), (4, "", "en"), (5, None, "de"), (6, " \n\t ", "fr"), (7, long, "en"), (7, "one two three", "en"),
        (8, "Mail a.b@c.example.org, 10.1.2.3 or +1 (743) 555-3824.\n4111111111111111 end", "en"), (9, "<|endoftext|> x", "xx"),
        (10, "ÉTÉ ŒUVRE 日本 語 ॐ" * 3, "fr"),
    ]
    return [(i, t, g, "s", None, "a", "b", "c", "d", "e", "f") for i, t, g in texts]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), EXTRA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def con(sf):
    db = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return db
