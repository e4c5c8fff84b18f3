import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
SENTENCE = "the quick brown fox jumps over the lazy dog while seven old men count the boats on the river "
#: nulls in every column, empty and very long texts, ties, repeated rows, texts without words or letters
ODD = [
    (1, "a short text of very few words", "en", "web", 30),
    (2, None, "en", "web", None),
    (3, "", "fr", None, 0),
    (4, " \t\n\r ", None, "web", 5),
    (5, "12345 67890 !!! ### 9", "en", "books", 21),
    (6, SENTENCE * 3, "en", "web", 279),
    (7, SENTENCE * 3, "en", "books", 279),
    (7, SENTENCE * 3, "en", "books", 279),
    (8, LONG, "de", "web", len(LONG)),
    (None, "a text whose id is null and which is otherwise plain", None, None, None),
    (None, None, None, None, None),
    (9, "naïve café — 日本語 text 😀   here \x00 end", "fr", "web", 40),
    (10, "une phrase courte avec quelques mots de plus pour voir si cela suffit bien", "fr", "books", 75),
]
#: names that the operators use inside, in other types
EXTRA = ["key", "node", "KIND", "__key", "__node", "__copy", "__copies", "__id", "__th", "__kept", "size", "shard", "count", "bucket", "rank", "row", "value", "th", "h", "g", "n", "x", "score", "copies", "held_out", "body"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """The same with further columns; their values tell whether they came through."""
    rows = [(*r, *[f"{c}-{i}" for c in EXTRA]) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in EXTRA))


@pytest.fixture(scope="session")
def none_at_all(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest tables, and their rows."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d, d.collect()
