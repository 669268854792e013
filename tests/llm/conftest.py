import pytest


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A table folder with the odd cases: nulls, empty and long texts, repeated rows, clashing columns."""
    folder = tmp_path_factory.mktemp("small")
    base = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a"),
        (2, "the QUICK brown fox jumps over the lazy dog near the river bank today", "a"),
        (3, None, None), (4, "", "b"), (5, "   \n\t ", "b"), (6, "one", "b"), (6, "one", "b"), (None, "no id at all here my friend", "c"), (None, None, "c"),
        (7, "mail me at a.b@c.example or +1 (212) 555-0100, not 10.0.0.256 but 10.0.0.25\nnext line", "é"),
        (8, "word " * 30_000, "a"), (9, "x" * 60_000, "\U0001f600"), (-4, "4111 1111 1111 1111 is a card", "a"), (2**53 + 1, "large id", "b"),
    ]
    # Names that the operators use themselves; their values must come through.
    clash = ["fp", "size", "k", "spans", "score", "_row", "_n", "_1", "_h", "_hash", "_clean", "h", "root", "base"]
    docs = [(i, t, s, "en", *[f"{c} of {i}" for c in clash]) for i, t, s in base]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in clash)
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(1, 1, 0), (2, 1, 0), (6, 0, 0), (8, 0, 0), (None, 1, 0), (9, None, 0), (7, 1, 0), (77, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)
