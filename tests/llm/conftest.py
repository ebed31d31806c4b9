import pytest

CLASHING = "CAST(7 AS bigint) AS doc, 'x' AS key, 'y' AS row, CAST(1 AS int) AS h, 'z' AS words, CAST(NULL AS string) AS spans, 3.5 AS length, true AS kept, 'k' AS class, 'l' AS label, 0 AS rank, 'i' AS ids"


@pytest.fixture
def docs_of(spark):
    """Makes a table of documents from texts (None for null), with further columns of clashing names."""

    def make(texts, langs=None, ids=None):
        ids = ids or list(range(len(texts)))
        langs = langs or [None] * len(texts)
        rows = [(i, t, g, None, None) for i, t, g in zip(ids, texts, langs, strict=True)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *CLASHING.split(", "))

    return make


@pytest.fixture
def folder_of(docs_of, tmp_path):
    """Writes such documents as a table folder."""

    def make(texts, langs=None, ids=None, name="documents"):
        docs_of(texts, langs, ids).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make

