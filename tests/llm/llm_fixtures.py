import pytest

SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs or (doc_id, text, lang) triples."""

    def build(*rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, DOCS)
        if extra:
            # Columns that carry the names operators use for their own.
            for name in ("n_tokens", "kept", "component_id", "words", "key", "id", "a", "b", "bucket", "hash", "spans", "_found_pred", "_gone", "_bad", "token_ids", "text_a"):
                docs = docs.selectExpr("*", f"'x' AS `{name}`")
        return docs

    return build
