"""The pipeline and the registered queries as a whole."""

import duckdb
import public_tokenizers
from compare import connect, differences
from llm_fixtures import SMALL
from sentencepiece import SentencePieceProcessor
from test_near_dup import brute_components, brute_pairs

import corpus_pipeline
import pytest
from caselink.llm import language_id, queries, secret_scan


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    assert differences(connect(SMALL), queries.QUERIES[name](spark, SMALL), queries.SQL[name]) == []


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    verdict = {r["doc_id"]: r for r in language_id.predictions(docs).collect()}
    left = {i: rows[i]["text"] for i in rows if verdict[i]["lang_pred"] != "und" and verdict[i]["score"] >= 0.5}
    component = brute_components(list(left.items()))
    left = {i: t for i, t in left.items() if component[i] == i}
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    bad = {doc for doc, _ in brute_pairs(list(left.items()), items)}
    left = {i: t for i, t in left.items() if i not in bad}
    network = secret_scan.train(docs.filter(docs["doc_id"].isin(list(left))))
    clean = {}
    for i, spans in zip(left, secret_scan.spans_of(list(left.values()), network)):
        text, at = "", 0
        for a, _, b in spans:
            text, at = (text + left[i][at:a] + "[SECRET]" if a >= at else text), max(at, b)
        clean[i] = text + left[i][at:]
    lib = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(clean) and len(clean) < len(rows)
    for i, row in got.items():
        assert (row["text"], row["n_chars"], row["token_ids"]) == (clean[i], len(clean[i]), lib.encode(clean[i]))
        assert row["n_tokens"] == len(row["token_ids"])
        assert (row["lang"], row["source"]) == (rows[i]["lang"], rows[i]["source"])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.schema.names == docs.schema.names and out.collect() == []
    _, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, SMALL).collect() == []
