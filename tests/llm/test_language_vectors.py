"""Language identification and vector search."""

import math
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from llm_fixtures import SMALL, make_docs  # noqa: F401

from caselink.llm import language_id, vector_search


def brute_bits(counts, lang, text):
    """Code length by walking the contexts of one byte after another."""
    grams = {}
    for gram, n in counts[lang].items():
        for order in range(4):
            context, byte = gram[3 - order : 3], gram[3]
            grams.setdefault(context, {})
            grams[context][byte] = grams[context].get(byte, 0) + n
    raw, total = b"\n\n\n" + text.encode(), 0.0
    for i in range(3, len(raw)):
        bits = 0.0
        for order in (3, 2, 1, 0):
            seen = grams.get(raw[i - order : i], {})
            n, d = sum(seen.values()), len(seen)
            if not n:
                continue
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
        total += bits
    return total


def test_code_lengths_are_exact():
    texts = {"xx": "the cat and the hat\nthen that", "yy": "der hut und die katze über"}
    counts, rows = {}, []
    for lang, text in texts.items():
        raw = b"\n\n\n" + text.encode()
        counts[lang] = {}
        for i in range(len(raw) - 3):
            counts[lang][raw[i : i + 4]] = counts[lang].get(raw[i : i + 4], 0) + 1
        rows += [(lang, int.from_bytes(g, "big"), n) for g, n in counts[lang].items()]
    trees = language_id.ContextTrees(pa.Table.from_pandas(pd.DataFrame(rows, columns=["lang", "gram", "n"])))
    probes = ["", "the", "x", "über und ü", "then the \x00 cat", "日本"]
    got = trees.bits(probes)
    expected = [[brute_bits(counts, lang, p) for lang in trees.langs] for p in probes]
    assert np.allclose(got, expected, rtol=1e-5, atol=1e-4)


def test_many_languages_of_all_bytes_stay_small():
    r, counts, rows = np.random.default_rng(3), {}, []
    for k in range(20):
        grams = np.unique(r.integers(0, 1 << 32, 100_000, dtype=np.uint64))
        n = r.integers(1, 9, len(grams))
        rows.append(pa.table({"lang": [f"l{k:02d}"] * len(grams), "gram": grams.astype(np.int64), "n": n}))
        if k < 3:
            counts[f"l{k:02d}"] = {int(g).to_bytes(4, "big"): int(m) for g, m in zip(grams, n)}
    table = pa.concat_tables(rows)
    tracemalloc.start()
    trees = language_id.ContextTrees(table)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # Two million runs of four bytes; a row of 20 costs for each would take 160 MB at every order.
    assert held < 120e6 and most < 300e6
    assert held < 1.2 * sum(c.nbytes for c in (*trees.cost, *trees.escape))
    probes = ["", "über 日本 \x00", "क्या", "plain"]
    got = trees.bits(probes)[:, :3]
    expected = [[brute_bits(counts, lang, p) for lang in trees.langs[:3]] for p in probes]
    assert np.allclose(got, expected, rtol=1e-5, atol=1e-3)


def test_windows_of_long_texts_agree(monkeypatch):
    rows = [("a", int.from_bytes(g, "big"), 1) for g in (b"abcd", b"bcda", b"xabc")]
    trees = language_id.ContextTrees(pa.Table.from_pandas(pd.DataFrame(rows, columns=["lang", "gram", "n"])))
    texts = ["abcd" * 50, "", "x", "bcda" * 9]
    whole = trees.bits(texts)
    monkeypatch.setattr(language_id, "_STEP", 7)
    assert np.allclose(trees.bits(texts), whole)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id.predictions(docs).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_and_labels_do_not_leak(spark, make_docs):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = language_id.fold(docs["doc_id"]) == 0
    other = docs.withColumn("lang", language_id.F.when(held, "zz").otherwise(docs["lang"])).withColumn("source", language_id.F.col("lang"))
    same = [sorted(language_id.predictions(d).collect()) for d in (docs, other)]
    assert same[0] == same[1]


def test_unlabelled_documents_with_a_letter_stay(spark, make_docs):  # noqa: F811
    docs = make_docs((1, "some words", None), (2, "12 - 34", None), (3, None, None), (4, "é", None), (5, "", None), extra=True)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_edge_texts_of_languages(spark, make_docs):  # noqa: F811
    train = [(i, "the cat and the hat " * 5, "en") for i in range(20)] + [(i + 20, "der hut und die katze " * 5, "de") for i in range(20)]
    docs = make_docs(*train, (50, None), (51, ""), (52, "12 .. 34"), (None, "the hat"), (53, "die katze " * 40_000, None), (53, "the"), extra=True)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predictions(docs).collect() if r["doc_id"] is None or r["doc_id"] >= 50}
    assert got == {(50, "und"), (51, "und"), (52, "und"), (None, "en"), (53, "de"), (53, "en")}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 3
    # Nothing to learn from, nothing to tell.
    assert {r["lang_pred"] for r in language_id.predictions(make_docs((1, "the", None))).collect()} == {"und"}
    assert language_id.predictions(docs.limit(0)).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_neighbours(rows, k=10, every=100):
    good = [
        (i, np.array(v, np.float32).astype(float))
        for i, v, _ in rows
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)
    ]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in good if j != i)[:k]
            out[i] = [(j, d) for d, j in near]
    return out


def found(frame):
    out = {}
    rows = sorted(vector_search.neighbours(frame).collect(), key=lambda r: (r["query_id"], r["rank"]))
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    expected = brute_neighbours([(r["vec_id"], r["embedding"], 0) for r in frame.collect()])
    got = found(frame)
    assert set(got) == set(expected)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / len(expected[q]) for q in expected]
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("block", [4096, 50])
def test_all_leaves_give_the_exact_answer(spark, monkeypatch, block):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(vector_search, "RECALL", 1.0)
    r = np.random.default_rng(2)
    # A third of the rows share one vector, others repeat in part: many ties.
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else r.integers(-2, 3, 3).tolist(), 0) for i in range(900)]
    rows = [(i, [float(x) for x in v] if any(v) else [1.0, 0.0, 0.0], t) for i, v, t in rows]
    frame = spark.createDataFrame(rows, VECTORS)
    got = {q: n for q, n in found_with_recall(frame).items()}
    assert got == brute_neighbours(rows)


def found_with_recall(frame):
    rows = vector_search.search(frame, vector_search.run_folder(frame.sparkSession, "t"), recall=1.0).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1),
        (6, [None, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (100, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (None, [1.0, 0.0], 1),
        (200, [0.0, 0.0], 1), (300, None, 1),
    ]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS leaf", "'x' AS v", "2 AS query_id")
    assert found(frame) == {0: [(8, 0.0), (8, 0.0), (100, 0.0), (1, math.sqrt(2))], 100: [(0, 0.0), (8, 0.0), (8, 0.0), (1, math.sqrt(2))]}
    assert found(frame.limit(0)) == {}
    assert found(frame.filter("vec_id = 1")) == {}
    assert found(frame.filter("vec_id = 100")) == {}
