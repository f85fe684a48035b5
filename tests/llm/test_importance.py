import re
import zlib

import duckdb
import numpy as np
import pytest

from caselink.llm import importance, queries
from compare import connect, differences
from llm_fixtures import SMALL, make_docs  # noqa: F401

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", "a", "A b", "one two  two\tone", "Zoë é日本 ẞ", "x\x01y", "a" * 5000 + " b", "1 2 3 " * 400, "\x80\x85\xa0 q", "--", "w" + " " * 50 + "w"]


def buckets_of(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return sorted(zlib.crc32(r.encode()) % importance.BUCKETS for r in runs)


def test_composed_checksums():
    rng = np.random.default_rng(2)
    messages = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 2, 7, 8, 255, 256, 257, 70_000)]
    pairs = [(a, b) for a in messages for b in messages]
    crc = lambda side: np.array([zlib.crc32(p[side]) for p in pairs], np.uint32)
    joined = importance.compose(crc(0), crc(1), np.array([len(b) for _, b in pairs]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("stretch", [1, 7, 100, 2_000_000])
def test_scanned_buckets(stretch):
    got = [[] for _ in ODD]
    words = np.zeros(len(ODD), int)
    for word_owner, owner, bucket in importance.scan_features(ODD, stretch=stretch):
        words += np.bincount(word_owner, minlength=len(ODD))
        for i, b in zip(owner, bucket):
            got[i].append(b)
    assert [sorted(g) for g in got] == [buckets_of(t) for t in ODD]
    assert words.tolist() == [len(WORDS.findall(t.lower())) for t in ODD]


def against_sql(spark, docs, target):
    duck = duckdb.connect()
    duck.register("documents", docs.select("doc_id", "text").toArrow())
    duck.register("benchmark", target.toArrow())
    assert differences(duck, importance.resampled(docs, target), importance.SQL) == []


def items(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_odd_texts_nulls_ties_and_repeats(spark, make_docs):
    long = "some words that make up one rather long text of more than twenty words so that it can be drawn at all by score "
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (None, long), (None, long * 2), (91, long), (91, long), (92, long * 3), (93, long.upper())]
    against_sql(spark, make_docs(*rows, extra=True), items(spark, "one rather long text", None, ""))


def test_a_third_of_all_rows_are_one_text(spark, make_docs):
    text = "word " * 25
    rows = [(i, text if i % 3 == 0 else f"{text} {i} other{i % 7}") for i in range(300)]
    docs = make_docs(*rows)
    against_sql(spark, docs, items(spark, "other1 other2"))
    drawn = [r for r in importance.resampled(docs, items(spark, "other1")).collect() if r["rank"] is not None]
    assert sorted(r["rank"] for r in drawn) == list(range(1, 76))


def test_empty_tables(spark, make_docs):
    assert importance.resampled(make_docs().limit(0), items(spark, "a")).collect() == []
    against_sql(spark, make_docs((1, "a b"), (2, "c")), items(spark).limit(0))


def test_query(spark):
    assert differences(connect(SMALL), queries.op11_importance(spark, SMALL), queries.SQL["op11_importance"]) == []


def test_target_like_documents_are_drawn(spark, make_docs):
    like, unlike = "alpha beta gamma delta " * 8, "stone river cloud field " * 8
    docs = make_docs(*[(i, like if i % 4 == 0 else unlike) for i in range(400)])
    drawn = importance.resample(docs, items(spark, like)).filter("rank IS NOT NULL").select("doc_id").collect()
    # 25 of the 100 drawn by chance.
    assert sum(r["doc_id"] % 4 == 0 for r in drawn) >= 60
