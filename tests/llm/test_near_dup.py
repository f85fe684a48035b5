"""Near duplicates, decontamination and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from llm_fixtures import SMALL, make_docs  # noqa: F401
from pyspark.sql import functions as F

from caselink.llm import common, decontaminate, near_dup, shingles


def brute_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(docs):
    """{doc_id: component} by comparing all pairs."""
    sets = {}
    for doc_id, text in docs:
        sets.setdefault(doc_id, []).append(brute_set(text))
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = sorted((find(x), find(y)))
                least[q] = p
    return {i: find(i) for i in ids}


def words(r, n):
    return [r.choice("ab cd ef gh ij kl mn op qr st uv wx yz the of".split()) + str(r.randrange(9)) for _ in range(n)]


def test_hashed_shingles_are_the_sets():
    r = random.Random(3)
    texts = ["", " \t\n", "One", "one two", "A b C d", "a b c d e", "a b c d e a b c d e", "x\x1cy z w", "É é", " ".join(words(r, 400))]
    for text in texts:
        got = shingles.sequence_shingles(shingles.word_sequence(text))
        assert len(got) == len(brute_set(text))
    a, b = " ".join(words(r, 60)), " ".join(words(r, 20))
    both = np.intersect1d(*(shingles.sequence_shingles(shingles.word_sequence(t)) for t in (a + " " + b, b + " " + a)))
    assert len(both) == len(brute_set(a + " " + b) & brute_set(b + " " + a))


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        n = 1000
        pool = r.integers(0, 2**63, 2 * n).astype(np.uint64)
        k = int(round(2 * share * n / (1 + share)))
        a, b = pool[:n], np.concatenate([pool[n - k : n], pool[n : 2 * n - k]])
        x, y = near_dup.signatures([a, b], 2000)
        assert abs((x == y).mean() - k / (2 * n - k)) < 0.05


def test_same_shift_for_any_grouping():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 40_000, 3, 500)]
    together = near_dup.signatures(sets, 20)
    assert all((near_dup.signatures([s], 20)[0] == t).all() for s, t in zip(sets, together))


def groups(r):
    """Chains and clusters of near copies, exact copies, passages in common, short and empty texts."""
    docs, at = [], 0

    def add(text):
        nonlocal at
        docs.append((at, text))
        at += r.randrange(1, 4)

    passage = words(r, 60)
    for _ in range(12):
        base = words(r, r.choice([6, 30, 120]))
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 30)):
                copy[r.randrange(len(copy))] = "changed" + str(r.randrange(99))
            add(" ".join(copy).upper() if r.random() < 0.2 else "\n".join(copy))
            if r.random() < 0.5:
                base = copy
    for _ in range(25):
        add(" ".join([*words(r, 20), *passage, *words(r, 20)]))
    for text in (None, "", " ", "one", "One", "one two", "one two three four", "ONE two three four", "one two three four five"):
        add(text)
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("large", [64, 2])
def test_components_are_those_of_all_pairs(spark, make_docs, monkeypatch, seed, large):  # noqa: F811
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "BLOCK", 3 if large == 2 else 256)
    docs = groups(random.Random(seed))
    expected = brute_components(docs)
    got = near_dup.near_duplicates(make_docs(*docs, extra=True)).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(brute_set(t)) for i, t in docs}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("large", [64, 2])
def test_hubs_of_another_size(spark, make_docs, monkeypatch, large):  # noqa: F811
    """One bucket whose hub of both star rounds is much shorter than two members that are alike."""
    plain = near_dup.prepared
    monkeypatch.setattr(near_dup, "prepared", lambda docs: plain(docs).withColumn("bands", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(near_dup, "LARGE", large)
    hub = spark.range(1000).orderBy(F.xxhash64("id", F.lit(1).cast("long"))).first()["id"]
    long = " ".join(words(random.Random(7), 200))
    docs = [(hub, "one two three four five six"), (hub + 1, long), (hub + 2, long + " tail")]
    hashes = spark.range(hub, hub + 3).select("id", F.xxhash64("id", F.lit(1).cast("long")).alias("h")).orderBy("h")
    assert hashes.first()["id"] == hub
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(make_docs(*docs)).collect()}
    assert got == brute_components(docs) == {hub: hub, hub + 1: hub + 1, hub + 2: hub + 1}


def test_stars_of_links(spark):
    links = [(1, 2), (2, 3), (3, 9), (10, 11), (12, 11), (13, 12), (14, 13), (20, 5), (5, 6)]
    frame = spark.createDataFrame(links, "a long, b long")
    folder = common.run_folder(spark, "test_stars")
    got = {r["id"]: r["component"] for r in near_dup.components(frame, folder, "c").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 20: 5, 5: 5, 6: 5}


def test_null_ids_repeats_and_no_rows(spark, make_docs):  # noqa: F811
    long = " ".join(words(random.Random(5), 3000))
    docs = make_docs((None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (5, long), (6, long + " tail"), (None, None))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (3, 2, False), (3, 2, False), (2, 2, True), (5, 5, True), (6, 5, False)], key=str)
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []


def brute_pairs(docs, items):
    out = {}
    for item_id, text in items:
        item = brute_set(text)
        length = len(min(item, default=()))
        for doc_id, body in docs:
            split = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or "")) if w]
            shared = len(item & {tuple(split[i : i + length]) for i in range(len(split) - length + 1)})
            if item and 100 * shared >= 75 * len(item):
                out[doc_id, item_id] = (len(item), max(shared, out.get((doc_id, item_id), (0, 0))[1]))
    return out


def items_and_documents(r):
    items = [(i, " ".join(words(r, n))) for i, n in enumerate([1, 3, 5, 6, 20, 40, 130, 300, 2, 4])] + [(50, None), (51, " ")]
    docs = []
    for k in range(80):
        body = words(r, r.choice([0, 10, 300, 2000]))
        if k % 2:
            item = (r.choice(items)[1] or "").split()
            for _ in range(r.randrange(0, 1 + len(item) // 12)):
                item[r.randrange(len(item))] = "other"
            body[5:5] = item
        docs.append((k, " ".join(body).upper() if k % 3 == 0 else "\n".join(body)))
    docs += [(200, items[0][1]), (201, items[1][1].upper()), (202, items[1][1] + " more"), (203, None), (None, items[5][1]), (204, items[5][1]), (204, "x")]
    return items, docs


def test_contaminated_pairs(spark, make_docs):  # noqa: F811
    items, docs = items_and_documents(random.Random(4))
    frame = spark.createDataFrame(items + [items[4]], "item_id long, text string")
    got = decontaminate.contamination(make_docs(*docs, extra=True), frame).collect()
    assert {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared"]) for r in got} == brute_pairs(docs, items)
    assert len(got) == len(brute_pairs(docs, items))


def test_shuffled_sketches_give_the_same(spark, make_docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    items, docs = items_and_documents(random.Random(6))
    got = decontaminate.contamination(make_docs(*docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(brute_pairs(docs, items))


def test_clean_documents_stay(spark, make_docs):  # noqa: F811
    items, docs = items_and_documents(random.Random(8))
    frame = make_docs(*docs, extra=True)
    kept = decontaminate.keep_clean(frame, spark.createDataFrame(items, "item_id long, text string"), common.run_folder(spark, "test_clean"))
    bad = {doc for doc, _ in brute_pairs(docs, items)}
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_sketches_cannot_miss_at_any_size(spark):
    """As many values as a document may lack of the item, and one more, for each size."""
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n + 4))) for n in (1, 2, 3, 4, 7, 8, 100, 127, 128, 129, 1000, 5000)]
    sets = decontaminate.item_sets(spark.createDataFrame(items, "item_id long, text string"))
    kept = {r["item_id"]: r["count"] for r in decontaminate.sketches(sets).groupBy("item_id").count().collect()}
    assert {r["item_id"]: r["n_item"] for r in sets.collect()} == {n: n for n, _ in items}
    for n, count in kept.items():
        assert n - -(-75 * n // 100) + 1 <= count <= n // 2 + 1


def test_short_items_are_found_inside_long_documents(spark, make_docs):  # noqa: F811
    items = spark.createDataFrame([(1, "Red fox"), (2, "the red fox ran"), (3, "one two three four five six")], "item_id long, text string")
    docs = make_docs((1, "and the red fox ran on " * 500), (2, "red a fox"), (3, "RED\nFOX"), (4, "one two three four five seven"), (None, "a red fox"), (None, "no"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (3, 1), (None, 1)}


def test_a_third_of_rows_without_an_id(spark, make_docs):  # noqa: F811
    items, docs = items_and_documents(random.Random(9))
    docs = [(None if i % 3 == 0 else d, t) for i, (d, t) in enumerate(docs)]
    got = decontaminate.contamination(make_docs(*docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared"]) for r in got} == brute_pairs(docs, items)


def test_no_items_or_no_documents(spark, make_docs):  # noqa: F811
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    docs = make_docs((1, "a b c d e"))
    assert decontaminate.contamination(docs.limit(0), items).collect() == []
    assert decontaminate.contamination(docs, items.limit(0)).collect() == []


def test_decontamination_is_native(spark, make_docs):  # noqa: F811
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plan = decontaminate.contamination(spark.read.parquet(f"{SMALL}/documents.parquet"), items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_shared_counts():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 50, n).astype(np.uint64)) for n in (0, 1, 20, 30, 90)]
    expected = [[len(np.intersect1d(a, b)) * (i != j) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for columns in (3, 4096):
        got = near_dup.shared_counts(sets, columns)
        np.fill_diagonal(got, 0)
        assert (got == expected).all()
    assert near_dup.shared_counts([]).shape == (0, 0)
