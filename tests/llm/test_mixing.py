import random
from collections import Counter

import duckdb
import pytest

from caselink.llm import mixing, queries
from compare import connect, differences
from conftest import SMALL

DOCS = "doc_id long, text string, source string"


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def against_sql(docs):
    duck = duckdb.connect()
    duck.register("documents", docs.select("doc_id", "text", "source").toArrow())
    assert differences(duck, mixing.mixed(docs), mixing.SQL) == []


def words(n, word="w"):
    return " ".join([word] * n)


def water_filled(sizes, weights, cap=3):
    """Targets by resharing the excess until none is above its cap."""
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = total - sum(stopped.values())
        weight = sum(w for k, w in weights.items() if k not in stopped)
        target = {k: rest * w / weight for k, w in weights.items() if k not in stopped}
        over = [k for k, t in target.items() if t > cap * sizes[k]]
        if not over:
            return target | stopped
        stopped |= {k: float(cap * sizes[k]) for k in over}


def test_targets_against_resharing(spark):
    random.seed(1)
    for seed in range(3):
        sizes = {f"s{i:02}": random.choice([1, 3, 10, 40, 200, 900]) for i in range(12)}
        docs = table(spark, [(i, words(n), s) for i, (s, n) in enumerate(sizes.items())])
        got = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        assert got == pytest.approx(water_filled(sizes, weights))


def check(docs, block=mixing.BLOCK):
    rows = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for source, aim in target.items():
        assert abs(taken[source] - aim) <= 4 * block, (source, taken[source], aim)
    return rows


def test_a_source_with_a_third_of_all_rows(spark):
    random.seed(2)
    rows = [(i, words(random.randint(0, 60)), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(1500)]
    docs = table(spark, rows)
    first = check(docs)
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    against_sql(docs)


def test_nulls_ties_repeats_and_empty_texts(spark):
    rows = [(None, words(30), "a"), (None, words(31), "a"), (1, None, "a"), (1, "", None), (2, " \t\n", "b"), (3, words(50), None), (3, words(50), None)]
    rows += [(4, words(5), ""), (5, words(200), "é"), (6, words(200, "x"), "z"), (6, words(200, "x"), "z"), (7, None, "empty")]
    docs = table(spark, rows)
    check(docs)
    against_sql(docs)
    clash = docs.selectExpr("*", "1 AS size", "2 AS key", "3 AS lane", "4 AS target", "5 AS quotas", "6 AS draw")
    assert sorted(map(str, mixing.mixed(clash).collect())) == sorted(map(str, mixing.mixed(docs).collect()))


def test_a_very_long_text(spark):
    docs = table(spark, [(1, words(300_000), "a"), (2, words(100), "b"), (3, words(5000), "c")])
    check(docs)
    against_sql(docs)


def test_empty_tables(spark):
    assert mixing.mixed(table(spark, [])).collect() == []
    assert [tuple(r) for r in mixing.mixed(table(spark, [(1, None, "a")])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_plan_has_no_python(spark):
    plan = mixing.mixed(table(spark, [(1, "a b", "s")]))._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_query(spark):
    assert differences(connect(SMALL), queries.op13_mixing(spark, SMALL), queries.SQL["op13_mixing"]) == []
