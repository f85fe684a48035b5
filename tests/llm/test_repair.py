import itertools
import random
import re

import duckdb

from caselink.llm import queries, repair
from compare import connect, differences
from conftest import SMALL

GRAMMAR = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string"


def cheapest(kinds, most=2):
    """(cost, audit) by trying all edits, with at most ``most`` inserted turns between rows."""
    best = None
    gaps = [""] + ["".join(p) for n in range(1, most + 1) for p in itertools.product("ua", repeat=n)]

    def go(i, roles, cost, audit):
        nonlocal best
        for added in gaps:
            now, paid, told = roles + added, cost + 3 * len(added), audit + "I" * len(added)
            if best is not None and paid > best[0]:
                continue
            if i == len(kinds):
                if GRAMMAR.fullmatch(now) and (best is None or (paid, told) < best):
                    best = (paid, told)
                continue
            kind = kinds[i]
            go(i + 1, now, paid + 4, told + "D")
            if kind != "d":
                extra = 3 if kind.isupper() else 0
                if kind.lower() != "x":
                    go(i + 1, now + kind.lower(), paid + extra, told + "K")
                for role in "ua":
                    go(i + 1, now + role, paid + 3 + extra, told + "R")

    go(0, "", 0, "")
    return best


def test_cheapest_edits_against_trying_all():
    random.seed(5)
    for n in range(5):
        for _ in range(40):
            kinds = "".join(random.choice("dsuaxSUAXuaua") for _ in range(n))
            assert repair.best_end(repair.parse(kinds))[1:] == cheapest(kinds), kinds


def test_every_split_of_a_span_gives_the_same_cell():
    random.seed(6)
    for _ in range(30):
        kinds = "".join(random.choice("dsuaxSUAXuaua") for _ in range(random.randint(1, 20)))
        chart = {(i, i + 1): repair.row_cell(k) for i, k in enumerate(kinds)}
        for length in range(2, len(kinds) + 1):
            for i in range(len(kinds) - length + 1):
                cells = {repair.combine(chart[i, m], chart[m, i + length]) for m in range(i + 1, i + length)}
                assert len(cells) == 1
                chart[i, i + length] = cells.pop()
        assert repair.parse(kinds) == chart[0, len(kinds)]


def test_a_replayed_audit_follows_the_grammar():
    random.seed(7)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(100):
        kinds = "".join(random.choice("dsuaxuaua") for _ in range(random.randint(0, 12)))
        rows = [(names.get(k, "user"), str(i)) for i, k in enumerate(kinds)]
        _, _, audit = repair.best_end(repair.parse(kinds))
        left = list(repair.replay(audit, rows))
        assert GRAMMAR.fullmatch("".join(role[0] for _, _, role, _ in left))
        assert all(role == rows[n][0] for n, edit, role, _ in left if edit == "K")


def summaries(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def against_sql(spark, turns, **options):
    """Summaries of damaged turns, however they are cut, against the SQL."""
    duck = duckdb.connect()
    duck.register("conversations", turns.toArrow())
    _, found = repair.repair(repair.damage(turns), **options)
    expected = duck.sql(repair.SQL).to_arrow_table().to_pylist()
    names = list(repair._SUMMARY)
    got = {r["conv_id"]: r.asDict() for r in found.collect()}
    for row in expected:
        if row["audit"]:
            assert got.pop(row["conv_id"]) == {n: row[n] for n in names}
    assert not got


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
TEXTS = ["One.", "Two!", "Three", "", " \t", None, "One.", "é?", "a\x0b", "Long. " * 50]


def random_turns(spark, n, conversations, seed=1, turns=40):
    random.seed(seed)
    pick = lambda xs: xs[random.randrange(len(xs))]
    rows = [(pick(conversations), pick([None, *range(turns)]), pick(ROLES), pick(TEXTS)) for _ in range(n)]
    return spark.createDataFrame(rows, TURNS)


def test_nulls_ties_and_repeats_against_sql(spark):
    against_sql(spark, random_turns(spark, 400, [None, 1, 2, 3, 4, 5, 6, 7]))


def test_one_conversation_over_blocks_and_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = random_turns(spark, 300, [9, 9, 9, None, 1, 2], seed=2, turns=500)
        against_sql(spark, hot, held=10, block=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Are you there?"), (1, 2, "assistant", "Yes."), (2, 0, "tool", "x."), (3, 5, "user", " ")]
    repaired, found = repair.repair(spark.createDataFrame(rows, TURNS))
    turns = [(r["conv_id"], r["turn"], r["edit"], r["role"], r["text"]) for r in repaired.orderBy("conv_id", "at", "step").collect()]
    assert turns == [
        (1, 0, "K", "user", "Hi."),
        (1, None, "I", "assistant", ""),
        (1, 1, "K", "user", "Are you there?"),
        (1, 2, "K", "assistant", "Yes."),
    ]
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()} == {1: (3, "KIKK"), 2: (4, "D"), 3: (4, "D")}


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repaired_digests(none).collect() == []
    clash = spark.createDataFrame([(1, 0, "user", "Hi.")], TURNS).selectExpr("*", "'x' AS at", "'y' AS kind", "'z' AS audit")
    plain = clash.select("conv_id", "turn", "role", "text")
    assert summaries(repair.repaired_digests(clash)) == summaries(repair.repaired_digests(plain))


def test_a_conversation_without_rows_left(spark):
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.repaired_digests(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def test_query(spark):
    assert differences(connect(SMALL), queries.op12_repair(spark, SMALL), queries.SQL["op12_repair"]) == []
