"""Similar cases for many base cases at once: cosine of TF-IDF weights, exact pools, top k.

Order everywhere: similarity rounded to 9 places, descending, then the lowest case id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.functions.text import text_id
from caselink.operators.asked import asked_counts, asked_weights, nearest_counted, nearest_of
from caselink.operators.pruned import nearest_matches
from caselink.operators.skew import first_rows, heavy_keys, spread_join, top_per_key
from caselink.schema import CASE_COLUMNS
from caselink.sources.text_index import TextIndex, leading_cases, with_weights, within

DIGITS = 9
# Pairs of texts that one task handles for one term in the term join.
BLOCK_PAIRS = 1 << 24
# Two unit vectors whose cosine rounds to 1 differ by less than WIDTH in every weight, and a set
# of terms that holds more than RESIDUE of a vector's squared length cannot be missing in the other.
WIDTH = 1e-4
RESIDUE = 4e-9

# Rows of reaching texts up to which they are sent to the leading cases, whose texts then stay where they are.
SENT = 200_000

# Bytes up to which the lists of all texts are sent to the bases of a ranking, and what a case has besides its text.
LISTED, CASE_BYTES = 64 << 20, 250

WILDCARDS = (None, "", "All")


def pool_size(k: int) -> int:
    """Rows taken by similarity before self, area and weapon are looked at."""
    return max(200, 10 * k)


def _rounded(total: Column) -> Column:
    return F.round(total, DIGITS).alias("similarity")


def _sparse_matches(asked: DataFrame, weights: DataFrame, n_asked: Column) -> DataFrame:
    """Cosine of every asked text with every text that shares a term.

    The postings of a frequent term are cut into blocks on both sides so that no task makes more
    than about BLOCK_PAIRS pairs of one term; ``n_asked`` bounds how many asked texts can meet there.
    A row is repeated once per block of the other side, that is once per thousands of the pairs it
    makes. A term whose pairs fit one task is one block.
    """
    meeting = F.least(F.col("n_texts"), n_asked)
    side = math.isqrt(BLOCK_PAIRS)
    q_blocks = F.ceil(meeting / F.lit(side))
    c_blocks = F.ceil(F.col("n_texts") * F.least(meeting, F.lit(side)) / F.lit(BLOCK_PAIRS))
    blocks = lambda n: F.greatest(n, F.lit(1)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    own = lambda text, n: F.pmod(F.xxhash64(text), blocks(n))
    left = asked.select("q_text", "term", "q_weight", own("q_text", q_blocks).alias("q_block"), each(c_blocks).alias("c_block"))
    right = weights.select(
        F.col("text_id").alias("c_text"), "term", "weight", each(q_blocks).alias("q_block"), own("text_id", c_blocks).alias("c_block")
    )
    return (
        left.join(right, ["term", "q_block", "c_block"])
        .groupBy("q_text", "c_text")
        .agg(_rounded(F.sum(F.col("q_weight") * F.col("weight"))))
    )


def _identical_matches(asked: DataFrame, weights: DataFrame) -> DataFrame:
    """Cosine of every asked text with the texts where it rounds to 1 (and a few below).

    Enough for a text whose own copies fill the pool: nothing below 1 can enter. Such texts agree
    in the weight of the asked text's rarest term, so only near-equal weights of that one term are
    joined and the full sum is taken over the few pairs left.
    """
    rare_first = W.partitionBy("q_text").orderBy("n_texts", "term").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("q_weight") * F.col("q_weight")).over(rare_first), F.lit(0.0))
    slot = lambda w: F.floor(w / F.lit(WIDTH))
    anchors = (
        asked.withColumn("before", before)
        .filter(F.col("before") <= RESIDUE)
        .withColumn("slot", F.explode(F.array(*[slot(F.col("q_weight")) + d for d in (-1, 0, 1)])))
        .select("q_text", "term", "slot")
    )
    postings = weights.select(F.col("text_id").alias("c_text"), "term", slot(F.col("weight")).alias("slot"))
    pairs = anchors.join(postings, ["term", "slot"]).select("q_text", "c_text").distinct()
    candidate = weights.select(F.col("text_id").alias("c_text"), "term", "weight")
    return (
        pairs.join(asked.select("q_text", "term", "q_weight"), "q_text")
        .join(candidate, ["c_text", "term"])
        .groupBy("q_text", "c_text")
        .agg(_rounded(F.sum(F.col("q_weight") * F.col("weight"))))
    )


def text_matches(index: TextIndex, wanted: DataFrame | None, depth: int, pruned: bool = False) -> DataFrame:
    """(q_text, c_text, similarity) of all texts that can hold one of the first ``depth`` cases.

    ``wanted`` has the asked ``q_text`` ids, None asks for every text of the index. Pairs that
    share no term do not appear. Where few texts are asked, every task sums and cuts its own texts (``asked``). ``pruned`` is for free text, where most texts share some term with most
    others: pairs that cannot be among the nearest are left out before they are summed.
    """
    fewest, most = index.copies or (0, depth)
    if index.counts is not None:
        if wanted is not None and not pruned and fewest < depth:
            few = asked_counts(index.counts, index.idf, wanted)
            if few is not None:
                return nearest_counted(index.counts, index.lengths, few, depth)
        index = with_weights(index)
    if pruned:
        found = nearest_matches(index.weights, wanted, depth, index.lists)
        return found.select("q_text", "c_text", _rounded(F.col("total")))
    asked = index.weights.select(
        F.col("text_id").alias("q_text"), "n_rows", "term", "n_texts", F.col("weight").alias("q_weight")
    )
    n_asked = F.col("n_texts")
    if wanted is not None:
        asked = asked.join(wanted, "q_text", "left_semi")
        n_asked = wanted.agg(F.count(F.lit(1))).scalar()
    own_copies_suffice = F.col("n_rows") >= depth
    if wanted is not None and index.lists is not None and fewest < depth:
        few = asked_weights(index.lists, wanted)
        if few is not None:
            return nearest_of(index.lists, few, depth)
    if most < depth:
        return _sparse_matches(asked, index.weights, n_asked)
    identical = _identical_matches(asked.filter(own_copies_suffice), index.weights)
    if fewest >= depth:
        return identical
    others = _sparse_matches(asked.filter(~own_copies_suffice), index.weights, n_asked)
    return others.unionByName(identical)


def _nearest_texts(index: TextIndex, wanted: DataFrame | None, depth: int, pruned: bool = False) -> DataFrame:
    """(q_text, near): the ``depth`` nearest texts of each asked text, with their case counts.

    Each text ahead brings at least one case, its lowest id, that is ahead of every case of a text
    further down, so no other text can reach the pool.
    """
    sizes = index.texts.select(F.col("text_id").alias("c_text"), "n_rows", "first_dr")
    matches = text_matches(index, wanted, depth, pruned).join(sizes, "c_text")
    order = [F.desc("similarity"), F.asc("first_dr")]
    return (
        top_per_key(matches, ["q_text"], order, depth, "text_rank")
        .groupBy("q_text")
        .agg(F.collect_list(F.struct("c_text", "similarity", "n_rows")).alias("near"))
    )


def _rows_of(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + t["n_rows"])


def _lists_of_texts(index: TextIndex, wanted: DataFrame | None, depth: int, pruned: bool = False) -> DataFrame:
    """(q_text, near) of every asked text, ``near`` being null without a match."""
    asked = index.texts.select(F.col("text_id").alias("q_text")) if wanted is None else wanted
    return asked.join(_nearest_texts(index, wanted, depth, pruned), "q_text", "left")


def _reaching_texts(near: DataFrame, depth: int) -> DataFrame:
    """(q_text, c_text, similarity, room): matching texts that have cases in the pool, and at most how many."""
    nearer = lambda t: _rows_of(F.filter("near", lambda o: o["similarity"] > t["similarity"]))
    entry = lambda t: F.struct(t["c_text"].alias("c_text"), t["similarity"].alias("similarity"), (depth - nearer(t)).alias("room"))
    return near.select("q_text", F.inline(F.transform("near", entry))).filter(F.col("room") > 0)


def _fillers(near: DataFrame, cand: DataFrame, depth: int) -> DataFrame:
    """(q_text, similarity, cand): the cases without a common term that fill up a pool.

    Fewer than ``depth`` cases match then, so the ``2 * depth`` leading cases of the lowest ids hold
    enough others. They are one bounded value; each text cuts its first missing ones from it, at most
    as many as it lacks.
    """
    opening = first_rows(cand, [F.asc("cand.dr_no")], 2 * depth).agg(
        F.sort_array(F.collect_list(F.struct(F.col("cand.dr_no").alias("dr_no"), "c_text", "cand")))
    )
    left_over = depth - F.coalesce(_rows_of(F.col("near")), F.lit(0))
    known = F.coalesce(F.transform("near", lambda t: t["c_text"]), F.array().cast("array<binary>"))
    short = near.select("q_text", left_over.cast("int").alias("left_over"), known.alias("known")).filter("left_over > 0")
    others = F.filter("all", lambda c: ~F.array_contains("known", c["c_text"]))
    return (
        short.withColumn("all", opening.scalar())
        .select("q_text", F.explode(F.slice(others, F.lit(1), F.col("left_over"))).alias("c"))
        .select("q_text", F.lit(0.0).alias("similarity"), "c.cand")
    )


def candidate_pool(
    index: TextIndex, wanted: DataFrame | None, depth: int, cases: DataFrame | None = None, pruned: bool = False
) -> DataFrame:
    """(q_text, pool_rank, similarity, cand): the first ``depth`` cases for each asked text.

    The base itself counts in the pool. All cases of a text have the same pool, so it is built
    once per distinct text. A pool deeper than the index was built for takes its leading cases from
    ``cases``, by default the table the index knows.
    """
    cases = index.cases if cases is None else cases
    if index.leaders is not None and depth <= index.depth:
        leaders = index.leaders.filter(F.col("leader_rank") <= depth)
    elif cases is not None:
        leaders = leading_cases(cases, depth)
    else:
        raise ValueError(f"the index keeps {index.depth} cases per text and not their table, the pool asks for {depth}")
    wanted = wanted.select("q_text").distinct() if wanted is not None else None
    near = _lists_of_texts(index, wanted, depth, pruned)
    reaching = _reaching_texts(near, depth)
    few = wanted is not None and _few(wanted, depth)
    # Rows of few pools are drawn by id; the wide cases are taken for those drawn only, where they lie.
    columns = ["dr_no", "text_id", "leader_rank"] if few else CASE_COLUMNS
    cand = leaders.select(F.col("text_id").alias("c_text"), "leader_rank", F.struct(*columns).alias("cand"))
    matched = (
        (F.broadcast(reaching) if few else reaching)
        .join(cand, "c_text")
        .filter(F.col("leader_rank") <= F.col("room"))
        .select("q_text", "similarity", "cand")
    )
    # Where every text's own cases fill a pool, nothing is left to fill.
    filled = index.copies is not None and index.copies[0] >= depth
    rows = matched if filled else matched.unionByName(_fillers(near, cand, depth))
    order = [F.desc("similarity"), F.asc("cand.dr_no")]
    pool = top_per_key(rows, ["q_text"], order, depth, "pool_rank")
    if not few:
        return pool
    drawn = F.broadcast(pool.select("q_text", "pool_rank", "similarity", "cand.text_id", "cand.leader_rank"))
    return leaders.join(drawn, ["text_id", "leader_rank"]).select("q_text", "pool_rank", "similarity", F.struct(*CASE_COLUMNS).alias("cand"))


def _few(asked: DataFrame, depth: int) -> bool:
    """Whether the pools of the asked texts or bases have so few rows that these can be sent to all tasks."""
    return asked.limit(SENT // depth + 1).count() <= SENT // depth


def _equals(column: Column, value: str, null_name: str | None) -> Column:
    return column.isNull() if null_name is not None and value == null_name else column == value


def similar_lists(
    index: TextIndex,
    bases: DataFrame,
    k: int = 20,
    area: str | None = None,
    weapon: str | None = None,
    weapon_null_name: str | None = None,
    cases: DataFrame | None = None,
    bases_are_all: bool = False,
    how: str = "inner",
    pruned: bool = False,
) -> DataFrame:
    """(base, hits): for each base its up to ``k`` candidates (pool_rank, similarity, cand) in order.

    The pool is cut first; the base itself, other areas and other weapons are dropped from it
    afterwards, so a filtered list can be shorter than ``k``. ``None``, ``""`` and ``"All"`` do not
    filter. ``weapon_null_name`` lets one filter value stand for a missing weapon.

    Lists are ordered once per text and are at most one pool long. A base takes its text's list,
    leaves itself out and cuts it, which needs no further shuffle or sort per base.
    ``bases_are_all`` saves the pass that finds the texts of the bases when they are the whole table.
    ``how="left"`` keeps bases without candidates, ``hits`` being null. ``pruned``: see ``text_matches``.
    """
    keyed, lists = _keyed_and_lists(index, bases, k, area, weapon, weapon_null_name, cases, bases_are_all, pruned)
    if not bases_are_all and _few(keyed.select("q_id"), k + 1):
        # Lists are grouped by text already and few bases need no lanes, so the lists stay where they are.
        joined = keyed.join(lists, "q_text", how)
    else:
        heavy = heavy_keys(index.texts, "text_id", "n_rows").withColumnRenamed("text_id", "q_text")
        joined = spread_join(keyed, lists, "q_text", heavy, "q_id", how)
    return joined.select("base", _others(k).alias("hits"))


def _others(k: int) -> Column:
    """The first ``k`` of a text's list without the base itself."""
    return F.slice(F.filter("listed", lambda hit: hit["cand"]["dr_no"] != F.col("q_id")), 1, k)


def _keyed_and_lists(
    index: TextIndex,
    bases: DataFrame,
    k: int,
    area: str | None = None,
    weapon: str | None = None,
    weapon_null_name: str | None = None,
    cases: DataFrame | None = None,
    bases_are_all: bool = False,
    pruned: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(q_text, q_id, base) of the bases and (q_text, listed) of their texts."""
    filtered = area not in WILDCARDS or weapon not in WILDCARDS
    # Without filters only the first k rows other than the base can be returned.
    depth = pool_size(k) if filtered else k + 1
    keyed = bases.select(
        text_id("mo_text").alias("q_text"), F.col("dr_no").alias("q_id"), F.struct(*CASE_COLUMNS).alias("base")
    )
    pool = candidate_pool(index, None if bases_are_all else keyed.select("q_text"), depth, cases, pruned)
    if area not in WILDCARDS:
        pool = pool.filter(F.col("cand.area_name") == area)
    if weapon not in WILDCARDS:
        pool = pool.filter(_equals(F.col("cand.weapon_desc"), weapon, weapon_null_name))
    ordered = F.sort_array(F.collect_list(F.struct("pool_rank", "similarity", "cand")))
    # One more than k: the base may be on its own list.
    lists = pool.groupBy("q_text").agg(F.slice(ordered, 1, k + 1).alias("listed"))
    return keyed, lists


def dealt_cases(index: TextIndex, bases: DataFrame, k: int, per_task: int) -> DataFrame | None:
    """(q_id, base, rank, similarity, cand) as ``similar_cases`` of all cases, the rows of one id in one task; None if all lists exceed LISTED.

    Bases are dealt by their id alone, about ``per_task`` to a task, and the lists of the few texts are sent to them:
    no pair is shuffled, and a window by ``q_id`` needs no exchange.
    """
    longest = F.coalesce(F.max(F.octet_length("mo_text")), F.lit(0))
    size = index.texts.agg(F.count(F.lit(1)).alias("texts"), longest.alias("longest"), F.sum("n_rows").alias("cases")).first()
    if size["texts"] * (k + 1) * (size["longest"] + CASE_BYTES) > LISTED:
        return None
    keyed, lists = _keyed_and_lists(index, bases, k, bases_are_all=True)
    tasks = math.ceil((size["cases"] or 0) / per_task)
    dealt = keyed.repartition(max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks), "q_id")
    return (
        dealt.join(F.broadcast(lists), "q_text")
        .select("q_id", "base", F.posexplode(_others(k)).alias("pos", "hit"))
        .select("q_id", "base", (F.col("pos") + 1).alias("rank"), "hit.similarity", "hit.cand")
    )


def similar_within(
    index: TextIndex, bases: DataFrame, k: int, field: str, value: str | None, path: str | None = None, bases_are_all: bool = False
) -> DataFrame:
    """(base, rank, similarity, cand): the ``k`` nearest of the cases whose ``field`` is ``value``, the base left out.

    Unlike the area and weapon filters of ``similar_cases``, which act on a pool that is already cut, the cases
    are chosen first, so a list is only shorter than ``k`` if fewer such cases exist. ``path`` keeps the table of
    leading cases by ``field`` for the next call.
    """
    part = within(index, field, value, path)
    depth = k + 1
    keyed = bases.select(text_id("mo_text").alias("q_text"), F.col("dr_no").alias("q_id"), F.struct(*CASE_COLUMNS).alias("base"))
    wanted = None if bases_are_all else keyed.select("q_text").distinct()
    asked = index.texts.select(F.col("text_id").alias("q_text")) if wanted is None else wanted
    cand_leaders = part.leaders if depth <= part.depth else leading_cases(part.cases, depth)
    cand = cand_leaders.select(F.col("text_id").alias("c_text"), "leader_rank", F.struct(*CASE_COLUMNS).alias("cand"))
    terms = index.weights.select(F.col("text_id").alias("q_text"), "term", "n_texts", F.col("weight").alias("q_weight"))
    if wanted is not None:
        terms = terms.join(wanted, "q_text", "left_semi")
    sizes = part.texts.select(F.col("text_id").alias("c_text"), "n_rows", "first_dr")
    matches = _sparse_matches(terms, part.weights, F.col("n_texts")).join(sizes, "c_text")
    near = (
        top_per_key(matches, ["q_text"], [F.desc("similarity"), F.asc("first_dr")], depth, "text_rank")
        .groupBy("q_text")
        .agg(F.collect_list(F.struct("c_text", "similarity", "n_rows")).alias("near"))
    )
    near = asked.join(near, "q_text", "left")
    matched = _reaching_texts(near, depth).join(cand, "c_text").filter(F.col("leader_rank") <= F.col("room"))
    rows = matched.select("q_text", "similarity", "cand").unionByName(_fillers(near, cand, depth))
    pool = top_per_key(rows, ["q_text"], [F.desc("similarity"), F.asc("cand.dr_no")], depth, "pool_rank")
    ordered = F.sort_array(F.collect_list(F.struct("pool_rank", "similarity", "cand")))
    lists = pool.groupBy("q_text").agg(ordered.alias("listed"))
    heavy = heavy_keys(index.texts, "text_id", "n_rows").withColumnRenamed("text_id", "q_text")
    others = F.filter("listed", lambda hit: hit["cand"]["dr_no"] != F.col("q_id"))
    return (
        spread_join(keyed, lists, "q_text", heavy, "q_id")
        .select("base", F.posexplode(F.slice(others, 1, k)).alias("pos", "hit"))
        .select("base", (F.col("pos") + 1).alias("rank"), "hit.similarity", "hit.cand")
    )


def similar_cases(index: TextIndex, bases: DataFrame, k: int = 20, **options) -> DataFrame:
    """(base, rank, similarity, cand): one row per base and candidate; options as ``similar_lists``."""
    return (
        similar_lists(index, bases, k, **options)
        .select("base", F.posexplode("hits").alias("pos", "hit"))
        .select("base", (F.col("pos") + 1).alias("rank"), "hit.similarity", "hit.cand")
    )


def cosine_to_all(index: TextIndex, base: DataFrame, cases: DataFrame) -> DataFrame:
    """(q_id, dr_no, similarity): each base against every case, 0 without a common term.

    The result has one row per base and case; meant for one base or a handful.
    """
    keyed = base.select(F.col("dr_no").alias("q_id"), text_id("mo_text").alias("q_text"))
    asked = index.weights.select(
        F.col("text_id").alias("q_text"), "term", "n_texts", F.col("weight").alias("q_weight")
    ).join(keyed, "q_text", "left_semi")
    matches = _sparse_matches(asked, index.weights, keyed.agg(F.count(F.lit(1))).scalar())
    by_text = matches.join(keyed, "q_text").groupBy("c_text").agg(
        F.map_from_entries(F.collect_list(F.struct("q_id", "similarity"))).alias("by_base")
    )
    heavy = heavy_keys(index.texts, "text_id", "n_rows").withColumnRenamed("text_id", "c_text")
    ids = keyed.agg(F.collect_list("q_id")).scalar()
    rows = cases.select("dr_no", text_id("mo_text").alias("c_text"))
    return spread_join(rows, by_text, "c_text", heavy, "dr_no", "left").select(
        F.explode(ids).alias("q_id"), "dr_no", "by_base"
    ).select("q_id", "dr_no", F.coalesce(F.col("by_base")[F.col("q_id")], F.lit(0.0)).alias("similarity"))


def as_served(ranked: DataFrame) -> DataFrame:
    """Flat rows of a similar-cases result, dates as text."""
    return ranked.select(
        F.col("base.dr_no").alias("q_id"),
        "rank",
        "cand.dr_no",
        F.date_format("cand.datetime", "yyyy-MM-dd").alias("datetime"),
        "cand.area_name",
        "cand.crm_cd_desc",
        "cand.weapon_desc",
        "cand.vict_age",
        "cand.vict_sex",
        "similarity",
        "cand.mo_text",
    )
