"""Mixing sources to target weights by Sainte-Laguë apportionment; column expressions only.

A document's size is its number of words. Sources share all words by fixed weights that repeat in the order of
the sources. A target stops at ``CAP`` times its source's size; the excess goes to the others by weight until
no target is above. With sources in the order of size over weight, the stopped ones come first, so running
totals find them in one pass.

The words of a source, its documents in seeded order, are one stream that is cut into blocks of ``BLOCK``
words. A stopped source gives all its blocks ``CAP`` times. The blocks of the rest, as many as their targets
hold together, are allotted by Sainte-Laguë: always to the highest of the quotients weight / (2 k + 1), k being
the blocks a source has. Which quotients win is certain but for a few about the divisor, and only these are
ranked. A source's blocks lie in at most ``SHARDS`` shards of equal length, to which its quota is apportioned in
the same way; within a shard the quota is as many whole passes as fit, and the rest are blocks at even steps
from a seeded place. A document gives the words that it has in the chosen blocks, once for each time.

Documents are dealt by source and ``LANES`` ranges of their seeded digests, which splits a source of any size;
each lane's place in its source's stream is a running total of at most ``LANES`` rows. Texts are read once; only
ids, sources, sizes and digests are shuffled.

Edge cases: null and empty texts have size 0 and give nothing; a null source is a source, the last one; rows
that repeat an id or a text are documents of their own; rows equal in id, text and source are interchangeable;
sources without words have target 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.llm.common import run_folder, stored
from caselink.llm.order import numbered, running_totals

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 16
SHARDS = 1024
SEED = 13
# Digits of the digest that name a lane.
LANE_DIGITS = 3
LANES = 16**LANE_DIGITS


def n_words(text: Column) -> Column:
    """Runs of characters other than blank and U+0009-U+000D; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, key (of the source; never null), source, size, draw (seeded digest of id and text)."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("key"),
        source.alias("source"),
        n_words(F.col("text").cast("string")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), told("doc_id"), F.lit(":"), F.md5(told("text")))).alias("draw"),
    )


def targets(sizes: DataFrame, folder: str, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """key, number, source_size, weight, stopped, target, to_share, open_weight, n_open; one row a source.

    ``to_share``, ``open_weight`` and ``n_open`` are words, weight and number of the sources that are not stopped.
    """
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    ordered = numbered(sources, [F.col("source").isNull(), F.col("source")], folder, "sources")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ordered.withColumn("weight", F.get(cycle, F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int")).cast("long"))
    weighed = weighed.withColumn("most", F.col("source_size") * cap)
    filled = running_totals(weighed, [F.col("most") / F.col("weight"), F.col("number")], {"filled": "most", "spent": "weight"}, folder, "filled")
    everything = filled.agg(F.sum("source_size")).scalar()
    all_weight = filled.agg(F.sum("weight")).scalar()
    exact = lambda c: c.cast("decimal(38,0)")
    stopped = exact(everything - F.col("filled")) * exact(F.col("weight")) >= exact(F.col("most")) * exact(all_weight - F.col("spent"))
    flagged = stored(filled.withColumn("stopped", stopped), folder, "flagged")
    is_open = ~F.col("stopped")
    open_sum = lambda c: F.coalesce(F.sum(F.when(is_open, F.col(c))), F.lit(0)).cast("long")
    to_share = flagged.agg(F.sum("source_size") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("most"))), F.lit(0))).scalar()
    shared = F.col("weight") * F.col("to_share") / F.col("open_weight")
    return (
        flagged.withColumns({"to_share": to_share, "open_weight": flagged.agg(open_sum("weight")).scalar(), "n_open": flagged.agg(F.count(F.when(is_open, 1))).scalar()})
        .withColumn("target", F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(shared))
        .select("key", "number", "source_size", "weight", "stopped", "target", "to_share", "open_weight", "n_open")
    )


def _sure(votes: Column, all_votes: Column, parties: Column, seats: Column) -> Column:
    """Seats that a party is sure of: those under a divisor at which all parties together have no more than ``seats``."""
    return F.greatest(F.floor(votes * (seats - parties / 2) / all_votes) - 1, F.lit(0)).cast("long")


def _contested(votes: Column, all_votes: Column, parties: Column, seats: Column) -> Column:
    """Numbers of the seats that a party may get beyond the sure ones; about five a party."""
    last = F.floor(votes * (seats + parties / 2) / all_votes) + 1
    return F.sequence(_sure(votes, all_votes, parties, seats), last.cast("long"))


def source_quotas(sources: DataFrame, folder: str, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """``sources`` with ``n_blocks`` and ``quota``, the blocks that the mix takes of each."""
    cut = stored(sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long")), folder, "cut")
    open_ones = cut.filter(~F.col("stopped"))
    seats = F.floor((2 * F.col("to_share") + block) / (2 * block)).cast("long")
    by = (F.col("weight"), F.col("open_weight"), F.col("n_open"), seats)
    sure = open_ones.select("number", _sure(*by).alias("sure"))
    asked = open_ones.select("number", "weight", F.explode(_contested(*by)).alias("k"))
    ranked = numbered(
        asked.withColumn("quotient", F.col("weight") / (2 * F.col("k") + 1)), [F.desc("quotient"), F.asc("number")], folder, "quotients", "place"
    )
    left = open_ones.agg(F.max(seats) - F.sum(_sure(*by))).scalar()
    won = ranked.filter(F.col("place") <= left).groupBy("number").agg(F.count(F.lit(1)).alias("won"))
    allotted = sure.join(won, "number", "left").select("number", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("allotted"))
    most = F.col("n_blocks") * cap
    return (
        cut.join(allotted, "number", "left")
        .withColumn("quota", F.when(F.col("stopped"), most).otherwise(F.least("allotted", most)))
        .drop("allotted")
    )


def shard_quotas(sources: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``sources`` with ``length``, the blocks of a shard, and ``quotas``, (seats, step) of each of at most ``shards`` shards.

    ``step`` is the seeded place from which a shard's blocks are chosen.

    A source has one row a shard and about five a contested seat here, so its group is bounded.
    """
    lengths = sources.withColumn("length", F.greatest(F.ceil(F.col("n_blocks") / shards), F.lit(1)).cast("long"))
    counted = lengths.withColumn("n_shards", F.ceil(F.col("n_blocks") / F.col("length")).cast("long"))
    each = counted.filter("n_blocks > 0").select(
        "key", "quota", "n_blocks", "n_shards", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1)).alias("shard")
    )
    held = each.withColumn("held", F.least("length", F.col("n_blocks") - F.col("shard") * F.col("length")))
    by = (F.col("held"), F.col("n_blocks"), F.col("n_shards"), F.col("quota"))
    seats = held.withColumn("sure", _sure(*by)).withColumn("k", F.explode(_contested(*by)))
    first_row = F.col("k") == F.col("sure")
    within = W.partitionBy("key").orderBy(F.desc(F.col("held") / (2 * F.col("k") + 1)), F.asc("shard"))
    left = F.col("quota") - F.sum(F.when(first_row, F.col("sure")).otherwise(F.lit(0))).over(W.partitionBy("key"))
    won = seats.withColumn("left", left).withColumn("place", F.row_number().over(within))
    per_shard = won.groupBy("key", "shard").agg((F.max("sure") + F.count(F.when(F.col("place") <= F.col("left"), 1))).alias("seats"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"), F.lit(":"), F.col("shard").cast("string")))
    stepped = per_shard.withColumn("step", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
    quotas = stepped.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "seats", "step"))).alias("quotas"))
    return lengths.join(quotas, "key", "left")


def _taken(block: int) -> Column:
    """Words that the mix takes of the ``size`` words from ``start`` on in the stream of ``key``."""
    end = F.col("start") + F.col("size")

    def of_block(b: Column) -> Column:
        shard = F.floor(b / F.col("length"))
        held = F.least(F.col("length"), F.col("n_blocks") - shard * F.col("length"))
        quota = F.get(F.col("quotas"), (shard - F.col("first_shard")).cast("int"))
        passes = F.floor(quota["seats"] / held)
        rest = quota["seats"] - passes * held
        place = F.pmod(b - shard * F.col("length") + F.pmod(quota["step"], held), held)
        chosen = F.pmod(place * rest, held) < rest
        words = F.least((b + 1) * block, end) - F.greatest(b * block, F.col("start"))
        return words * (passes + chosen.cast("long"))

    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    total = F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: (n + of_block(b)).cast("long"))
    return F.when(F.col("size") > 0, total).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target (of its source), taken: words of each document that the mix takes."""
    folder = run_folder(docs.sparkSession, "mixing")
    sizes = stored(sized(docs, seed), folder, "sizes")
    quotas = shard_quotas(source_quotas(targets(sizes, folder, weights, cap), folder, block, cap), seed=seed)
    lane = F.substring("draw", 1, LANE_DIGITS)
    laid = sizes.withColumn("lane", lane)
    before = lambda *order: W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    lanes = laid.groupBy("key", "lane").agg(F.sum("size").alias("lane_size"))
    lanes = lanes.withColumn("lane_start", so_far("lane_size", before("lane").partitionBy("key"))).join(quotas, "key")
    shard_of = lambda word: F.floor(F.floor(word / block) / F.col("length"))
    # A lane carries the quotas of the shards that it touches, no others.
    first, last = shard_of(F.col("lane_start")), shard_of(F.greatest(F.col("lane_start") + F.col("lane_size") - 1, F.col("lane_start")))
    lanes = lanes.withColumn("first_shard", first.cast("long")).select(
        "key", "lane", "lane_start", "source_size", "target", "n_blocks", "length", "first_shard",
        F.slice("quotas", (F.col("first_shard") + 1).cast("int"), (last - F.col("first_shard") + 1).cast("int")).alias("quotas"),
    )
    placed = laid.withColumn("within", so_far("size", before("draw", "doc_id", "size").partitionBy("key", "lane")))
    return (
        placed.join(lanes, ["key", "lane"])
        .withColumn("start", F.col("lane_start") + F.col("within"))
        .select("doc_id", "source", "size", "source_size", "target", _taken(block).alias("taken"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
    md5('13:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents
), sources AS (
  SELECT key, source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM docs GROUP BY key, source
), weighed AS (
  SELECT *, [5, 2, 1][(number - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM sources
), filled AS (
  SELECT *, coalesce(sum(most) OVER o, 0)::BIGINT AS filled, coalesce(sum(weight) OVER o, 0)::BIGINT AS spent FROM weighed
  WINDOW o AS (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, (sum(source_size) OVER () - filled)::HUGEINT * weight >= most::HUGEINT * (sum(weight) OVER () - spent) AS stopped FROM filled
), totals AS (
  SELECT (sum(source_size) - coalesce(sum(most) FILTER (stopped), 0))::BIGINT AS to_share, coalesce(sum(weight) FILTER (NOT stopped), 0)::BIGINT AS open_weight FROM flagged
), aimed AS (
  SELECT *, CASE WHEN stopped THEN most::DOUBLE ELSE weight * to_share / open_weight END AS target, (source_size + 15) // 16 AS n_blocks FROM flagged, totals
), quotients AS (
  SELECT number, row_number() OVER (ORDER BY weight / (2 * k + 1) DESC, number) AS place, to_share
  FROM (SELECT *, unnest(range((2 * to_share + 16) // 32)) AS k FROM aimed WHERE NOT stopped)
), allotted AS (
  SELECT number, count(*) AS n FROM quotients WHERE place <= (2 * to_share + 16) // 32 GROUP BY number
), quotas AS (
  SELECT a.*, CASE WHEN stopped THEN 3 * n_blocks ELSE least(coalesce(n, 0), 3 * n_blocks) END AS quota, greatest((n_blocks + 1023) // 1024, 1) AS length
  FROM aimed a LEFT JOIN allotted USING (number)
), shards AS (
  SELECT *, least(length, n_blocks - shard * length) AS held FROM (SELECT *, unnest(range((n_blocks + length - 1) // length)) AS shard FROM quotas)
), seats AS (
  SELECT key, shard, row_number() OVER (PARTITION BY key ORDER BY held / (2 * k + 1) DESC, shard) <= quota AS won
  FROM (SELECT *, unnest(range(3 * held + 1)) AS k FROM shards)
), shard_quotas AS (
  SELECT s.*, n, n // held AS passes, n % held AS rest, ('0x' || substr(md5('13:' || key || ':' || shard), 1, 8))::BIGINT % held AS step
  FROM shards s JOIN (SELECT key, shard, count(*) FILTER (won) AS n FROM seats GROUP BY key, shard) USING (key, shard)
), blocks AS (
  SELECT key, shard * length + place AS block, passes + CAST(((place + step) % held) * rest % held < rest AS BIGINT) AS times
  FROM (SELECT *, unnest(range(held)) AS place FROM shard_quotas)
), laid AS (
  SELECT *, (sum(size) OVER (PARTITION BY key ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM docs
), parts AS (
  SELECT rid, key, block, least(16 * (block + 1), start + size) - greatest(16 * block, start) AS words
  FROM (SELECT *, unnest(range(start // 16, (start + size - 1) // 16 + 1)) AS block FROM laid WHERE size > 0)
), given AS (
  SELECT rid, sum(words * times)::BIGINT AS taken FROM parts JOIN blocks USING (key, block) GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM laid JOIN aimed USING (key) LEFT JOIN given USING (rid)
"""
