"""Top-n and join forms that keep a hot key off a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key is heavy when it holds more than 1/PARTS of the rows; at most PARTS keys can.
PARTS = 1000


def _lane(lanes: int) -> Column:
    """Lane of a row: all rows of one split share it, so a limit before the shuffle keeps its grip.

    Dealing single rows instead would let every split send ``n`` rows to each lane. Which lane a
    row takes does not change the result.
    """
    return F.pmod(F.spark_partition_id(), F.lit(lanes))


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str,
    lanes: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of every key by ``order``, numbered in ``rank``.

    ``lanes`` is for keys that may be hot in a table with many splits: a key is first cut to ``n``
    rows in each of ``lanes`` groups of splits, so the group that decides the final ranks has at
    most ``lanes * n`` rows. Both levels are limited before their shuffle as well.
    """
    if lanes is not None:
        within = W.partitionBy(*keys, "_lane").orderBy(*order)
        df = df.withColumn("_lane", _lane(lanes)).withColumn("_n", F.row_number().over(within))
        df = df.filter(F.col("_n") <= n).drop("_n", "_lane")
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(
        F.col(rank) <= n
    )


def first_rows(df: DataFrame, order: Sequence[Column], n: int, levels: Sequence[int] = (PARTS,)) -> DataFrame:
    """``orderBy(order).limit(n)`` for tables with many splits.

    A plain limit sends ``n`` rows of every split to one task. Here the rows are cut to ``n`` in
    each of ``levels`` lanes first, so the last task sees ``levels[-1] * n`` rows. Spark limits rows
    before the shuffle only up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default):
    meant for small ``n``.
    """
    for lanes in levels:
        within = W.partitionBy("_lane").orderBy(*order)
        df = df.withColumn("_lane", _lane(lanes)).withColumn("_n", F.row_number().over(within))
        df = df.filter(F.col("_n") <= n).drop("_n", "_lane")
    return df.orderBy(*order).limit(n)


def heavy_keys(counts: DataFrame, key: str, size: str) -> DataFrame:
    """(key, lanes) of the keys that hold more than 1/PARTS of all rows: at most PARTS rows.

    ``counts`` has one row per key, ``size`` says how many rows the key has. ``lanes`` is the
    number of tasks the key deserves.
    """
    total = counts.agg(F.sum(size)).scalar()
    share = F.col(size) * F.lit(PARTS) / total
    return counts.filter(share >= 1).select(key, F.ceil(share).cast("int").alias("_lanes"))


def spread_join(
    left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, spread_on: str, how: str = "inner"
) -> DataFrame:
    """Join a large ``left`` with a ``right`` that has few rows per key.

    Rows of a heavy key are dealt over several lanes and the right side is repeated per lane. Only
    ``heavy`` is broadcast; its size is bounded by ``heavy_keys``.
    """
    small = F.broadcast(heavy)
    lane = lambda n: F.pmod(F.xxhash64(spread_on), n)
    # Rows without a key find nothing; they are dealt as well, for joins that keep them.
    dealt = F.when(F.col("_lanes").isNotNull(), lane(F.col("_lanes"))).when(F.col(key).isNull(), lane(F.lit(PARTS))).otherwise(F.lit(0))
    repeated = F.explode(F.sequence(F.lit(0), F.coalesce("_lanes", F.lit(1)) - 1))
    left = left.join(small, key, "left").withColumn("_lane", dealt.cast("int")).drop("_lanes")
    right = right.join(small, key, "left").withColumn("_lane", repeated).drop("_lanes")
    return left.join(right, [key, "_lane"], how).drop("_lane")
