"""Global order as column expressions: row numbers and running totals without one task that sees all rows.

Rows are dealt by ranges of the order and sorted within each partition. A row's ``_at`` joins its partition's
number and its place there, so it ascends with the order; what lies before a partition is a running total over
one row a partition, which is all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.llm.common import stored

# monotonically_increasing_id keeps the place within the partition in its low 33 bits.
_PLACE_BITS = 33


def in_order(df: DataFrame, order: Sequence[Column], folder: str, name: str) -> DataFrame:
    """``df`` with ``_at``, which ascends with ``order``; written once, so that places and partitions stay."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("_at", F.monotonically_increasing_id()), folder, name)


def _part() -> Column:
    return F.shiftright("_at", _PLACE_BITS)


def _before(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """One row a partition: ``totals`` over all partitions before it."""
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per_part = rows.groupBy(_part().alias("_part")).agg(*[c.alias(n) for n, c in totals.items()])
    return per_part.select("_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals])


def numbered(df: DataFrame, order: Sequence[Column], folder: str, name: str, number: str = "number") -> DataFrame:
    """``df`` with its row number by ``order``, from 1; rows that tie throughout are numbered in any order."""
    rows = in_order(df, order, folder, name)
    before = F.broadcast(_before(rows, {"_rows": F.count(F.lit(1))}))
    place = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return (
        rows.withColumn("_part", _part())
        .join(before, "_part")
        .withColumn(number, place + 1 + F.col("_rows"))
        .drop("_part", "_rows", "_at")
    )


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, str], folder: str, name: str) -> DataFrame:
    """``df`` with each ``totals[n]`` summed over all rows before this one by ``order``, as ``n``."""
    rows = in_order(df, order, folder, name)
    before = F.broadcast(_before(rows, {f"_{n}": F.sum(c) for n, c in totals.items()}))
    within = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("_part", _part()).select(
        "*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in totals.items()]
    )
    return summed.join(before, "_part").withColumns({n: F.col(n) + F.col(f"_{n}") for n in totals}).drop(
        "_part", "_at", *[f"_{n}" for n in totals]
    )
