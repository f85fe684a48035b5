"""Raw export -> clean case table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselink.schema import CASE_COLUMNS, CASE_SCHEMA
from caselink.sources.cases import read_raw_cases, with_case_types, write_cases
from caselink.sources.scratch import shared_folder, write_table

# Tried in this order; the first that fits wins. One-letter fields take one digit or two.
DATE_FORMATS = (
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy[ H:mm[:ss]]",
    "yyyy-MM-dd[ HH:mm[:ss[.SSSSSS][.SSS]]]",
    "yyyy-MM-dd'T'HH:mm[:ss[.SSSSSS][.SSS]]",
    "yyyy/M/d[ H:mm[:ss]]",
)

# What a null column contributes to ``mo_text``.
NULL_TOKEN = "nan"

# Why a raw row is not in the case table.
NO_DATE, UNREADABLE_DATE, REPEATED_ID = "no date", "unreadable date", "repeated id"
# Rows of one time that a single task may put in order when the latest cases are cut.
ORDERED_ROWS = 10_000


def lenient_timestamp(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to TIMESTAMP_NTZ, null if no format fits."""
    tries = [F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def parse_dates(
    df: DataFrame, column: str = "date_occ", keep_time: bool = False, formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Add ``datetime`` and keep the rows that have one; cut to the day unless ``keep_time``."""
    parsed = lenient_timestamp(F.col(column), formats)
    if not keep_time:
        parsed = F.to_date(parsed).cast("timestamp_ntz")
    return df.withColumn("datetime", parsed).filter(F.col("datetime").isNotNull())


def build_mo_text(df: DataFrame, null_token: str = NULL_TOKEN) -> DataFrame:
    """Add ``mo_text``: crime, weapon and area in lower case.

    A table without a weapon column repeats the crime. A null part is written as ``null_token``.
    """
    weapon = "weapon_desc" if "weapon_desc" in df.columns else "crm_cd_desc"
    part = lambda c: F.coalesce(F.lower(F.col(c).cast("string")), F.lit(null_token))
    return df.withColumn("mo_text", F.concat_ws(" ", part("crm_cd_desc"), part(weapon), part("area_name")))


def replace_sentinel(df: DataFrame, sentinel: str = "nan", value: str = "unknown") -> DataFrame:
    """Replace text cells that equal ``sentinel`` as a whole."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.replace(sentinel, value, subset=names) if names else df


def clean_cases(df: DataFrame) -> DataFrame:
    """Case columns that are present, in their fixed order, with sentinels replaced."""
    return replace_sentinel(df.select(*[c for c in CASE_COLUMNS if c in df.columns]))


def deduplicated_cases(cases: DataFrame) -> DataFrame:
    """One row per ``dr_no``: the latest, then the one with the greatest other values, nulls being least.

    Rows without an id are not known to be repeats, so all of them stay.
    """
    rest = [c for c in cases.columns if c != "dr_no"]
    rest = [c for c in rest if c == "datetime"] + [c for c in rest if c != "datetime"]
    one = cases.filter(F.col("dr_no").isNotNull()).groupBy("dr_no").agg(F.max(F.struct(*rest)).alias("row"))
    return one.select("dr_no", "row.*").select(*cases.columns).unionByName(cases.filter(F.col("dr_no").isNull()))


def dropped_rows(raw: DataFrame, column: str = "date_occ") -> DataFrame:
    """(reason, rows): how many raw rows do not reach the case table, and why.

    Ids are compared as the case table types them; a row whose id is missing or no whole number is no repeat.
    """
    text = F.trim(F.col(column))
    reason = F.when(F.coalesce(text, F.lit("")) == "", F.lit(NO_DATE)).when(
        lenient_timestamp(F.col(column)).isNull(), F.lit(UNREADABLE_DATE)
    )
    typed_id = F.col("dr_no").try_cast(CASE_SCHEMA["dr_no"].dataType)
    per_id = raw.select(typed_id.alias("dr_no"), reason.alias("reason")).groupBy("dr_no", "reason").agg(F.count(F.lit(1)).alias("n"))
    repeated = F.when(F.col("reason").isNull(), F.lit(REPEATED_ID)).otherwise(F.col("reason"))
    left_out = (
        F.when(F.col("reason").isNotNull(), F.col("n")).when(F.col("dr_no").isNull(), F.lit(0)).otherwise(F.col("n") - 1)
    )
    return (
        per_id.select(repeated.alias("reason"), left_out.alias("n"))
        .groupBy("reason")
        .agg(F.sum("n").alias("rows"))
        .filter("rows > 0")
    )


def recent_cases(cases: DataFrame, n: int | None = None) -> DataFrame:
    """The ``n`` latest rows, ids ascending within one time; all rows if ``n`` is None.

    A sort with a large limit hands every split's first ``n`` rows to one task. Here counts per day,
    then per time of the last day, then per range of ids of the last time find the last row to keep,
    and the wide rows are filtered where they lie; each step is one number for the next. Rows without
    a date count as the oldest, rows without an id as the last of their time; rows that share time and
    id, or have none, stay or go together. ``cases`` is read several times: give a stored table.
    """
    if n is None:
        return cases
    if n <= 0:
        return cases.limit(0)
    time = F.coalesce("datetime", F.lit("0001-01-01").cast("timestamp_ntz"))
    keys = cases.select(time.alias("time"), F.to_date(time).alias("day"), "dr_no")
    day = _edge(keys, "day", n)
    if day is None:
        return cases
    keys = keys.filter(F.col("day") == F.lit(day[0].isoformat()).cast("date"))
    last_time, needed = _edge(keys, "time", n - day[1])
    needed = n - day[1] - needed
    last = F.lit(last_time.isoformat(sep=" ")).cast("timestamp_ntz")
    last_id = _last_id(keys.filter(F.col("time") == last).select("dr_no"), needed)
    kept = F.lit(True) if last_id is None else F.col("dr_no") <= last_id
    return cases.filter((time > last) | ((time == last) & kept))


def _edge(keys: DataFrame, column: str, n: int):
    """The value of ``column``, counted from the greatest, that row ``n`` has, and the rows before it; None if there is none."""
    counts = keys.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    newer = F.sum("rows").over(W.orderBy(F.desc(column))) - F.col("rows")
    found = counts.withColumn("newer", newer).filter((F.col("newer") < n) & (F.col("newer") + F.col("rows") >= n))
    row = found.select(column, "newer").first()
    return None if row is None else (row[0], row[1])


def _last_id(ids: DataFrame, n: int) -> int | None:
    """The ``n``-th id in ascending order, by counts of ever narrower ranges of ids; None if rows without an id are needed too."""
    ids = ids.filter(F.col("dr_no").isNotNull())
    while True:
        low, high, rows = ids.agg(F.min("dr_no"), F.max("dr_no"), F.count(F.lit(1))).first()
        if n > rows:
            return None
        if low == high or rows <= ORDERED_ROWS:
            return ids.orderBy("dr_no").limit(n).agg(F.max("dr_no")).first()[0]
        width = (high - low) // 1000 + 1
        part = F.floor((F.col("dr_no") - F.lit(low)) / F.lit(width)).cast("long")
        counted = ids.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
        before = 0
        for r in counted:
            if before + r["rows"] >= n:
                break
            before += r["rows"]
        first = low + r["part"] * width
        ids, n = ids.filter((F.col("dr_no") >= first) & (F.col("dr_no") < first + width)), n - before


def prepare_cases(
    raw: DataFrame, n: int | None = None, keep_time: bool = False, null_token: str = NULL_TOKEN
) -> DataFrame:
    """Normalised raw columns -> typed clean case table, one row per id and all rows without one.

    With ``n`` the typed table is stored once, since finding the latest rows reads it several times.
    """
    dated = parse_dates(raw, keep_time=keep_time)
    typed = deduplicated_cases(with_case_types(clean_cases(build_mo_text(dated, null_token))))
    if n is None:
        return typed
    return recent_cases(write_table(typed, shared_folder(raw.sparkSession, "typed", uuid.uuid4().hex)), n)


def preprocess_cases(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    n: int | None = None,
    keep_time: bool = False,
    output_format: str = "parquet",
) -> None:
    """Raw CSV folder or file -> clean case table on disk."""
    write_cases(prepare_cases(read_raw_cases(spark, input_path), n, keep_time), output_path, output_format)
