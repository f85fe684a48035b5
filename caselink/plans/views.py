"""Case tables derived from the driver's star schema, event and document tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.functions.text import text_key
from caselink.operators.prepare import NULL_TOKEN
from caselink.sources.cases import normalize_headers
from caselink.sources.scratch import shared_folder

# Headers of the raw export as a publisher would spell them, with columns that get dropped.
RAW_HEADERS = [
    "DR_NO",
    " Date Rptd.",
    "DATE OCC",
    "AREA NAME",
    "Crm Cd",
    "Crm Cd Desc",
    "Weapon Desc",
    "Vict Age",
    "Vict Sex",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("weapon", F.expr("nullif(c_mktsegment, 'FURNITURE')"))
        .withColumn("crime", F.expr("substr(o_orderpriority, 3)"))
        .withColumn("age", F.floor(F.col("c_acctbal") / 100).cast("int"))
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per order; nulls in weapon, sex, age and crime code."""
    weak = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000)
    return _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("dr_no"),
        F.col("o_orderdate").alias("datetime"),
        F.col("n_name").alias("area_name"),
        F.when(~weak, F.expr("cast(substr(o_orderpriority, 1, 1) as int)")).alias("crm_cd"),
        F.col("crime").alias("crm_cd_desc"),
        F.col("weapon").alias("weapon_desc"),
        F.when(F.col("age") >= -5, F.col("age")).alias("vict_age"),
        F.when(F.col("o_totalprice") <= 450000, F.col("o_orderstatus")).alias("vict_sex"),
        F.concat_ws(
            " ",
            F.lower("crime"),
            F.coalesce(F.lower("weapon"), F.lit(NULL_TOKEN)),
            F.lower("n_name"),
        ).alias("mo_text"),
    )


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders as an untyped export: dates in many spellings, some blank or no dates at all.

    Some ages are spelled with a decimal, and every hundredth order comes a second time without its weapon.
    """
    spelled = [
        F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00.000"),
        F.date_format("o_orderdate", "yyyy-MM-dd 10:00:00.123"),
        F.date_format("o_orderdate", "M/d/yyyy"),
        F.date_format("o_orderdate", "yyyy/MM/dd"),
        F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 9:30:00 AM")),
    ]
    other = F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 01:30:00 PM"))
    date = (
        F.when(F.col("o_totalprice") < 20000, F.lit("not recorded"))
        .when(F.col("o_totalprice") < 40000, F.lit(None).cast("string"))
        .when(F.col("o_totalprice") < 60000, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.coalesce(F.get(F.array(*spelled), (F.col("o_custkey") % 7).cast("int")), other))
    )
    age = F.concat(F.col("age").cast("string"), F.when(F.col("o_custkey") % 3 == 0, F.lit(".0")).otherwise(F.lit("")))
    weapon = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("nan")).otherwise(F.col("weapon"))
    rows = _orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("DR_NO"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias(" Date Rptd."),
        date.alias("DATE OCC"),
        F.initcap("n_name").alias("AREA NAME"),
        F.expr("substr(o_orderpriority, 1, 1)").alias("Crm Cd"),
        F.col("crime").alias("Crm Cd Desc"),
        weapon.alias("Weapon Desc"),
        age.alias("Vict Age"),
        F.when(F.col("o_totalprice") <= 450000, F.col("o_orderstatus")).alias("Vict Sex"),
    )
    again = rows.filter("DR_NO % 100 = 1").withColumn("Weapon Desc", F.lit(None).cast("string"))
    return rows.unionByName(again)


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_headers(raw_export(spark, sf_dir))


def scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder for what this application derives from one set of tables."""
    return shared_folder(spark, hashlib.md5(sf_dir.encode()).hexdigest()[:12], name)


def raw_csv(spark: SparkSession, sf_dir: str) -> str:
    """Write the export as CSV and return its folder."""
    path = scratch(spark, sf_dir, "raw")
    raw_export(spark, sf_dir).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def broken_csv(spark: SparkSession, sf_dir: str) -> str:
    """Write the export with malformed lines among the others and return its folder; no header lines.

    Of 50 ids one row each lacks its last field, has one more, begins with an open quote, or goes on in a second line.
    """
    path = scratch(spark, sf_dir, "broken")
    export = raw_export(spark, sf_dir)
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in export.columns]), {"escape": '"'})
    lot = F.col("DR_NO").cast("long") % 50
    spoiled = (
        F.when(lot == 3, F.regexp_replace(line, ",[^,]*$", ""))
        .when(lot == 7, F.concat(line, F.lit(",more")))
        .when(lot == 11, F.concat(F.lit('"'), line))
        .when(lot == 13, F.regexp_replace(line, ",([^,]*)$", ',"$1\n"'))
        .otherwise(line)
    )
    export.select(spoiled.alias("value")).write.mode("overwrite").text(path)
    return path


def timed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per event, with a time of day."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("dr_no"),
        F.col("ts").alias("datetime"),
        F.col("event_type").alias("crm_cd_desc"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text: id and text of every document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("dr_no"), F.col("text").alias("mo_text"))


def spelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dr_no, mo_text, words): the key and the text of every document, without a join."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("dr_no"), text_key("text").alias("mo_text"), F.col("text").alias("words")
    )


def document_cases(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """One case per document, with the time of the event of the same id and labels where given.

    Texts hardly repeat here, so the nearest cases of a base differ from it and training pairs
    carry both labels at any scale; in ``cases`` enough copies of one text make every label 1.
    ``keyed``: ``mo_text`` is the key of the text, made where the text lies, so that the joins shuffle no texts.
    """
    documents = table(spark, sf_dir, "documents")
    if keyed:
        documents = documents.withColumn("text", text_key("text"))
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    return (
        documents
        .join(events, F.col("doc_id") == F.col("event_id"), "left")
        .join(labels, F.col("doc_id") == F.col("label_id"), "left")
        .select(
            F.col("doc_id").alias("dr_no"),
            F.col("ts").alias("datetime"),
            F.col("source").alias("area_name"),
            F.length(F.col("n_chars").cast("string")).alias("crm_cd"),
            F.concat(F.lit("length "), F.length(F.col("n_chars").cast("string"))).alias("crm_cd_desc"),
            F.col("lang").alias("weapon_desc"),
            (20 + 10 * F.col("quality") + 5 * F.col("toxic")).cast("int").alias("vict_age"),
            F.col("quality").cast("string").alias("vict_sex"),
            F.col("text").alias("mo_text"),
        )
    )
