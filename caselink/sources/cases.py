"""Case tables: raw CSV in, clean table in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselink.schema import CASE_SCHEMA


def normalize_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace(".", "")


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_header(c) for c in df.columns])


def read_raw_cases(spark: SparkSession, path: str, headers: list[str] | None = None) -> DataFrame:
    """Raw export with every column read as text, headers normalised.

    Naming the ``headers`` saves the extra look at the files that finds them.
    """
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"')
    if headers is not None:
        reader = reader.schema(T.StructType([T.StructField(h, T.StringType()) for h in headers]))
    return normalize_headers(reader.csv(path))


#: Why a line of a raw export is not taken for a row.
BLANK_LINE, OPEN_QUOTE, TOO_FEW, TOO_MANY = "blank line", "open quote", "too few fields", "too many fields"


def checked_lines(spark: SparkSession, path: str, headers: list[str]) -> DataFrame:
    """(line, reason): every line of the files but headers; ``reason`` is null for a line that is a row.

    Lines are judged one by one, so files of any size are split. A value that goes on in the next line leaves an
    open quote in both and is rejected as such, where the CSV reader would give two rows of nulls.
    """
    line = F.col("value")
    # What stands in closed quotes does not count; a quote that is left is open.
    bare = F.regexp_replace(line, '"[^"]*"', "")
    fields = F.size(F.split(bare, ","))
    reason = (
        F.when(F.trim(line) == "", BLANK_LINE)
        .when(F.contains(bare, F.lit('"')), OPEN_QUOTE)
        .when(fields < len(headers), TOO_FEW)
        .when(fields > len(headers), TOO_MANY)
    )
    lines = spark.read.text(path).filter(line != ",".join(headers))
    return lines.select(line.alias("line"), reason.alias("reason"))


def read_checked_cases(spark: SparkSession, path: str, headers: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): the raw export as ``read_raw_cases`` gives it, and (line, reason) of all other lines."""
    lines = checked_lines(spark, path, headers)
    schema = T.StructType([T.StructField(normalize_header(h), T.StringType()) for h in headers])
    parsed = F.from_csv("line", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"', "quote": '"'})
    rows = lines.filter("reason is null").select(parsed.alias("row")).select("row.*")
    return rows, lines.filter("reason is not null")


def read_cases(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Clean case table from Parquet, or from (gzip) CSV.

    A gzip CSV file cannot be split: keep one only for exchange and convert it once to Parquet.
    """
    if format == "csv":
        # Whole numbers may be spelled 34.0 in a file that other tools wrote.
        as_text = [T.StructField(f.name, T.StringType() if _is_whole(f) else f.dataType) for f in CASE_SCHEMA.fields]
        reader = spark.read.schema(T.StructType(as_text)).option("header", True).option("escape", '"')
        return with_case_types(reader.option("timestampNTZFormat", "yyyy-MM-dd[ HH:mm:ss[.SSSSSS]]").csv(path))
    return spark.read.schema(CASE_SCHEMA).format(format).load(path)


def write_cases(cases: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    writer = cases.write.mode(mode)
    if format == "csv":
        writer = (
            writer.option("header", True)
            .option("escape", '"')
            .option("compression", "gzip")
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        )
    writer.format(format).save(path)


def _is_whole(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.IntegerType)


def _typed(field: T.StructField) -> Column:
    column = F.col(field.name)
    typed = column.try_cast(field.dataType)
    if not _is_whole(field):
        return typed
    number = column.try_cast("double")
    return F.coalesce(typed, F.when(number == F.floor(number), number.try_cast(field.dataType)))


def with_case_types(df: DataFrame) -> DataFrame:
    """Cast the case columns that are present; text that is no number becomes null.

    A whole number may be spelled as a decimal (34.0); any other decimal is no crime code or age.
    """
    have = set(df.columns)
    return df.select(*[_typed(f).alias(f.name) for f in CASE_SCHEMA.fields if f.name in have])
