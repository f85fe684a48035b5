"""Chat formatting by prefix-target expansion, and reading the format back.

Every assistant turn becomes an example of its own: all turns before it are its context and only its reply
is trainable. A conversation that ends in other turns, or has no reply at all, gets one more row that holds
it whole with an empty mask, so that nothing is lost. An example is the turns one after another, each as

    <s>[INST]role[/INST]text</s>

The control strings are escaped inside roles and texts by a backslash after their first character;
backslashes that already stand there are kept, one more is added, so the escape can be undone exactly.
``loss_start`` and ``loss_end`` are code points of the example's text.

The operator is column expressions only. A conversation's turns are gathered once, its examples are cut
from that one array, and long conversations give as many rows as they have replies.

Edge cases: null text or role is empty; rows tied on the turn are ordered by role and text, null turns come
first; repeated rows are repeated turns; null conversation ids are one conversation; texts may hold control
strings, escapes or line ends; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.llm.common import run_folder, stored

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
REPLY = "assistant"
_ESCAPE = (r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")
_UNESCAPE = (r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"$1$2$3")
_TURN = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *_ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *_UNESCAPE)


def format_examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 1; 0 for the row without a target), text, loss_start, loss_end."""
    clean = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    shown = clean.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "body",
            F.concat(F.lit(BEGIN + OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"),
            escape(F.col("body")).alias("reply"),
        ).alias("turn"),
    )
    whole = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    marked = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(t["head"], t["reply"], F.lit(END))).alias("shown"),
        F.filter(
            F.transform(
                "turns",
                lambda t, i: F.struct(
                    (i + 1).alias("last"),
                    (t["role"] == REPLY).alias("target"),
                    F.length(t["head"]).alias("head"),
                    F.length(t["reply"]).alias("reply"),
                ),
            ),
            lambda t: t["target"],
        ).alias("replies"),
    )
    n_turns = F.size("shown")
    covered = F.coalesce(F.try_element_at("replies", F.lit(-1))["last"], F.lit(0))
    rest = F.when(
        covered < n_turns,
        F.array(F.struct(n_turns.alias("last"), F.lit(False).alias("target"), F.lit(0).alias("head"), F.lit(0).alias("reply"))),
    )
    targets = F.concat(F.col("replies"), F.coalesce(rest, F.filter("replies", lambda _: F.lit(False))))
    examples = marked.select("conv_id", "shown", F.posexplode(targets).alias("at", "target"))
    context = examples.select(
        "conv_id",
        F.when(F.col("target.target"), F.col("at") + 1).otherwise(0).alias("example"),
        F.array_join(F.slice("shown", F.lit(1), F.col("target.last") - 1), "").alias("context"),
        F.element_at("shown", F.col("target.last")).alias("final"),
        "target",
    )
    start = F.length("context") + F.when(F.col("target.target"), F.col("target.head")).otherwise(F.length("final"))
    return context.select(
        "conv_id",
        "example",
        F.concat("context", "final").alias("text"),
        start.cast("long").alias("loss_start"),
        (start + F.col("target.reply")).cast("long").alias("loss_end"),
    )


def read_examples(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all its rows) of each conversation."""
    mask = F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = examples.select("conv_id", "example", "text", F.length("text").cast("long").alias("chars"), unescape(mask).alias("reply"))
    # The longest row holds the conversation as far as any row does.
    whole = rows.groupBy("conv_id").agg(
        F.max_by("text", "chars").alias("text"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda r: r["reply"]), ""
        ).alias("loss"),
    )
    pieces = whole.withColumn("turns", F.slice(F.split("text", END), F.lit(1), F.size(F.split("text", END)) - 1))
    told = F.transform(
        "turns",
        lambda t: F.concat(
            unescape(F.regexp_extract(t, _TURN, 1)), F.lit("\n"), unescape(F.regexp_extract(t, _TURN, 2)), F.lit("\n")
        ),
    )
    return pieces.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def probe_turns(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, REPLY, said)], "conv_id long, turn long, role string, text string")


def formatted_digests(turns: DataFrame) -> DataFrame:
    """Write the examples of ``turns`` and read them back."""
    folder = run_folder(turns.sparkSession, "chat")
    return read_examples(stored(format_examples(turns), folder, "examples"))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(16 + 4 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
           + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))) OVER o AS chars
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
