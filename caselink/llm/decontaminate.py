"""Benchmark decontamination: documents that contain a test item, found by size-partitioned MinHash containment.

An item is contained in a document if at least 75 of 100 of the item's distinct word shingles occur in it. A
shingle is a run of five words; an item of fewer words is one run of just as many, and documents are searched
for runs of those lengths as well. Test items are short and documents may be long, so the similarity of the two
whole sets says nothing. The search therefore keeps a bottom-k MinHash sketch of the *short* side only and asks
which documents hold a value of it. Items are partitioned by size, in powers of two, and the largest size of a
partition sets its k: a document that contains an item of q shingles lacks at most q - ceil(0.75 q) of them,
so one more sketch value than that cannot be missed altogether, in a partition of any size. A document is matched
only against items whose size it can hold. Each candidate pair is then verified on the full sets of shingle texts.

Everything is column expressions. Documents are not shuffled to find candidates, as long as the sketches
fit the stated bound for a broadcast; above it they are joined on the shingle's hash, each hash dealt over lanes
by document, so that a frequent shingle is no single task.

Edge cases: null or empty texts have no shingle and match nothing; an item of one word is found in every document
that has this word, so such items should not be in a benchmark that clean documents are to pass; repeated items
each give their own pairs; rows with one doc_id (null included) count as one document that contains what any of
them does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.llm.common import free_name, run_folder, stored
from caselink.llm.shingles import WORDS, words

PERCENT = 75
#: Bytes of sketches, and of shingle texts of items, that may be broadcast.
BROADCAST_BYTES = 64 << 20
_SKETCH_ROW = 24
#: Parts of a hash's rows where the sketches are joined by a shuffle.
LANES = 32


def _runs(word_array: Column, length: Column, value: Callable[[Column], Column]) -> Column:
    """``value`` of every run of ``length`` words, repeats included."""
    last = F.size(word_array) - length + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: value(F.slice(word_array, i, length)))


def _text(run: Column) -> Column:
    return F.array_join(run, " ")


def item_sets(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item_set (distinct shingle texts), words, run_length, n_item; items without words are left out."""
    parts = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words"))
    parts = parts.filter(F.size("words") > 0).withColumn("run_length", F.least(F.size("words"), F.lit(WORDS)))
    sets = parts.withColumn("item_set", F.array_distinct(_runs(F.col("words"), F.col("run_length"), _text)))
    return sets.withColumn("n_item", F.size("item_set").cast("long"))


def sketches(sets: DataFrame) -> DataFrame:
    """item_id, n_item, hash: the bottom-k values of each item, k by its size partition."""
    hashes = F.array_sort(F.array_distinct(_runs(F.col("words"), F.col("run_length"), lambda run: F.xxhash64(run))))
    # The partition's largest size: as many ones as the size has binary digits.
    top = F.expr("shiftleft(1L, length(bin(n_item))) - 1")
    k = top - F.floor((top * PERCENT + 99) / 100) + 1
    return sets.select("item_id", "n_item", F.explode(F.slice(hashes, F.lit(1), F.least(k, F.col("n_item")).cast("int"))).alias("hash"))


def contaminated_pairs(
    docs: DataFrame, items: DataFrame, folder: str, doc_id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id, item_shingles, shared of each document and each item that it contains."""
    texts = docs.select(F.col(doc_id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows without an id, and rows that share one, are still told apart by their text.
    texts = texts.withColumn("digest", F.xxhash64("text"))
    sets = stored(item_sets(items), folder, "items")
    sketch = stored(sketches(sets), folder, "sketches")
    set_bytes = F.aggregate("item_set", F.lit(16), lambda held, s: held + F.octet_length(s) + 16)
    figures = sets.agg(F.coalesce(F.sum(set_bytes), F.lit(0)).alias("bytes"), F.collect_set("run_length").alias("lengths")).first()

    split = texts.select("doc_id", "digest", words(F.col("text")).alias("words"))
    # Run lengths that items have: five, and at most one to four besides.
    hashes = [_runs(F.col("words"), F.lit(n), lambda run: F.xxhash64(run)) for n in sorted(figures["lengths"]) or [WORDS]]
    probes = split.select("doc_id", "digest", F.size("words").alias("n_words"), F.explode(F.concat(*hashes)).alias("hash"))
    if sketch.count() * _SKETCH_ROW <= BROADCAST_BYTES:
        met = probes.join(F.broadcast(sketch), "hash")
    else:
        dealt = sketch.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
        met = probes.withColumn("lane", F.pmod("digest", F.lit(LANES)).cast("int")).join(dealt, ["hash", "lane"])
    # A document of w words has at most w shingles.
    found = met.filter(F.col("n_words") * 100 >= F.col("n_item") * PERCENT)
    candidates = stored(found.select("doc_id", "digest", "item_id").distinct(), folder, "candidates")

    asked = candidates.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    rows = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    cut = rows.select("doc_id", "item_id", words(F.col("text")).alias("words"))
    one = sets.groupBy("item_id", "item_set", "run_length").agg(F.first("n_item").alias("n_item"))
    own = F.array_intersect("item_set", _runs(F.col("words"), F.col("run_length"), _text))
    shared = cut.join(F.broadcast(one) if figures["bytes"] <= BROADCAST_BYTES else one, "item_id").select(
        "doc_id", "item_id", "n_item", F.size(own).cast("long").alias("shared")
    )
    return (
        shared.filter(F.col("shared") * 100 >= F.col("n_item") * PERCENT)
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_item").alias("item_shingles"), F.max("shared").alias("shared"))
    )


def keep_clean(docs: DataFrame, items: DataFrame, folder: str) -> DataFrame:
    """The rows of ``docs`` whose document contains no item; columns unchanged."""
    name = free_name(docs, "_bad")
    bad = stored(contaminated_pairs(docs, items, folder).select(F.col("doc_id").alias(name)).distinct(), folder, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated_pairs(docs, items, run_folder(docs.sparkSession, "decontaminate"))


SQL = f"""
WITH cut AS (
  SELECT id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id AS id, 'doc' AS kind, text FROM documents UNION ALL SELECT item_id, 'item', text FROM benchmark)
), lengths AS (SELECT DISTINCT least(len(w), {WORDS}) AS l FROM cut WHERE kind = 'item' AND len(w) > 0),
runs AS (
  SELECT DISTINCT id, kind, array_to_string(w[i:i + l - 1], ' ') AS shingle
  FROM (SELECT id, kind, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM cut JOIN lengths ON l <= len(w) AND (kind = 'doc' OR l = least(len(w), {WORDS})))
), items AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM runs WHERE kind = 'item')
SELECT d.id AS doc_id, i.id AS item_id, i.n AS item_shingles, count(*) AS shared
FROM items i JOIN runs d ON d.kind = 'doc' AND d.shingle = i.shingle
GROUP BY ALL HAVING count(*) * 100 >= i.n * {PERCENT}
"""
