"""Importance resampling towards a target distribution of hashed word runs.

A text is lower-cased in A-Z only; its words are the runs of ASCII letters and digits and of all characters
beyond ASCII. Its features are all words and all pairs of neighbouring words joined by a blank, repeats
counted, each in the bucket of its CRC-32. A bucket's gain says how much more frequent it is in the target
texts than in the documents; a document weighs the floored mean gain of its features. Weight plus seeded
Gumbel noise is its score, and the highest scores are drawn, which is sampling without replacement in
proportion to the exponential of the weights.

Texts are scanned by an Aho-Corasick automaton of the distinct words of a stretch of text, each between two
delimiters. A word's payload is its CRC-32 and its length. The automaton emits one payload a word; the CRC of
a pair is composed from two neighbouring payloads alone: appending n bytes to a message is a linear map of its
CRC, taken from a table for each n, so no pair is ever spelled out.

Counts over all documents are one row a bucket and task, then sums; gains are one number a bucket, which is
what is broadcast. Ranks come from a range partitioning of the scores (``order.numbered``).

Edge cases: null and empty texts have no features, weight 0, and are scored by their noise alone; words may be
of any length; a null id's noise is that of no digits; rows that repeat an id have the same noise and tie by
the id, then by features and weight; without target texts or documents their counts are 0; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.common import id_and_text, run_folder, slices, stored
from caselink.llm.order import numbered

BUCKETS = 10_000
SHARE = 25
LEAST_WORDS = 20
SEED = 7
# Bytes of text that one automaton is made for.
STRETCH = 250_000
_END = b"\x01"
#: Letters are lowered, other ASCII but digits becomes a blank, all other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _byte_table() -> np.ndarray:
    """What each low byte of a CRC-32 register (reflected polynomial EDB88320) adds when a zero byte follows."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return c


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by what each of a register's four bytes adds, of many registers."""
    a, b, c, d = tables[..., 0, :], tables[..., 1, :], tables[..., 2, :], tables[..., 3, :]
    return a[crc & 255] ^ b[(crc >> 8) & 255] ^ c[(crc >> 16) & 255] ^ d[crc >> 24]


@lru_cache(maxsize=64)
def _doubling(k: int) -> np.ndarray:
    """The map of a CRC under 2^k zero bytes more, as four tables of 256."""
    registers = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    if k == 0:
        return (registers >> np.uint32(8)) ^ _byte_table()[registers & 255]
    half = _doubling(k - 1)
    return _apply(half, half)


@lru_cache(maxsize=4096)
def _appending(n: int) -> np.ndarray:
    """The map of a CRC under ``n`` zero bytes more."""
    registers = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(n.bit_length()):
        if n >> k & 1:
            registers = _apply(_doubling(k), registers)
    return registers


def compose(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of left message + right message, from their CRCs and the right ones' lengths."""
    lengths, which = np.unique(length, return_inverse=True)
    tables = np.stack([_appending(int(n)) for n in lengths]) if len(lengths) else np.zeros((1, 4, 256), np.uint32)
    moved = tables[which, 0, left & 255]
    for k in range(1, 4):
        moved ^= tables[which, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    return moved ^ right


class WordAutomaton:
    """Finds delimiter-bounded ``words``; each carries its CRC, its CRC with a blank behind it, and its length."""

    def __init__(self, words: Iterable[bytes]):
        words = list(words)
        self.crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self.spaced = np.fromiter((zlib.crc32(b" ", c) for c in self.crc.tolist()), np.uint32, len(words))
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self._found = ahocorasick.Automaton()
        for i, word in enumerate(words):
            self._found.add_word(f" {word.decode('latin-1')} ", i)
        self._found.make_automaton()

    def scan(self, stream: bytes) -> np.ndarray:
        """The numbers of all words in ``stream`` in order; words stand between blanks, one or more."""
        return np.fromiter(map(itemgetter(1), self._found.iter(stream.decode("latin-1"))), np.int64)


def _stretches(texts: list[str], size: int) -> Iterator[list[tuple[int, bytes]]]:
    """(text number, folded bytes), together about ``size`` bytes; a longer text is cut at blanks."""
    held, n = [], 0
    for i, text in enumerate(texts):
        raw = text.encode().translate(_FOLD)
        start = 0
        while True:
            cut = raw.find(b" ", start + size) if len(raw) - start > size else -1
            part = raw[start:] if cut < 0 else raw[start:cut]
            held.append((i, part))
            n += len(part)
            if n >= size:
                yield held
                held, n = [], 0
            if cut < 0:
                break
            start = cut
    if held:
        yield held


def scan_features(texts: list[str], buckets: int = BUCKETS, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per stretch: (text number of each word, text number of each feature, bucket of each feature)."""
    last_owner, last_spaced = -1, np.uint32(0)
    for held in _stretches(texts, stretch):
        of_part = np.array([i for i, _ in held])
        stream = b" " + b"".join(part + b" " + _END + b" " for _, part in held)
        words = set(stream.split())
        words.discard(_END)
        automaton = WordAutomaton([_END, *words])
        found = automaton.scan(stream)
        end = found == 0
        owner = of_part[(np.cumsum(end) - end)[~end]]
        found = found[~end]
        if not len(found):
            continue
        crc, spaced, length = automaton.crc[found], automaton.spaced[found], automaton.length[found]
        # The word before the first one, where a text goes on from the stretch before.
        before = np.concatenate([[last_spaced], spaced[:-1]]).astype(np.uint32)
        paired = np.concatenate([[owner[0] == last_owner], owner[1:] == owner[:-1]])
        pairs = compose(before[paired], crc[paired], length[paired])
        last_owner, last_spaced = int(owner[-1]), spaced[-1]
        yield owner, np.concatenate([owner, owner[paired]]), (np.concatenate([crc, pairs]) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all rows of ``texts`` (text) in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, part in slices(batches):
            for _, _, bucket in scan_features(part, buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(document_counts: DataFrame, target_counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of how much more frequent each bucket is in the target; one number a bucket."""
    s, t = ([0] * buckets, [0] * buckets)
    for held, table in ((s, document_counts), (t, target_counts)):
        # At most one row a bucket.
        for row in table.collect():
            held[row["bucket"]] = row["n"]
    all_s, all_t = sum(s), sum(t)
    ratio = lambda a, b: (a + 1.0) * (all_s + float(buckets)) / ((b + 1.0) * (all_t + float(buckets)))
    return np.array([math.floor(1000.0 * math.log(ratio(a, b))) for a, b in zip(t, s)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id and the seed."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of ``docs`` (doc_id, text); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch, texts in slices(batches):
            n_words, n_features, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for word_owner, owner, bucket in scan_features(texts, len(gain)):
                n_words += np.bincount(word_owner, minlength=len(texts))
                n_features += np.bincount(owner, minlength=len(texts))
                # Sums of integers below 2^53, so exact.
                total += np.bincount(owner, gain[bucket], len(texts)).astype(np.int64)
            weight = np.where(n_features > 0, np.floor_divide(total, np.maximum(n_features, 1)), 0)
            drawn = np.array([noise(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (n_words, n_features, weight, weight + drawn)]],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document.

    ``rank`` numbers the drawn ones, ``share`` per cent (rounded down) of the documents of at least
    ``least_words`` words, by score; it is null for the rest.
    """
    folder = run_folder(docs.sparkSession, "importance")
    rows = id_and_text(docs, id_col, text_col)
    aim = target.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows.select("text"), buckets), bucket_counts(aim, buckets), buckets)
    # Written first: dealing by ranges looks at its input twice.
    scored = stored(scores(rows, gain, seed), folder, "scored").withColumn("fit", F.col("n_words") >= least_words)
    # Fit documents come first, so their numbers are their ranks.
    order = [F.desc("fit"), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = numbered(scored, order, folder, "ranked")
    n_fit = ranked.agg(F.count(F.when(F.col("fit"), 1))).scalar()
    quota = F.floor(n_fit * F.lit(share) / F.lit(100))
    drawn = F.col("fit") & (F.col("number") <= quota)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("number")).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH texts AS (
  SELECT FALSE AS target, row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT TRUE, row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
  SELECT target, rid, doc_id, regexp_extract_all(text, '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM texts
), features AS (
  SELECT target, rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM words
), crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), hashed AS (
  SELECT feature, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM features), crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM features JOIN hashed USING (feature) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000.0::DOUBLE) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT rid, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE NOT target GROUP BY rid
), scored AS (
  SELECT doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (rid) WHERE NOT target
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, 25 * (count(*) FILTER (fit) OVER ()) // 100 AS quota FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= quota THEN place END AS rank FROM ranked
"""
