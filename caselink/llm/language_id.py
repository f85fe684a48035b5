"""Language identification by prediction by partial matching (PPM).

Per language, a tree of byte contexts of order 0 to 3 holds how often each byte followed each context. A
byte costs -log2 of its probability after the longest context the language has seen; a byte that the
context has not seen pays the context's escape probability and falls to the next shorter context, in the
end to 1 of 256. A context met n times with d different bytes gives a byte seen c times c / (n + d) and
escapes with d / (n + d). The counts are frozen, so the cost of a byte depends on it and the three before
it only: each worker turns the trees into sorted arrays of what was met, and the code length of a whole text
is a sum of lookups, by binary search and back-off where a run was never met. The language with the shortest
code wins.

The trees are fitted on a sample of at most about ``SAMPLE`` labelled documents per language, drawn by a
digest of the id, so the counts that reach the driver are bounded. Every row is scored over its whole text.

Edge cases: null text, empty text and text without a letter give ``und`` with score 0; rows without a
language are not learned from; with nothing to learn from, all is ``und``; equal code lengths go to the
language first in the alphabet; the score is the winner's share of 2^-(bits per byte * 32) over languages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselink.llm.common import one_model, slices, tidy

UNDETERMINED = "und"
SAMPLE = 1500
FOLDS = 5
ORDER = 3
_PAD = b"\n" * ORDER
_EVIDENCE = 32.0
_STEP = 500_000
_LETTER = regex.compile(r"\p{L}")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's digits, modulo ``FOLDS``; documents of fold 0 are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learning_sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of about ``per_language`` rows of each language outside fold 0, by a digest of the id."""
    known = docs.filter(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col)) != 0)
    ).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return known.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    return known.filter(draw < share[F.col("lang")]).select("lang", "text")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(_PAD + text.encode(), np.uint8)


def _grams(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.uint32)
    return (c[:-3] << 24) | (c[1:-2] << 16) | (c[2:-1] << 8) | c[3:]


def count_contexts(sample: DataFrame) -> pa.Table:
    """How often each run of four bytes occurs in each language's sample: lang, gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            langs = np.array(batch.column("lang").to_pylist())
            for lang in sorted(set(langs)):
                grams = np.concatenate([_grams(_codes(texts[i])) for i in np.flatnonzero(langs == lang)])
                gram, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                )

    grams = sample.mapInArrow(run, "lang string, gram long, n long")
    # Bounded: the sample is.
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands in the sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _Costs:
    """A cost for each language of the keys that any has met; ``base`` gives those of languages that have not.

    Keys of several languages have a row of a table, those of one language a single number.
    """

    def __init__(self, key: np.ndarray, lang: np.ndarray, cost: np.ndarray, width: int, base: Callable[[np.ndarray], np.ndarray]):
        self.base = base
        keys, first, count = np.unique(key, return_index=True, return_counts=True)
        lone = count < min(2, width)
        self.keys, self.lone = keys[~lone].astype(np.uint32), keys[lone].astype(np.uint32)
        self.lone_lang, self.lone_cost = lang[first[lone]].astype(np.int16), cost[first[lone]].astype(np.float32)
        self.table = base(self.keys)
        several = np.repeat(~lone, count)
        self.table[np.repeat(np.cumsum(~lone) - 1, count)[several], lang[several]] = cost[several]

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The costs of each wanted key in every language."""
        at, hit = _places(self.keys, wanted)
        if hit.all():
            return self.table[at]
        miss = np.flatnonzero(~hit)
        left = wanted[miss]
        rest = self.base(left)
        place, single = _places(self.lone, left)
        place = place[single]
        rest[np.flatnonzero(single), self.lone_lang[place]] = self.lone_cost[place]
        if len(miss) == len(wanted):
            return rest
        out = self.table[at]
        out[miss] = rest
        return out

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.lone, self.lone_lang, self.lone_cost, self.table))


class ContextTrees:
    """The trees that ``counts`` (lang, gram, n) describe, level by level as sorted arrays of what was met.

    ``cost[k]`` holds what a byte costs after k context bytes, ``escape[k]`` what it costs to leave such a context.
    Memory follows the counts, not the number of possible contexts.
    """

    def __init__(self, counts: pa.Table):
        coded = counts["lang"].combine_chunks().dictionary_encode()
        named = coded.dictionary.to_pylist()
        self.langs = sorted(named)
        of = np.searchsorted(self.langs, named).astype(np.int16)[coded.indices.to_numpy()]
        gram, n = counts["gram"].to_numpy(), counts["n"].to_numpy().astype(np.float64)
        width = len(self.langs)
        self.cost: list[_Costs] = []
        self.escape: list[_Costs] = []
        nothing = lambda keys: np.zeros((len(keys), width), np.float32)
        for k in range(ORDER + 1):
            # The byte is the lowest eight bits; its context of k bytes stands above them.
            pair, which = np.unique((gram & ((1 << 8 * (k + 1)) - 1)) * width + of, return_inverse=True)
            met = np.bincount(which, n)
            key, owner_lang = pair // width, (pair % width).astype(np.int16)
            context, owner = np.unique((key >> 8) * width + owner_lang, return_inverse=True)
            kinds = np.bincount(owner)
            both = np.bincount(owner, met) + kinds
            met /= both[owner]
            del pair, which, owner
            self.escape.append(_Costs(context // width, context % width, -np.log2(kinds / both), width, nothing))
            del context, kinds, both
            self.cost.append(_Costs(key, owner_lang, -np.log2(met), width, partial(self._left, k)))

    def _left(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Costs of bytes that are not met after their k context bytes: the escape, then what they cost after k - 1."""
        out = self.escape[k].of(keys >> np.uint32(8))
        out += np.float32(8) if k == 0 else self.cost[k - 1].of(keys & np.uint32((1 << 8 * k) - 1))
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each whole text under each language."""
        raw = [_PAD + t.encode() for t in texts]
        codes = np.frombuffer(b"".join(raw), np.uint8)
        out = np.zeros((len(texts), len(self.langs)))
        text = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
        # Positions whose three predecessors belong to the same text.
        for k in range(ORDER, len(codes), _STEP):
            owner = text[k : k + _STEP]
            cost = self.cost[ORDER].of(_grams(codes[k - ORDER : k + _STEP]))
            cost[owner != text[k - ORDER : k - ORDER + len(owner)]] = 0
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[starts]] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return out


def _trees(shared) -> ContextTrees:
    """The tables of a broadcast model, built once in each worker."""
    counts, key = shared.value
    return one_model(key, lambda: ContextTrees(counts))


def fit(docs: DataFrame, per_language: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> pa.Table:
    return count_contexts(learning_sample(docs, per_language, id_col, text_col, lang_col))


def identify(docs: DataFrame, counts: pa.Table, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """All columns of ``docs``, then ``<prefix>pred`` and ``<prefix>score``; no shuffle."""
    names = (f"{prefix}pred", f"{prefix}score")
    pred, score = (pa.field(names[0], pa.string()), pa.field(names[1], pa.float64()))
    if len(counts) == 0:
        return docs.withColumns({names[0]: F.lit(UNDETERMINED), names[1]: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast((counts, uuid.uuid4().hex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(shared)
        for whole in batches:
            renamed = whole.rename_columns([f"_{i}" for i in range(whole.num_columns)])
            at = whole.schema.names.index(text_col)
            keyed = renamed.append_column("text", renamed.column(at))
            for batch, texts in slices([keyed]):
                lettered = np.array([bool(_LETTER.search(t)) for t in texts])
                bits = trees.bits(texts)
                bytes_ = np.array([max(1, len(t.encode())) for t in texts])[:, None]
                share = np.exp2((bits.min(1, keepdims=True) - bits) / bytes_ * _EVIDENCE)
                winner = np.array(trees.langs)[bits.argmin(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:-1],
                        pa.array(np.where(lettered, winner, UNDETERMINED).tolist(), pa.string()),
                        pa.array(np.where(lettered, 1 / share.sum(1), 0.0), pa.float64()),
                    ],
                    [*whole.schema.names, pred.name, score.name],
                )

    schema = T.StructType([*docs.schema.fields, T.StructField(pred.name, T.StringType()), T.StructField(score.name, T.DoubleType())])
    return docs.mapInArrow(tidy(run, keeps_model=True), schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from a model learned on the other folds."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    out = identify(rows, fit(docs))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least`` or more; columns unchanged.

    Where no row has a language to learn from, the rows that hold a letter.
    """
    counts = fit(docs)
    if len(counts) == 0:
        return docs.filter(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    prefix = "_found_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    verdict = identify(docs, counts, prefix=prefix)
    good = (F.col(f"{prefix}pred") != UNDETERMINED) & (F.col(f"{prefix}score") >= least)
    return verdict.filter(good).select(*[F.col(f"`{c}`") for c in docs.columns])
