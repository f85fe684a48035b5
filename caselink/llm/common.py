"""Helpers of the operators: bounded slices of texts inside a task, shared files, word stores."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.sources.scratch import shared_folder

SLICE_CHARS = 1_000_000
PIECE_CHARS = 1_000_000
_SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column's name can clash. Null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def slices(batches: Iterable[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that the texts of a slice hold about ``chars``; a longer text is a slice of its own."""
    for batch in batches:
        column = batch.column("text")
        start, held, texts = 0, 0, []
        for i, value in enumerate(column):
            text = value.as_py() or ""
            if texts and held + len(text) > chars:
                yield batch.slice(start, i - start), texts
                start, held, texts = i, 0, []
            texts.append(text)
            held += len(text)
        if texts:
            yield batch.slice(start), texts


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a very long text before a single blank between two ASCII letters.

    Each tokenizer here ends a word at such a place, so pieces can be encoded one by one.
    """
    start = 0
    while len(text) - start > chars:
        cut = _SAFE_CUT.search(text, start + chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def run_folder(spark: SparkSession, name: str) -> str:
    """A new shared folder for one run of an operator, as a URI where the setting is one."""
    return shared_folder(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` into the run's folder and read it back, which cuts its lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MODEL: dict = {}


def one_model(key: object, build: Callable[[], object]):
    """The model of ``key``, built once in each worker.

    Workers are reused by stage after stage, so each holds one model: the one that was asked for last.
    """
    if key not in _MODEL:
        _MODEL.clear()
        _give_back()
        _MODEL[key] = build()
    return _MODEL[key]


def _give_back() -> None:
    """Return freed memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


BATCH_BYTES = 4 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to workers in batches of at most about ``BATCH_BYTES``, not only of 10,000 rows of whatever size.

    A lower bound that the session already has stays.
    """
    held = (spark.conf.get(_BYTES_SETTING, None) or "").rstrip("b")
    # A value with a unit is one that the session's owner wrote.
    if not held or (held.isdigit() and int(held) > BATCH_BYTES):
        spark.conf.set(_BYTES_SETTING, f"{BATCH_BYTES}b")


def tidy(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps_model: bool = False
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker, which may wait long for its next task, holds no freed memory.

    An operator without a model of its own drops what an earlier stage left in the worker.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_model:
            _MODEL.clear()
        yield from run(batches)
        _give_back()

    return tidied


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def file_system(uri: str):
    """pyarrow's file system of ``uri`` and the path within it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


class WordStore:
    """The ids of words met so far, in one flat array; emptied when it holds ``most`` words.

    ``encode`` maps a list of new words to (ids of all words in order, number of ids of each word).
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self._encode, self._most = encode, most
        self._clear()

    def _clear(self) -> None:
        self._index: dict = {}
        self._ids = np.zeros(0, np.uint32)
        self._ends = np.zeros(1, np.int64)

    def _places(self, words: list) -> np.ndarray:
        """Where each word stands in the store; -1 for one that does not."""
        return np.fromiter(map(self._index.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, words: list | pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``words`` in order, and the number of ids of each run of ``counts`` words.

        Of an Arrow array of bytes, only the distinct words are looked up.
        """
        which = None
        if isinstance(words, pa.Array):
            coded = words.dictionary_encode()
            which, words = coded.indices.to_numpy(), _values(coded.dictionary)
        at = self._places(words)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(map(words.__getitem__, missing.tolist())))
            if len(new) + len(self._index) > self._most and self._index:
                self._clear()
                new, missing = list(dict.fromkeys(words)), np.arange(len(words))
            ids, sizes = self._encode(new)
            first = len(self._index)
            self._index.update(zip(new, range(first, first + len(new))))
            self._ids = np.concatenate([self._ids, ids.astype(np.uint32)])
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])
            at[missing] = self._places(list(map(words.__getitem__, missing.tolist())))
        at = at if which is None else at[which]
        begins, sizes = self._ends[at], self._ends[at + 1] - self._ends[at]
        flat = self._ids[ranges(begins, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(ends[bounds])


def _values(words: pa.Array) -> list[bytes]:
    """The values of an array of bytes without nulls."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes() if bounds[-1] else b""
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (sizes[0] of them), begins[1], ..."""
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.repeat(begins - before, sizes) + np.arange(total)


class PairMerges:
    """Byte-pair merges of many short words at once. A pair of ids has a rank and the id it merges into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, n_ids: int):
        key = left.astype(np.int64) * n_ids + right
        order = np.argsort(key)
        self._keys, self._rank, self._merged, self._n = key[order], rank[order].astype(np.int64), merged[order].astype(np.int64), n_ids

    def _lookup(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = symbols[:-1] * self._n + symbols[1:]
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank[at], _NONE), self._merged[at]

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the best-ranked pair of each word, leftmost first, until no word has a pair left.

        Returns the symbols left of all words in order and the number of each word's.
        """
        symbols = symbols.astype(np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        kept_symbols, kept_words = [], []
        while len(symbols):
            if len(symbols) > 1:
                rank, merged = self._lookup(symbols)
                rank = np.where(word[1:] == word[:-1], rank, _NONE)
            else:
                rank, merged = np.zeros(0, np.int64), np.zeros(0, np.int64)
            best = np.full(len(sizes), _NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best[word[starts]] = np.minimum.reduceat(np.append(rank, _NONE), starts)
            open_word = best[word] != _NONE
            kept_symbols.append(symbols[~open_word])
            kept_words.append(word[~open_word])
            if not open_word.any():
                break
            hit = np.append((rank == best[word[:-1]]) & (rank != _NONE), False)
            # Of a run of overlapping hits (a a a) the first, third, ... merge.
            at = np.flatnonzero(hit)
            new_run = np.concatenate([[True], np.diff(at) > 1])
            run_start = at[new_run][np.cumsum(new_run) - 1]
            at = at[(at - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = merged[at]
            keep = open_word
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        all_symbols = np.concatenate(kept_symbols) if kept_symbols else symbols
        all_words = np.concatenate(kept_words) if kept_words else word
        order = np.argsort(all_words, kind="stable")
        return all_symbols[order], np.bincount(all_words, minlength=len(sizes))


_NONE = np.int64(1) << 60
