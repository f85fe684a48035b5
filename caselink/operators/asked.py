"""Nearest texts of a bounded number of asked texts, in one pass over all texts and without pairs in a shuffle.

The weights of the asked texts, at most ``ASKED`` of them with at most ``ENTRIES`` entries, are known to every task.
A task takes its texts one stretch after another, adds up the products of the terms that both sides have, and keeps
the ``depth`` nearest texts of each asked text so far. So what leaves a task does not depend on how many texts it read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.operators.tfidf import unlisted
from caselink.sources.scratch import shared_folder, write_table

ASKED = 4096
ENTRIES = 4_000_000
# Sums that a stretch of texts has room for, and products that are made for it at once: few enough for a core's cache.
CELLS, PRODUCTS = 1 << 21, 1 << 17
# Similarities are rounded half up to 9 places.
SCALE = 1e9
# Terms whose products are made as a matrix at most, if at least one in SHARE of the asked texts has them.
DENSE, SHARE = 512, 32


@dataclass
class Asked:
    """Weights of the asked texts by term: those of term ``i`` of ``terms`` stand from ``begins[i]`` to ``begins[i + 1]``."""

    ids: list[bytes]
    terms: pa.Array
    begins: np.ndarray
    text: np.ndarray
    weight: np.ndarray
    # Of each term, where weights are not stored.
    idf: np.ndarray | None = None


def asked_weights(lists: DataFrame, wanted: DataFrame) -> Asked | None:
    """Weights of the wanted texts; None if there are too many for a task to hold."""
    if wanted.limit(ASKED + 1).count() > ASKED:
        return None
    own = lists.join(F.broadcast(wanted.select(F.col("q_text").alias("text_id")).distinct()), "text_id", "left_semi")
    if (own.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0) > ENTRIES:
        return None
    rows = own.select("text_id", F.col("terms.term").alias("term"), F.col("terms.weight").alias("weight")).toArrow().combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    term, weight = column("term"), column("weight")
    text = np.repeat(np.arange(rows.num_rows), pc.list_value_length(term).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = term.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]).astype(np.int64)
    return Asked(column("text_id").to_pylist(), coded.dictionary, begins, text[order], weight.flatten().to_numpy(zero_copy_only=False)[order])


def asked_counts(counts: DataFrame, idf: DataFrame, wanted: DataFrame) -> Asked | None:
    """``asked_weights`` of an index that has counted terms and no weights."""
    if wanted.limit(ASKED + 1).count() > ASKED:
        return None
    sent = F.broadcast(wanted.select(F.col("q_text").alias("text_id")).distinct())
    # Written once: finding the wanted texts reads them all.
    folder = shared_folder(counts.sparkSession, "asked", uuid.uuid4().hex)
    own = write_table(counts.join(sent, "text_id", "left_semi").select("text_id", "terms"), folder)
    if (own.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0) > ENTRIES:
        return None
    rows = unlisted(own).join(idf.select("term", "idf"), "term").select("text_id", "term", "tf", "idf").toArrow().combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    number = lambda array: array.to_numpy(zero_copy_only=False)
    texts, terms = column("text_id").dictionary_encode(), column("term").dictionary_encode()
    text, code, each = number(texts.indices), number(terms.indices), number(column("idf"))
    weight = number(column("tf")) * each
    weight = weight / np.sqrt(np.bincount(text, weight * weight, len(texts.dictionary)))[text]
    of_term = np.zeros(len(terms.dictionary))
    of_term[code] = each
    order = np.argsort(code, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(of_term)))]).astype(np.int64)
    return Asked(texts.dictionary.to_pylist(), terms.dictionary, begins, text[order], weight[order], of_term)


@dataclass
class Frequent:
    """The terms that many asked texts have: the column of each term, -1 for the others, and weights by column and text."""

    column: np.ndarray
    weights: np.ndarray


def frequent_terms(asked: Asked) -> Frequent:
    n, texts_with = len(asked.ids), np.diff(asked.begins)
    terms = np.flatnonzero(texts_with >= max(2, n / SHARE))
    terms = terms[np.argsort(-texts_with[terms], kind="stable")[:DENSE]]
    column = np.full(len(texts_with), -1)
    column[terms] = np.arange(len(terms))
    of_entry = np.repeat(column, texts_with)
    weights = np.zeros((len(terms), n))
    weights[of_entry[of_entry >= 0], asked.text[of_entry >= 0]] = asked.weight[of_entry >= 0]
    return Frequent(column, weights)


class Nearest:
    """The ``depth`` nearest texts so far of each asked text, by rounded similarity and then the lowest first case.

    Products of ``frequent`` terms are made as one matrix of all texts and asked texts, those of the others one by one.
    """

    def __init__(self, asked: Asked, depth: int, frequent: Frequent | None = None):
        self.asked, self.depth, self.frequent = asked, depth, frequent
        self.least = np.full(len(asked.ids), -1.0)
        self.query, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.similarity, self.text = np.zeros(0), np.zeros(0, object)

    def add(self, ids: np.ndarray, firsts: np.ndarray, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> None:
        """Texts with ``ids``; entry i is a weight of text ``row[i]`` for the term ``code[i]`` that an asked text has."""
        n = len(self.asked.ids)
        sums = np.zeros(len(ids) * n)
        if self.frequent is not None and len(self.frequent.weights):
            column = self.frequent.column[code]
            often = column >= 0
            table = np.zeros((len(ids), len(self.frequent.weights)))
            table[row[often], column[often]] = weight[often]
            sums = (table @ self.frequent.weights).reshape(-1)
            row, code, weight = row[~often], code[~often], weight[~often]
        begins = self.asked.begins[code]
        meet = self.asked.begins[code + 1] - begins
        # A single text may have more products than are made at once.
        made = np.cumsum(meet)
        cuts = np.searchsorted(made, np.arange(PRODUCTS, (made[-1] if len(made) else 0) + PRODUCTS, PRODUCTS), "right")
        for a, b in zip(np.concatenate([[0], cuts[:-1]]).astype(int), cuts):
            if a < b:
                many = meet[a:b]
                at = np.repeat(begins[a:b] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                # Entries stand by text, so these are of a few texts next to each other.
                first, end = row[a], row[b - 1] + 1
                cell = np.repeat((row[a:b] - first) * n, many) + self.asked.text[at]
                sums[first * n : end * n] += np.bincount(cell, self.asked.weight[at] * np.repeat(weight[a:b], many), (end - first) * n)
        self._take(ids, firsts, sums.reshape(len(ids), n))

    def _take(self, ids: np.ndarray, firsts: np.ndarray, sums: np.ndarray) -> None:
        # What may round to the last similarity that counts is rounded, so few are after the first texts.
        reaching = (sums > 0) & (sums >= self.least - 1 / SCALE)
        if len(ids) > self.depth and np.count_nonzero(reaching) > 2 * self.depth * sums.shape[1]:
            last = np.partition(sums, len(ids) - self.depth, axis=0)[len(ids) - self.depth]
            reaching &= sums >= last - 2 / SCALE
        place, query = np.nonzero(reaching)
        rounded = np.floor(sums[place, query] * SCALE + 0.5) / SCALE
        counts = rounded >= self.least[query]
        place, query = place[counts], query[counts]
        self._merge(query, rounded[counts], firsts[place], ids[place])

    def _merge(self, query: np.ndarray, similarity: np.ndarray, first: np.ndarray, text: np.ndarray) -> None:
        query, similarity = np.concatenate([self.query, query]), np.concatenate([self.similarity, similarity])
        first, text = np.concatenate([self.first, first]), np.concatenate([self.text, text])
        order = np.lexsort((first, -similarity, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
        kept = order[place < self.depth]
        self.query, self.similarity, self.first, self.text = query[kept], similarity[kept], first[kept], text[kept]
        last = order[place == self.depth - 1]
        self.least[query[last]] = similarity[last]

    def rows(self) -> pa.RecordBatch:
        """(q_text, c_text, similarity) of the texts found so far."""
        ids = self.asked.ids
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[q] for q in self.query], pa.binary()),
                pa.array(self.text.tolist(), pa.binary()),
                pa.array(self.similarity, pa.float64()),
            ],
            ["q_text", "c_text", "similarity"],
        )


def stretches(batch: pa.RecordBatch, asked: Asked) -> Iterator[tuple[np.ndarray, ...]]:
    """Arguments of ``Nearest.add`` for a batch of (text_id, first_dr, term, weight), a few texts at a time."""
    term, weight = batch.column("term"), batch.column("weight").flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(term).to_numpy(zero_copy_only=False).astype(np.int64))
    code = pc.fill_null(pc.index_in(term.flatten(), value_set=asked.terms), -1).to_numpy(zero_copy_only=False)
    yield from stretches_of(batch, asked, row[code >= 0], code[code >= 0], weight[code >= 0])


def counted_stretches(batch: pa.RecordBatch, asked: Asked) -> Iterator[tuple[np.ndarray, ...]]:
    """``stretches`` for a batch of (text_id, first_dr, length, code, tf)."""
    number = lambda array: array.to_numpy(zero_copy_only=False)
    code, length = number(batch.column("code").flatten()), number(batch.column("length"))
    row = np.repeat(np.arange(batch.num_rows), number(pc.list_value_length(batch.column("code"))).astype(np.int64))
    yield from stretches_of(batch, asked, row, code, number(batch.column("tf").flatten()) * asked.idf[code] / length[row])


def stretches_of(batch: pa.RecordBatch, asked: Asked, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``stretches`` of the texts (text_id, first_dr) of a batch, whose entries are given."""
    ids = np.array(batch.column("text_id").to_pylist() + [None], object)[:-1]
    firsts = pc.fill_null(batch.column("first_dr"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    step = max(1, CELLS // max(1, len(asked.ids)))
    for a in range(0, batch.num_rows, step):
        x, y = np.searchsorted(row, [a, a + step])
        yield ids[a : a + step], firsts[a : a + step], row[x:y] - a, code[x:y], weight[x:y]


def nearest_of(lists: DataFrame, asked: Asked, depth: int) -> DataFrame:
    """(q_text, c_text, similarity): each task's ``depth`` nearest texts of each asked text, of those that share a term.

    Ties go to the lowest ``first_dr``, as in the pools, so the nearest of all texts are among them.
    """
    rows = lists.select("text_id", "first_dr", F.col("terms.term").alias("term"), F.col("terms.weight").alias("weight"))
    return _nearest(rows, asked, depth, stretches)


def nearest_counted(counts: DataFrame, lengths: DataFrame, asked: Asked, depth: int) -> DataFrame:
    """``nearest_of`` where weights are not stored: counts of asked terms, as numbers, meet the length of their text in a shuffle."""
    shared = counts.sparkSession.sparkContext.broadcast(asked.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term = batch.column("term")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(term).to_numpy(zero_copy_only=False).astype(np.int64))
            code = pc.fill_null(pc.index_in(term.flatten(), value_set=shared.value), -1).to_numpy(zero_copy_only=False)
            known = code >= 0
            begins = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[known], minlength=batch.num_rows))]), pa.int32())
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            listed = [pa.ListArray.from_arrays(begins, pa.array(x[known], pa.int32())) for x in (code, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), batch.column("first_dr"), *listed], ["text_id", "first_dr", "code", "tf"])

    rows = counts.select("text_id", "first_dr", F.col("terms.term").alias("term"), F.col("terms.tf").alias("tf"))
    coded = rows.mapInArrow(run, "text_id binary, first_dr long, code array<int>, tf array<int>").filter(F.size("code") > 0)
    return _nearest(coded.join(lengths, "text_id").select("text_id", "first_dr", "length", "code", "tf"), asked, depth, counted_stretches)


def _nearest(rows: DataFrame, asked: Asked, depth: int, cut: Callable[[pa.RecordBatch, Asked], Iterator[tuple[np.ndarray, ...]]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(shared.value, depth)
        for batch in batches:
            for stretch in cut(batch, nearest.asked):
                nearest.add(*stretch)
        yield nearest.rows()

    return rows.mapInArrow(run, "q_text binary, c_text binary, similarity double")
