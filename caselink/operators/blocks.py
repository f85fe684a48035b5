"""Nearest texts of all texts: blocks of texts meet inside tasks, so no pair of texts is shuffled or stored.

Where most texts share some term with most others, the sums of all pairs are quadratic by nature. Here only their
working is: a task has one block of asked texts, takes all blocks of texts one after another and keeps the ``depth``
nearest of each asked text so far (``asked.Nearest``). What is written is each text's weights twice, as the blocks and
as the asked ones, and ``depth`` rows of an asked text; what a task holds is two blocks and those rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.operators.asked import Asked, Nearest, frequent_terms, stretches_of
from caselink.sources.scratch import shared_folder, write_table

# Texts of a block, and entries after which it ends: the last text of a block is whole.
TEXTS, ENTRIES = 1024, 1 << 19

_BLOCK = "texts binary, terms binary"


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def text_blocks(lists: DataFrame) -> DataFrame:
    """(texts, terms): blocks of the texts of ``lists``, made where they lie; a block has its own dictionary of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("term")).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(sizes) - sizes
            a = 0
            while a < batch.num_rows:
                b = min(a + TEXTS, max(a + 1, int(np.searchsorted(before, before[a] + ENTRIES))))
                part = batch.slice(a, b - a)
                coded = part.column("term").flatten().dictionary_encode()
                begins = pa.array(np.concatenate([[0], np.cumsum(sizes[a:b])]), pa.int32())
                listed = [pa.ListArray.from_arrays(begins, x) for x in (coded.indices, part.column("weight").flatten())]
                texts = pa.RecordBatch.from_arrays([part.column("text_id"), part.column("first_dr"), *listed], ["text_id", "first_dr", "code", "weight"])
                terms = pa.RecordBatch.from_arrays([coded.dictionary], ["term"])
                yield pa.RecordBatch.from_arrays([pa.array([_packed(x)], pa.binary()) for x in (texts, terms)], ["texts", "terms"])
                a = b

    rows = lists.select("text_id", "first_dr", F.col("terms.term").alias("term"), F.col("terms.weight").alias("weight"))
    return rows.mapInArrow(run, _BLOCK)


def _entries(texts: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term of the block's dictionary and weight of each entry."""
    number = lambda array: array.to_numpy(zero_copy_only=False)
    code = texts.column("code")
    row = np.repeat(np.arange(texts.num_rows), number(pc.list_value_length(code)).astype(np.int64))
    return row, number(code.flatten()), number(texts.column("weight").flatten())


def _asked(texts: pa.RecordBatch, terms: pa.Array) -> Asked:
    row, code, weight = _entries(texts)
    order = np.argsort(code, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(terms)))]).astype(np.int64)
    return Asked(texts.column("text_id").to_pylist(), terms, begins, row[order], weight[order])


def nearest_in_blocks(lists: DataFrame, wanted: DataFrame | None, depth: int) -> DataFrame:
    """(q_text, c_text, similarity): the ``depth`` nearest texts of each asked text, of those that share a term; None asks for all.

    Similarities are rounded and ties go to the lowest ``first_dr``, as in ``asked``. With few blocks of asked texts,
    those of all texts are dealt over several tasks, each of which gives its ``depth`` nearest.
    """
    spark = lists.sparkSession
    folder = shared_folder(spark, "blocks", uuid.uuid4().hex)
    blocks = write_table(text_blocks(lists), f"{folder}/texts")
    own = blocks if wanted is None else write_table(text_blocks(lists.join(wanted.withColumnRenamed("q_text", "text_id"), "text_id", "left_semi")), f"{folder}/asked")
    n = max(1, own.count())
    asked = own.select(F.monotonically_increasing_id().alias("number"), F.col("texts").alias("q_texts"), F.col("terms").alias("q_terms"))
    # A task for each block of asked texts; the blocks of all texts are read by each of them.
    tasks = math.ceil(2 * spark.sparkContext.defaultParallelism / n)
    pairs = blocks.coalesce(tasks).crossJoin(asked.repartitionByRange(n, "number").hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Nearest] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                number = value("number")
                if number not in found:
                    asked = _asked(_unpacked(value("q_texts")), _unpacked(value("q_terms")).column("term"))
                    found[number] = Nearest(asked, depth, frequent_terms(asked))
                nearest = found[number]
                texts, terms = _unpacked(value("texts")), _unpacked(value("terms")).column("term")
                known = pc.fill_null(pc.index_in(terms, value_set=nearest.asked.terms), -1).to_numpy(zero_copy_only=False)
                place, code, weight = _entries(texts)
                code = known[code]
                met = code >= 0
                for stretch in stretches_of(texts, nearest.asked, place[met], code[met], weight[met]):
                    nearest.add(*stretch)
        for nearest in found.values():
            yield nearest.rows()

    return pairs.mapInArrow(run, "q_text binary, c_text binary, similarity double")
