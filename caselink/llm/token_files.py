"""Token ids of whole texts in flat binary files with 64-bit document offsets, read through memory maps.

Documents are dealt over ranges of ascending id and sorted, so that the files in the order of their
partitions hold all ids in document order. Each task writes, for its partition,

    part-<partition>-<attempt>.bin   token ids, nothing else: unsigned little-endian integers of ``width`` bytes,
                                     2 if the vocabulary has at most 65,536 ids, else 4
    part-<partition>-<attempt>.off   n + 1 offsets of the documents within the .bin file, unsigned 64-bit
    part-<partition>-<attempt>.doc   the n document ids, signed 64-bit

and reports one row. Only files of reported attempts count, so a lost or repeated task leaves nothing but
an unread file. The index adds the base of each partition, the prefix sum of the ids before it.

Edge cases: null or empty text gives the end id alone; rows with a null id come first and are counted in
the index, in place of an id of their own; repeated ids keep all their rows, ordered by text; an empty
table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.llm.common import WordStore, file_system, id_and_text, one_model, pieces, ranges, run_folder, slices, stored

END_ID = 1
_INDEX = "part int, file string, width int, n_docs long, n_null long, n_ids long"
_JOINT = 1000
_ASCII_LETTER, _ASCII_MARK = np.zeros(256, bool), np.zeros(256, bool)
_ASCII_LETTER[97:123] = True
_ASCII_MARK[33:127] = True
_ASCII_MARK[97:123] = False
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[32, *range(9, 14)]] = True


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once.

    The vocabulary in ``path`` drops white space, ignores case and ends a word after a letter that a digit
    or mark follows, so a text's ids are those of its words. Words are cut at ASCII white space and, unless
    the text may hold special strings, between an ASCII letter and an ASCII mark or digit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._specials = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._joint = self._specials[-1] if self._specials else None
        self._store = WordStore(self._encode_words)
        self.width = 2 if self._library.get_vocab_size() <= 1 << 16 else 4

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        ids, sizes = [], []
        plain = np.array([self._joint is not None and "<" not in t for t in texts])
        # Plain words go to the library many at a time, with its own special string between them.
        order = np.argsort(~plain, kind="stable")
        n_plain = int(plain.sum())
        if n_plain:
            end = self._library.token_to_id(self._joint)
            groups = [[texts[i] for i in order[k : min(k + _JOINT, n_plain)]] for k in range(0, n_plain, _JOINT)]
            for code in self._library.encode_batch_fast([self._joint.join([*g, ""]) for g in groups], add_special_tokens=False):
                found = np.array(code.ids, np.int64)
                ends = np.flatnonzero(found == end)
                sizes.append(np.diff(np.concatenate([[-1], ends])) - 1)
                ids.append(found[found != end])
        for i in order[n_plain:]:
            found = np.array(self._library.encode(texts[i], add_special_tokens=False).ids, np.int64)
            ids.append(found)
            sizes.append(np.array([len(found)]))
        flat, size = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])
        # Back to the order of ``words``.
        begins = np.concatenate([[0], np.cumsum(size)])[:-1]
        back = np.argsort(order, kind="stable")
        return flat[ranges(begins[back], size[back])], size[back]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and each text's number of ids."""
        raws, owners, special = [], [], []
        for i, text in enumerate(texts):
            for piece in pieces(text):
                special.append(any(s in piece for s in self._specials))
                raws.append(piece.encode() if special[-1] else piece.encode().lower())
                owners.append(i)
        if not raws:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # A blank ends each piece.
        codes = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        cuts = np.flatnonzero(_ASCII_LETTER[codes[:-1]] & _ASCII_MARK[codes[1:]]) + 1
        if any(special):
            cuts = cuts[~np.array(special)[np.searchsorted(ends, cuts, "right")]]
        if len(cuts):
            codes = np.insert(codes, cuts, 32)
            ends = ends + np.searchsorted(cuts, ends)
        inside = ~_ASCII_SPACE[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate([[0], edges]) if inside[0] else edges
        begins, sizes = edges[::2], edges[1::2] - edges[::2]
        counts = np.bincount(np.array(owners)[np.searchsorted(ends, begins, "right")], minlength=len(texts))
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(codes[inside])])
        return self._store.ids(words, counts)


def encoder(path: str) -> WordEncoder:
    return one_model(("encoder", path), lambda: WordEncoder(path))


def write_token_files(
    docs: DataFrame,
    path: str,
    folder: str,
    end_id: int = END_ID,
    partitions: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode ``docs`` into files below ``folder``; returns the index: part, file, width, n_docs, n_null, n_ids, base."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    deal = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    write = _writer(path, folder, end_id)
    index = stored(deal.sortWithinPartitions("doc_id", "text").mapInArrow(write, _INDEX), folder, "parts")
    # One row a partition: the prefix sum is a driver's few numbers.
    parts = sorted(index.collect(), key=lambda r: r["part"])
    bases = np.concatenate([[0], np.cumsum([r["n_ids"] for r in parts])]).astype(np.int64)
    table = [(*r, int(b)) for r, b in zip(parts, bases)]
    return stored(spark.createDataFrame(table, _INDEX + ", base long"), folder, "index")


def _writer(path: str, folder: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        words, name = encoder(path), f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        offsets, n_docs, n_null = [0], 0, 0
        opened = None
        for batch, texts in slices(batches):
            if opened is None:
                system, root = file_system(f"{folder}/ids")
                system.create_dir(root, recursive=True)
                opened = [system.open_output_stream(f"{root}/{name}.{kind}") for kind in ("bin", "doc", "off")]
                opened[2].write(np.zeros(1, "<u8").tobytes())
            ids, sizes = words.encode(texts)
            ends = np.cumsum(sizes)
            opened[0].write(np.insert(ids, ends, end_id).astype(f"<u{words.width}").tobytes())
            opened[2].write((np.cumsum(sizes + 1) + offsets[-1]).astype("<u8").tobytes())
            offsets[-1] += int(sizes.sum()) + len(sizes)
            column = batch.column("doc_id")
            n_null += column.null_count
            opened[1].write(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs += len(texts)
        if opened is not None:
            for stream in opened:
                stream.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": task.partitionId(), "file": f"{folder}/ids/{name}", "width": words.width, "n_docs": n_docs, "n_null": n_null, "n_ids": offsets[-1]}],
                schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())]),
            )

    return run


class TokenFile:
    """One partition's files: document ids and offsets in memory, token ids mapped."""

    def __init__(self, file: str, width: int):
        system, path = file_system(file)
        self._width = width
        self.doc_ids, self.offsets = self._read(system, f"{path}.doc", "<i8"), self._read(system, f"{path}.off", "<u8")
        self._mapped = np.memmap(f"{path}.bin", f"<u{width}", "r") if system.type_name == "local" else None
        self._remote = None if self._mapped is not None else system.open_input_file(f"{path}.bin")

    @staticmethod
    def _read(system, path: str, kind: str) -> np.ndarray:
        with system.open_input_stream(path) as f:
            return np.frombuffer(f.read(), kind)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        if self._mapped is not None:
            return self._mapped[a:b]
        self._remote.seek(self._width * a)
        return np.frombuffer(self._remote.read(self._width * (b - a)), f"<u{self._width}")


def read_token_files(index: DataFrame, documents: int = 5000) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of every document, one task per few files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["file"], row["width"])
                for k in range(0, len(file), documents):
                    at = range(k, min(k + documents, len(file)))
                    begins = file.offsets[k : at.stop].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[k : at.stop], pa.int64(), mask=np.arange(k, at.stop) < row["n_null"]),
                            pa.array(begins + row["base"], pa.int64()),
                            pa.array(file.offsets[k + 1 : at.stop + 1].astype(np.int64) - begins, pa.int64()),
                            pa.array([zlib.crc32(file.tokens(i).astype("<u4").tobytes()) for i in at], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, index.sparkSession.sparkContext.defaultParallelism * 2)
    return index.repartition(n, F.col("part")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Write the files of ``docs`` into a new shared folder and read them back."""
    return read_token_files(write_token_files(docs, path, run_folder(spark, "token_files")))
