"""SentencePiece encoding and decoding by suffix-array matching.

Blanks become the mark U+2581 and one mark is put before a text. No piece of the vocabulary holds a mark
after another character, none holds a line end, and none goes on from a letter to a digit or an ASCII sign
(a loader proves which signs hold to that). So texts are cut there; each distinct word is encoded once. A
slice's new words are put one after another into one array of code points, and

1. a suffix array of it is built by doubling, up to the length of the longest piece,
2. every piece's range of occurrences in it is found by binary search, for all pieces at once,
3. the occurrences are the edges of a lattice; they are sorted by where they end,
4. the edges are relaxed position by position, for all words at once: of the edges that end at a position,
   the one counts whose piece follows the last piece of the prefix before it.

For merges by rank a segmentation is the encoding exactly if each two neighbours stay apart when their
joined text is encoded, and every prefix has one such segmentation; so each position has exactly one last
piece. Which pairs stay apart is found by merging their joined text once and remembered. A
character outside the vocabulary is an edge of its own and becomes its UTF-8 bytes' pieces.

Edge cases: null or empty text has no id; a text with marks of its own reads back with blanks for them, as
in the library; rows with equal or null ids each keep their row; very long texts are cut between words.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caselink.llm.common import PairMerges, WordStore, id_and_text, one_model, pieces, ranges, slices, tidy

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_SEPARATOR = 0x110000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            size = number()
            at += size
            yield key >> 3, data[at - size : at]
        else:
            size = 4 if key & 7 == 5 else 8
            at += size
            yield key >> 3, struct.unpack("<f" if size == 4 else "<d", data[at - size : at])[0]


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id of a model file."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, _NORMAL)))
    return out


def _word_pattern(normal: list[str]) -> re.Pattern:
    """Cuts a text where no piece can lie across: before marks, around line ends, and before closed signs.

    A sign is closed if within pieces it only ever follows a mark or a closed sign.
    """
    closed = {chr(c) for c in range(33, 127) if not chr(c).isalpha()}
    neighbours = {(p[i], p[i + 1]) for p in normal for i in range(len(p) - 1)}
    while broken := {b for a, b in neighbours if b in closed and a != MARK and a not in closed}:
        closed -= broken
    signs = "".join(map(re.escape, sorted(closed)))
    runs = f"{MARK}*[{signs}]+[^{MARK}\n{signs}]*|" if closed else ""
    return re.compile(f"{MARK}*[^{MARK}\n{signs}]+|{runs}{MARK}+|\n")


class Codec:
    """Encodes and decodes texts with the vocabulary of a merge model with byte pieces and no normalisation."""

    def __init__(self, path: str):
        model = read_model(path)
        self._n = len(model)
        self._byte0 = next(i for i, (_, _, kind) in enumerate(model) if kind == _BYTE)
        self._bytes = [
            bytes([int(p[3:5], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else p.replace(MARK, " ").encode() for p, _, kind in model
        ]
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(model) if kind == _NORMAL]
        id_of = {p: i for p, _, i in normal}
        for p, _, _ in normal:
            if MARK in p.lstrip(MARK) or "\n" in p or not all(c in id_of for c in p):
                raise ValueError(f"piece {p!r} does not end with its word or has a character that is no piece")
        self._word = _word_pattern([p for p, _, _ in normal])
        self._longest = max(len(p) for p, _, _ in normal)
        order = sorted(normal, key=lambda x: x[0])
        self._piece_ids = np.array([i for _, _, i in order], np.int32)
        self._piece_sizes = np.array([len(p) for p, _, _ in order], np.int32)
        codes = np.full((len(order), self._longest), -1, np.int32)
        for row, (p, _, _) in zip(codes, order):
            row[: len(p)] = [ord(c) for c in p]
        self._piece_codes = codes
        # All pairs of pieces that join into a piece; a higher score merges first.
        by_score = {p: r for r, (p, _, _) in enumerate(sorted(normal, key=lambda x: -x[1]))}
        joins = [(id_of[p[:k]], id_of[p[k:]], by_score[p], i) for p, _, i in normal for k in range(1, len(p)) if p[:k] in id_of and p[k:] in id_of]
        self._merges = PairMerges(*(np.array(c, np.int64) for c in zip(*joins)), self._n + 1)
        text_of = {i: p for p, _, i in normal}
        self._char_ids = [np.array([id_of[c] for c in text_of.get(i, "")], np.int64) for i in range(self._n)]
        # Pairs of neighbours judged so far: sorted keys and verdicts. Id n stands for a character outside the vocabulary.
        self._pairs, self._apart = np.zeros(0, np.int64), np.zeros(0, bool)
        self._store = WordStore(self._encode_words)

    # --- matching ---

    def _suffixes(self, text: np.ndarray) -> np.ndarray:
        """Positions of ``text`` in the order of the suffixes there, compared up to the longest piece."""
        _, rank = np.unique(text, return_inverse=True)
        rank, step = rank.astype(np.int64) + 1, 1
        while True:
            later = np.zeros(len(rank), np.int64)
            later[:-step] = rank[step:]
            key = rank * (rank.max() + 1) + later
            order = np.argsort(key)
            step *= 2
            if step >= self._longest:
                return order
            sorted_key = key[order]
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))

    def _occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, piece id) of every occurrence of every piece in ``text``."""
        order = self._suffixes(text)
        padded = np.concatenate([text, np.full(self._longest, -1, np.int32)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, self._longest)
        width = np.arange(self._longest)[None] < self._piece_sizes[:, None]

        def bound(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self._piece_ids), np.int64), np.full(len(self._piece_ids), len(order))
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    return low
                middle = (low[open_] + high[open_]) // 2
                wanted = self._piece_codes[open_]
                differs = (windows[order[middle]] != wanted) & width[open_]
                first = differs.argmax(1)
                rows = np.arange(len(open_))
                equal = ~differs[rows, first]
                less = windows[order[middle], first] < wanted[rows, first]
                right = np.where(equal, after, less)
                low[open_] = np.where(right, middle + 1, low[open_])
                high[open_] = np.where(right, high[open_], middle)

        low, high = bound(False), bound(True)
        counts = high - low
        begins = order.astype(np.int32)[ranges(low, counts)]
        return begins, np.repeat(self._piece_sizes, counts), np.repeat(self._piece_ids, counts)

    # --- neighbours ---

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self._n + 1) + right
        new = np.unique(key)
        if len(self._pairs):
            at = np.minimum(np.searchsorted(self._pairs, new), len(self._pairs) - 1)
            new = new[self._pairs[at] != new]
        if len(new):
            self._judge(new)
        return self._apart[np.searchsorted(self._pairs, key)]

    def _judge(self, keys: np.ndarray) -> None:
        left, right = keys // (self._n + 1), keys % (self._n + 1)
        outside = (left == self._n) | (right == self._n)
        verdict = outside.copy()
        inner = np.flatnonzero(~outside)
        if len(inner):
            words = [np.concatenate([self._char_ids[a], self._char_ids[b]]) for a, b in zip(left[inner], right[inner])]
            ids, sizes = self._merges.merge(np.concatenate(words), np.array([len(w) for w in words]))
            begins = np.cumsum(sizes) - sizes
            two = sizes == 2
            good = np.zeros(len(inner), bool)
            good[two] = (ids[begins[two]] == left[inner][two]) & (ids[begins[two] + 1] == right[inner][two])
            verdict[inner] = good
        at = np.searchsorted(self._pairs, keys)
        self._pairs, self._apart = np.insert(self._pairs, at, keys), np.insert(self._apart, at, verdict)

    # --- words ---

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(words)
        text = np.frombuffer(joined.encode("utf-32-le"), np.int32).copy()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes + 1) - sizes - 1
        text[begins[1:] - 1] = _SEPARATOR
        edge_begin, edge_size, edge_id = self._occurrences(text)
        # Characters that no piece covers alone are edges too.
        known = np.zeros(len(text), bool)
        known[edge_begin[edge_size == 1]] = True
        known[begins[1:] - 1] = True
        other = np.flatnonzero(~known)
        edge_begin = np.concatenate([edge_begin, other.astype(np.int32)])
        edge_size = np.concatenate([edge_size, np.ones(len(other), np.int32)])
        edge_id = np.concatenate([edge_id, np.full(len(other), self._n, np.int32)])

        word_begin = np.repeat(begins.astype(np.int32), sizes + 1)[: len(text)]
        offset = edge_begin + edge_size - word_begin[edge_begin]
        order = np.argsort(offset.astype(np.int64) * (len(text) + 1) + edge_begin)
        edge_begin, edge_size, edge_id, offset = edge_begin[order], edge_size[order], edge_id[order], offset[order]
        first = edge_begin == word_begin[edge_begin]
        last = np.full(len(text) + 1, -1, np.int64)  # last piece of the prefix that ends before a position
        step = np.zeros(len(text) + 1, np.int64)
        bounds = np.searchsorted(offset, np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            left = last[edge_begin[a:b]]
            good = first[a:b].copy()
            inner = np.flatnonzero(~good & (left >= 0))
            good[inner] = self._stay_apart(left[inner], edge_id[a:b][inner])
            at = np.flatnonzero(good) + a
            end = edge_begin[at] + edge_size[at]
            last[end], step[end] = edge_id[at], edge_size[at]

        # Back from the end of every word.
        at, owner = begins + sizes, np.arange(len(words))
        found_ids, found_words, found_at = [], [], []
        while len(at):
            found_ids.append(last[at])
            found_words.append(owner)
            found_at.append(at)
            at = at - step[at]
            more = at > begins[owner]
            at, owner = at[more], owner[more]
        ids, owner, ends = (np.concatenate(x) for x in (found_ids, found_words, found_at))
        order = np.argsort(ends)
        ids, owner, ends = ids[order], owner[order], ends[order]
        counts = np.bincount(owner, minlength=len(words))
        outside = np.flatnonzero(ids == self._n)
        if len(outside):
            raw = [chr(c).encode() for c in text[ends[outside] - 1]]
            widths = np.ones(len(ids), np.int64)
            widths[outside] = [len(r) for r in raw]
            counts = np.bincount(owner, widths, minlength=len(words)).astype(np.int64)
            begins_out = np.cumsum(widths) - widths
            ids = np.repeat(ids, widths)
            ids[ranges(begins_out[outside], widths[outside])] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + self._byte0
        return ids, counts

    # --- texts ---

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and each text's number of ids."""
        words, counts = [], []
        for text in texts:
            n = 0
            for k, piece in enumerate(pieces(text) if text else ()):
                found = self._word.findall((MARK if k == 0 else "") + piece.replace(" ", MARK))
                words += found
                n += len(found)
            counts.append(n)
        return self._store.ids(words, np.array(counts, np.int64))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 read as U+FFFD."""
        raw = b"".join(map(self._bytes.__getitem__, ids))
        return raw.removeprefix(b" ").decode(errors="replace")


def codec(path: str) -> Codec:
    return one_model(("codec", path), lambda: Codec(path))


def encoded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers), decoded_chars, decoded_sha256; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch, texts in slices(batches):
            ids, sizes = coder.encode(texts)
            ends = np.cumsum(sizes)
            parts = np.split(ids.astype("<u4"), ends[:-1])
            back = [coder.decode(p.tolist()) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                    pa.array([len(t) for t in back], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "decoded_sha256"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, decoded_sha256 string"
    )


def with_token_ids(docs: DataFrame, path: str, text_col: str = "text", name: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text as an array column ``name``, in place of one of that name; no shuffle."""
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for whole in batches:
            keyed = whole.rename_columns([f"_{i}" for i in range(whole.num_columns)]).append_column("text", whole.column(whole.schema.names.index(text_col)))
            for batch, texts in slices([keyed]):
                ids, sizes = coder.encode(texts)
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                arrays = pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], arrays], [*whole.schema.names, name])

    fields = [*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]
    return docs.mapInArrow(tidy(run, keeps_model=True), T.StructType(fields))


def with_decoded(encoded: DataFrame, path: str, ids_col: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its id arrays as column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [None if ids is None else coder.decode(ids) for ids in part.column(part.schema.names.index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, name])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())]))
