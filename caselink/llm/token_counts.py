"""Token counts of whole texts by the whole-token shortcut.

When a worker loads the vocabulary it proves, by merging every vocabulary string, which of them encode
alone as exactly one token. Pre-tokens that are such strings count one without any work; only the other
distinct pre-tokens are merged, many at once, and remembered for a while.

Edge cases: null or empty text has 0 tokens; a text holding the special string counts it as one token, as
the library does by default; repeated rows and null ids each keep their row; very long texts are cut at
places where a pre-token must end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from caselink.llm.common import PairMerges, id_and_text, one_model, pieces, slices

REMEMBERED = 400_000
_BLANKS = "".join(map(chr, [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
# Fixed value: how a byte-level vocabulary splits text before merging.
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANKS}\p{{L}}\p{{N}}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else 256 and up."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    letters = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class TokenCounter:
    """Counts tokens of texts as the byte-level vocabulary in ``path`` encodes them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        n_ids = max(vocab.values()) + 1
        self._merges = PairMerges(left, right, np.arange(len(pairs)), merged, n_ids)
        self._byte_ids = np.array([vocab[c] for c in letters], np.int64)
        self._split = regex.compile(_PATTERN)
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self._special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self._marks = specials
        self.whole = self._prove(vocab, byte_of, set(specials))
        self._known: dict[str, int] = dict.fromkeys(self.whole, 1)

    def _prove(self, vocab: dict[str, int], byte_of: dict[str, int], specials: set[str]) -> list[str]:
        """Vocabulary strings that are one pre-token and merge into one token."""
        found = []
        for token in vocab:
            if token in specials or not all(c in byte_of for c in token):
                continue
            try:
                text = bytes(byte_of[c] for c in token).decode()
            except UnicodeDecodeError:
                continue
            if self._split.findall(text) == [text]:
                found.append(text)
        return [text for text, n in zip(found, self._merged_counts(found)) if n == 1]

    def _merged_counts(self, words: list[str]) -> list[int]:
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self._byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return self._merges.merge(symbols, sizes)[1].tolist()

    def _segments(self, text: str) -> tuple[list[str], int]:
        if not any(mark in text for mark in self._marks):
            return [text], 0
        segments = self._special.split(text)
        return segments, len(segments) - 1

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        words_of, totals = [], []
        for text in texts:
            segments, specials = self._segments(text)
            words = []
            for segment in segments:
                for piece in pieces(segment):
                    words += self._split.findall(piece)
            words_of.append(words)
            totals.append(specials)
        seen = set().union(*words_of)
        new = list(seen.difference(self._known))
        if len(self._known) + len(new) > REMEMBERED + len(self.whole):
            self._known = dict.fromkeys(self.whole, 1)
            new = list(seen.difference(self._known))
        self._known.update(zip(new, self._merged_counts(new)))
        known = self._known.__getitem__
        return [n + sum(map(known, words)) for n, words in zip(totals, words_of)]


def counter(path: str) -> TokenCounter:
    return one_model(("counter", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch, texts in slices(batches):
            n = tokens.count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
