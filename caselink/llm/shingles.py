"""Word shingles as column expressions and as arrays inside a task.

Words are the runs of characters other than blank and U+0009-U+000D in a text whose A-Z are lower-cased. A
text's set is its distinct runs of five words; with fewer words the whole sequence is the one shingle, and
without words the set is empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, "[\\x20\\x09-\\x0D]+"), "")


def word_sequence(text: str) -> bytes:
    """The words of a text with one blank between them, in UTF-8."""
    return b" ".join(text.encode().lower().split())


def sequence_shingles(sequence: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of a word sequence's shingles, sorted.

    A polynomial hash of each word, by differences of one running sum over the sequence, is folded over
    five neighbours; equal shingles have equal hashes and different ones differ but for chance of 2^-64.
    """
    if not sequence:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(sequence, np.uint8)
    ends = np.append(np.flatnonzero(codes == 32), len(codes))
    begins = np.concatenate([[0], ends[:-1] + 1])
    power = _powers(int((ends - begins).max()) + 1)
    within = np.arange(len(codes)) - np.repeat(begins, ends - begins + 1)[: len(codes)]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[within], dtype=np.uint64)])
    word = mix(sums[ends] - sums[begins] + (ends - begins).astype(np.uint64) * _ODD)
    n = len(word)
    run = word[: max(1, n - WORDS + 1)].copy()
    for k in range(1, min(WORDS, n)):
        run = mix(run * _ODD + word[k : k + len(run)])
    return np.unique(run)


_POWER = [np.array([1], np.uint64)]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, at least ``n``."""
    if len(_POWER[0]) < n:
        _POWER[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
    return _POWER[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
