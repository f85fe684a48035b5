"""Sums of asked texts: products of frequent terms as a matrix, those of the others a few texts at a time."""

import numpy as np
import pyarrow as pa
import pytest

from caselink.operators import asked


def postings(weights):
    """``Asked`` of a matrix of texts by terms."""
    n, terms = weights.shape
    text, code = np.nonzero(weights)
    order = np.argsort(code, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=terms))]).astype(np.int64)
    return asked.Asked([bytes([i]) for i in range(n)], pa.array([str(i) for i in range(terms)]), begins, text[order], weights[text, code][order])


def random_weights(rng, n, terms):
    often = np.where(np.arange(terms) < 6, 0.7, 0.04)
    found = np.where(rng.random((n, terms)) < often, rng.random((n, terms)), 0.0)
    found[0] = 0
    length = np.sqrt((found * found).sum(axis=1, keepdims=True))
    return found / np.where(length, length, 1)


@pytest.mark.parametrize("products, dense", [(1 << 17, 512), (5, 512), (5, 3), (40, 0)])
def test_nearest_by_matrix_and_one_by_one(monkeypatch, products, dense):
    monkeypatch.setattr(asked, "PRODUCTS", products)
    monkeypatch.setattr(asked, "DENSE", dense)
    rng = np.random.default_rng(products + dense)
    texts, others = random_weights(rng, 40, 120), random_weights(rng, 90, 120)
    # Ties go to the lowest first case.
    others[50:60] = others[20:30]
    firsts = rng.permutation(90)
    ids = np.array([b"%d" % i for i in range(90)], object)
    known = postings(texts)
    frequent = asked.frequent_terms(known)
    assert len(frequent.weights) <= dense and (dense == 0 or len(frequent.weights) >= 3)
    # The most frequent ones are those made as a matrix.
    if dense == 3:
        least = min(np.count_nonzero(texts, axis=0)[np.flatnonzero(frequent.column >= 0)])
        assert least >= max(np.count_nonzero(texts, axis=0)[np.flatnonzero(frequent.column < 0)])
    expected = set()
    rounded = np.floor(others @ texts.T * asked.SCALE + 0.5) / asked.SCALE
    for q in range(40):
        order = sorted((c for c in range(90) if rounded[c, q] > 0), key=lambda c: (-rounded[c, q], firsts[c]))
        expected |= {(q, c) for c in order[:7]}
    for several in (None, frequent):
        nearest = asked.Nearest(known, 7, several)
        for a in range(0, 90, 30):
            row, code = np.nonzero(others[a : a + 30])
            nearest.add(ids[a : a + 30], firsts[a : a + 30], row, code, others[a : a + 30][row, code])
        found = nearest.rows()
        got = set(zip([q[0] for q in found.column("q_text").to_pylist()], [int(c) for c in found.column("c_text").to_pylist()]))
        assert got == expected
        for q, c, s in zip(*[found.column(i).to_pylist() for i in range(3)]):
            assert s == pytest.approx(rounded[int(c), q[0]], abs=1.1e-9)
