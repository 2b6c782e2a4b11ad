"""Leaked passages whose errors stand close together."""

import itertools

import numpy as np

from cellarflow.llm.leaks import EvalIndex


def found(size, texts):
    index = EvalIndex(np.arange(10, 10 + size, dtype=np.uint64), np.array([0, size], np.int64))
    flat = np.array([w for t in texts for w in t], np.uint64)
    return set(index.matches(flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))[0].tolist())


def replaced(size, wrong):
    return [1000 + i if i in wrong else 10 + i for i in range(size)]


def test_three_errors_anywhere():
    for size in (24, 25, 26):
        texts = [replaced(size, wrong) for wrong in itertools.combinations(range(1, size - 1), 3)]
        assert len(found(size, texts)) == len(texts)


def test_four_errors_in_a_row():
    texts = [replaced(32, range(14, 18)), [w for w in replaced(32, ()) if not 24 <= w < 28], replaced(32, range(14, 19)), replaced(24, range(9, 13))]
    assert found(32, texts) == {0, 1}
