"""The kernel that keeps the k nearest, without Spark, against measuring everything."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.distances import METRICS, by_dimension
from tidemark.operators.nearest import NearestSoFar, scorable

PLAIN = st.sampled_from([0.0, 1.0, -1.0, 0.5, 2.0, 1e-3, 3.0])
WILD = st.sampled_from(
    [0.0, 1.0, -1.0, 1e7, 1e7 + 1, 1e-170, 1e160, -1e160, 1e-300, float("nan"), float("inf")]
)


def everything_measured(queries, matrix, ids, k, metric):
    found = []
    sign = -1.0 if METRICS[metric] else 1.0
    for query in queries:
        exact = sign * by_dimension(matrix.T.copy(), query.reshape(-1, 1), metric)
        order = np.lexsort((ids, exact))[:k]
        found.append([(int(ids[i]), repr(float(exact[i]))) for i in order])
    return found


def kept(search, queries):
    found = [[] for _ in queries]
    for which, row, key in zip(search.which, search.ids.to_pylist(), search.keys):
        found[which].append((row, repr(float(key))))
    return found


@pytest.mark.parametrize("metric", sorted(METRICS))
@pytest.mark.parametrize("numbers", [PLAIN, WILD], ids=["plain", "wild"])
@settings(max_examples=150, deadline=None)
@given(data=st.data())
def test_kernel_keeps_what_measuring_everything_keeps(metric, numbers, data):
    length = data.draw(st.integers(1, 4))
    vector = st.lists(numbers, min_size=length, max_size=length)
    rows = np.array(data.draw(st.lists(vector, min_size=1, max_size=40)), dtype=float)
    finite = rows[np.isfinite(rows).all(axis=1)]
    queries = np.vstack([finite[:5], np.ones((1, length))])
    ids = np.array(data.draw(st.permutations(range(len(rows)))))
    k = data.draw(st.integers(1, 6))
    search = NearestSoFar(queries, k, metric)
    size = data.draw(st.integers(1, len(rows)))
    for start in range(0, len(rows), size):
        part = rows[start : start + size]
        search.add(pa.array(ids[start : start + size]), part, scorable(part, metric))
    with np.errstate(all="ignore"):
        wanted = everything_measured(queries, rows, ids, k, metric)
    assert kept(search, queries) == wanted


@pytest.mark.parametrize("metric", sorted(METRICS))
def test_many_rows_and_few_kept(metric):
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(size=(3000, 16)), np.repeat(rng.normal(size=(1, 16)), 1500, 0)])
    rows = rows[rng.permutation(len(rows))]
    ids = rng.permutation(len(rows))
    queries = np.vstack([rng.normal(size=(30, 16)), rows[:10]])
    search = NearestSoFar(queries, 7, metric)
    for start in range(0, len(rows), 700):
        part = rows[start : start + 700]
        search.add(pa.array(ids[start : start + 700]), part, scorable(part, metric))
    assert kept(search, queries) == everything_measured(queries, rows, ids, 7, metric)
