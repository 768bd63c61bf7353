"""The kernel of all vector searches: the k nearest of the vectors seen so far."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from tidemark.functions.distances import METRICS, by_dimension

# Vectors whose distances are worked out at a time.
VECTORS_AT_A_TIME = 10_000


def rounding_bound(length: int) -> float:
    """More than the relative error of any sum of products over this many dimensions."""
    return 16 * (length + 8) * float(np.finfo(np.float64).eps)


def _squared_lengths(matrix: np.ndarray) -> np.ndarray:
    """NaN where they are too large to be told apart; no comparison rules NaN out."""
    squares = (matrix * matrix).sum(axis=1)
    return np.where(np.isfinite(squares), squares, np.nan)


def _of_length_one(matrix: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt(np.where(squares < 1e-280, np.nan, squares))[:, None]


def scorable(matrix: np.ndarray, metric: str) -> np.ndarray:
    """Vectors with one more dimension, so that a product with queries gives their scores.

    A score is the larger the nearer a vector is, and errs on the near side: the rounding
    error that depends on the vector is added to it.
    """
    slack = rounding_bound(matrix.shape[1])
    with np.errstate(all="ignore"):
        squares = _squared_lengths(matrix)
        if metric == "cosine":
            return np.column_stack([_of_length_one(matrix, squares), np.zeros(len(matrix))])
        return np.column_stack(
            [matrix, (slack - 1) / 2 * squares if metric == "l2" else np.sqrt(squares)]
        )


class NearestSoFar:
    """The k nearest of all vectors added so far, for each of a few queries.

    Scores come from one matrix product, whose rounding error is bounded. They are only
    used to leave out vectors that cannot be among the k nearest. All others are measured
    exactly, so what is kept does not depend on the product or on the machine.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, kth: np.ndarray | None = None):
        """``kth`` may tell distances within which k vectors are known to lie, NaN where not."""
        self.queries, self.k, self.metric = queries, k, metric
        self.sign = -1.0 if METRICS[metric] else 1.0
        self.slack = rounding_bound(queries.shape[1])
        with np.errstate(all="ignore"):
            self.squares = _squared_lengths(queries)
            if metric == "cosine":
                scaled, last = _of_length_one(queries, self.squares), np.zeros(len(queries))
            elif metric == "ip":
                scaled, last = queries, self.slack * np.sqrt(self.squares)
            else:
                scaled, last = queries, np.ones(len(queries))
        self.scaled = np.column_stack([scaled, last])
        self.limits = np.full(len(queries), np.inf)
        if kth is not None:
            self.limits = np.where(np.isnan(kth), np.inf, self.sign * kth)
        self.which = np.empty(0, dtype=np.int64)
        self.keys = np.empty(0)
        self.ids: pa.Array | None = None

    def add(
        self, ids: pa.Array, matrix: np.ndarray, scored: np.ndarray, asked: np.ndarray | None = None
    ) -> None:
        """Vectors that all queries go by, or those with the numbers ``asked``."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        with np.errstate(all="ignore"):
            scores = self.scaled[asked] @ scored.T
        first = None
        if np.isinf(self.limits[asked]).any():
            # The rows that score best set the first limits.
            best = min(self.k, len(matrix))
            rows = np.argpartition(-scores, best - 1, axis=1)[:, :best].ravel()
            first = np.repeat(np.arange(len(scores)), best), rows
            self._measure(asked[first[0]], first[1], ids, matrix)
        # Written so that NaN counts as possible.
        possible = ~(scores < self._floors()[asked, None])
        if first is not None:
            possible[first] = False
        which, rows = np.divmod(np.flatnonzero(possible), len(matrix))
        if len(which) > 4 * self.k * len(asked):
            # Many equal vectors: of those only the k lowest ids can ever be kept.
            alive = _lowest_ids_of_copies(matrix, ids, self.k)[rows]
            which, rows = which[alive], rows[alive]
        self._measure(asked[which], rows, ids, matrix)

    def _floors(self) -> np.ndarray:
        """The score below which a vector is certainly farther than the kth kept one."""
        if self.metric == "l2":
            near = self.limits * self.limits * (1 + self.slack)
            return (self.squares * (1 - self.slack) - near) / 2
        if self.metric == "ip":
            return -self.limits
        return 1 - self.slack - self.limits

    def _measure(
        self, which: np.ndarray, rows: np.ndarray, ids: pa.Array, matrix: np.ndarray
    ) -> None:
        for start in range(0, len(which), VECTORS_AT_A_TIME):
            part = slice(start, start + VECTORS_AT_A_TIME)
            left = np.ascontiguousarray(matrix[rows[part]].T)
            right = np.ascontiguousarray(self.queries[which[part]].T)
            exact = self.sign * by_dimension(left, right, self.metric)
            self._keep(which[part], exact, ids.take(pa.array(rows[part])))

    def _keep(self, which: np.ndarray, keys: np.ndarray, ids: pa.Array) -> None:
        which = np.concatenate([self.which, which])
        keys = np.concatenate([self.keys, keys])
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        order = np.lexsort((_places(ids), keys, which))  # NaN keys sort last
        which = which[order]
        first = np.searchsorted(which, which, side="left")
        best = np.arange(len(which)) - first < self.k
        self.which, self.keys = which[best], keys[order][best]
        self.ids = ids.take(pa.array(order[best]))
        full, counts = np.unique(self.which, return_counts=True)
        last = np.cumsum(counts) - 1
        worst = self.keys[last[counts == self.k]]
        self.limits[full[counts == self.k]] = np.where(np.isnan(worst), np.inf, worst)

    def kth(self) -> np.ndarray:
        """The distance of each query's kth nearest; NaN where k are not known."""
        return self.sign * np.where(np.isfinite(self.limits), self.limits, np.nan)

    def distances(self) -> pa.Array:
        return pa.array(self.sign * self.keys, from_pandas=True)


def _places(ids: pa.Array) -> np.ndarray:
    """Numbers that sort as the ids do."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    return pd.Series(ids.to_numpy(zero_copy_only=False)).rank(method="dense").to_numpy()


def _lowest_ids_of_copies(matrix: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Marks, of every set of equal rows, the k with the lowest ids."""
    order = np.argsort(_places(ids), kind="stable")
    sorted_rows = np.ascontiguousarray(matrix[order])
    as_bytes = sorted_rows.view(np.dtype((np.void, sorted_rows.shape[1] * 8))).ravel()
    _, copies = np.unique(as_bytes, return_inverse=True)
    alive = np.empty(len(order), dtype=bool)
    alive[order] = pd.Series(copies).groupby(copies).cumcount().to_numpy() < k
    return alive
