"""For each distance kind a Euclidean space, in which balls of vectors can be left out.

By ``l2`` vectors are points as they are. By ``cosine`` they are points on the unit sphere, where a
chord tells the angle. By ``ip`` they get one more dimension that brings all of them to the length
of the longest one; a query gets a zero there, and the largest product is the nearest point. In
each of them a vector in a ball of ``radius`` around a centre is no nearer to a query than the
centre less the radius.
"""

from __future__ import annotations

import numpy as np

# Bounds are taken as smaller by this share of the sizes they are made of, which is far more than
# what rounding can change in them.
SLACK = 1e-6


def sizes(matrix: np.ndarray) -> np.ndarray:
    """Lengths of the rows, added up in one order on every machine."""
    total = np.zeros(len(matrix))
    with np.errstate(all="ignore"):
        for column in matrix.T:
            total += column * column
        return np.sqrt(total)


class Space:
    """``longest`` is the length of the longest vector, for ``ip`` only."""

    def __init__(self, metric: str, longest: float = 0.0):
        self.metric, self.longest = metric, longest

    def points(self, matrix: np.ndarray) -> np.ndarray:
        """Vectors as points; NaN where a vector has no place."""
        with np.errstate(all="ignore"):
            length = sizes(matrix)
            length = np.where(np.isfinite(length), length, np.nan)
            if self.metric == "cosine":
                return matrix / np.where(length > 0, length, np.nan)[:, None]
            if self.metric == "ip":
                rest = np.sqrt(np.maximum(self.longest**2 - length**2, 0.0))
                return np.column_stack([matrix, rest])
            return np.where(np.isnan(length)[:, None], np.nan, matrix)

    def queries(self, matrix: np.ndarray) -> np.ndarray:
        if self.metric == "ip":
            return np.column_stack([matrix, np.zeros(len(matrix))])
        return self.points(matrix)

    def reach(self, distances: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """How far from the queries' points the given distances are; infinite where undefined."""
        with np.errstate(all="ignore"):
            if self.metric == "cosine":
                found = np.sqrt(2 * np.maximum(distances, 0.0))
            elif self.metric == "ip":
                found = np.sqrt(np.maximum(sizes(queries) ** 2 + self.longest**2 - 2 * distances, 0.0))
            else:
                found = np.asarray(distances, float)
        return np.where(np.isnan(found), np.inf, found)

    def least(self, to_centre: np.ndarray, radius: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The least distance from a query to a ball's vectors; ``scale`` bounds all sizes in it.
        Balls that cannot be judged get -inf."""
        with np.errstate(all="ignore"):
            bound = to_centre - radius - SLACK * (scale + radius)
        return np.where(np.isnan(bound), -np.inf, bound)
