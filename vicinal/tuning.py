"""Search for good index parameters by recall."""

from __future__ import annotations

import time
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from vicinal.errors import VicinalError
from vicinal.operators.index import ApproxKNN
from vicinal.options import HashFamily, LshOptions


def primes(low: int, high: int) -> list[int]:
    """Primes from low to high, by a sieve."""
    sieve = np.ones(high + 1, bool)
    sieve[:2] = False
    for i in range(2, int(high**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return [int(p) for p in np.flatnonzero(sieve) if p >= low]


class Space:
    """The usual ranges of a family's parameters, as points of the unit cube; table sizes are primes."""

    def __init__(self, family: HashFamily | str, n: int):
        self.family, self.sizes = HashFamily.parse(family), primes(1000, 200_000)
        low, high = (max(2, n // 4096), max(3, n // 64)) if self.family is HashFamily.MIXED else (6, 128)
        self.ranges = [(256, 4096), (4, 512), (4, 512), (0, len(self.sizes) - 1), (1, 100), (low, high)]

    def options(self, x: np.ndarray) -> LshOptions:
        v = [min(b, a + int(t * (b - a + 1))) for t, (a, b) in zip(x, self.ranges, strict=True)]
        return LshOptions(self.family, v[0], v[1], v[2], self.sizes[v[3]], v[4] / 10, v[5])


def random_options(family: HashFamily, trials: int, n: int, seed: int = 42) -> list[LshOptions]:
    """Seeded random trials over the usual ranges."""
    space, rng = Space(family, n), np.random.default_rng(seed)
    return [space.options(rng.random(len(space.ranges))) for _ in range(trials)]


def suggest(tried: np.ndarray, scores: np.ndarray, rng: np.random.Generator, dims: int, startup: int = 8, draws: int = 24) -> np.ndarray:
    """The next point of the unit cube by a tree-structured Parzen estimator.

    After `startup` random points, the best quarter and the others each get a
    density of normal kernels and a uniform share; of the points drawn from
    the first, the one with the largest ratio of densities is next.
    """
    if len(tried) < startup:
        return rng.random(dims)
    order = np.argsort(-scores, kind="stable")
    cut = max(2, len(order) // 4)
    good, rest = tried[order[:cut]], tried[order[cut:]]
    width = lambda pts: 0.3 * len(pts) ** (-1 / (dims + 4))

    def density(at: np.ndarray, pts: np.ndarray) -> np.ndarray:
        h = width(pts)
        kernels = np.exp(-0.5 * ((at[:, None, :] - pts[None]) / h) ** 2) / (h * np.sqrt(2 * np.pi))
        return np.log((kernels.sum(1) + 1) / (len(pts) + 1)).sum(1)  # dimension by dimension

    drawn = np.clip(good[rng.integers(len(good), size=draws)] + width(good) * rng.standard_normal((draws, dims)), 0, 1 - 1e-9)
    return drawn[np.argmax(density(drawn, good) - density(drawn, rest))]


COLUMNS = "family string, hash_pool_size int, num_hash_functions int, num_hash_tables int, hash_table_size int, w double, num_cut_off_points int, recall double, error_ratio double, points_incomplete bigint, runtime double"


def trial(points: DataFrame, truth: DataFrame, o: LshOptions, k: int) -> tuple:
    """One fit and search: the options, recall, error ratio, incomplete points and seconds."""
    began = time.perf_counter()
    knn = ApproxKNN(o, k).fit(points)
    result = knn.kneighbors()
    found = result.table.persist()
    found.count()
    took = round(time.perf_counter() - began, 3)
    result._full = found
    r, e = result.recall(truth).first(), result.error_ratio(truth).first()
    found.unpersist()
    knn.release()
    return (o.family.value, o.hash_pool_size, o.num_hash_functions, o.num_hash_tables, o.hash_table_size, float(o.w), o.num_cut_off_points, r["recall"], e["error_ratio"], e["points_incomplete"], took)


def tune(points: DataFrame, truth: DataFrame, trials: Iterable[LshOptions], k: int, top: int | None = None) -> DataFrame:
    """Fits and searches once for each trial: one row of its options, quality and runtime, best recall first; the `top` best if given."""
    rows = sorted((trial(points, truth, o, k) for o in trials), key=lambda r: (-r[7], r[10]))[:top]
    return points.sparkSession.createDataFrame(rows, COLUMNS)


def optimize(points: DataFrame, truth: DataFrame, family: HashFamily | str, k: int, trials: int = 20, seconds: float | None = None, top: int | None = None, seed: int = 42, csv: str | None = None) -> DataFrame:
    """Searches for options of high recall, each trial chosen by what the ones before gave.

    Options that cannot be fitted, and trials slower than `seconds`, count as
    recall 0.  Rows as in tune(); with `csv` they are written there too.
    """
    space, rng, rows = Space(family, points.count()), np.random.default_rng(seed), []
    tried, scores = np.zeros((0, len(space.ranges))), np.zeros(0)
    for _ in range(trials):
        x = suggest(tried, scores, rng, len(space.ranges))
        try:
            rows.append(trial(points, truth, space.options(x), k))
            score = rows[-1][7] if seconds is None or rows[-1][10] <= seconds else 0.0
        except VicinalError:
            score = 0.0
        tried, scores = np.concatenate([tried, x[None]]), np.append(scores, score)
    rows = sorted(rows, key=lambda r: (-r[7], r[10]))[:top]
    if csv:
        with open(csv, "w", encoding="utf-8") as f:
            f.write(",".join(c.split()[0] for c in COLUMNS.split(", ")) + "\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    return points.sparkSession.createDataFrame(rows, COLUMNS)
