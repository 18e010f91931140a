"""Vector distances as column expressions (exact, in double precision) and as numpy kernels (for index builds)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "euclidean", "cosine", "dot", "hamming")


def check_metric(metric: str) -> str:
    """The canonical metric; `euclidean` is another name of l2."""
    low = str(metric).lower()
    if low not in METRICS:
        raise ValueError(f"metric {metric!r} is not supported; it must be one of {', '.join(METRICS)}")
    return "l2" if low == "euclidean" else low


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def distance(vector: Column, query: list[float], metric: str) -> Column:
    """Distance of a vector column to a query: squared for l2, 1 - similarity for cosine and dot, differing bits for hamming.

    Smaller is nearer. Cosine with a zero vector is null.
    """
    metric = check_metric(metric)
    if metric == "hamming":
        point = F.array(*(F.lit(int(x)).cast("long") for x in query))
        return _sum(F.zip_with(vector.cast("array<bigint>"), point, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("double")))
    point = F.array(*(F.lit(float(x)) for x in query))
    v = vector.cast("array<double>")
    if metric == "l2":
        return _sum(F.zip_with(v, point, lambda a, b: (a - b) * (a - b)))
    dot = _sum(F.zip_with(v, point, lambda a, b: a * b))
    if metric == "dot":
        return F.lit(1.0) - dot
    norm = F.sqrt(_sum(F.transform(v, lambda a: a * a))) * F.lit(float(np.linalg.norm(query)))
    return F.lit(1.0) - dot / F.nullif(norm, F.lit(0.0))


def pairwise(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(row, centre) squared distances."""
    return (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None, :]


#: Distances that are held at once in an assignment: 32 MB of doubles.
HELD = 1 << 22


def assigned(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance) of every row, a bounded block of rows at a time."""
    near, far = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    step = max(1, HELD // max(1, len(centres)))
    for at in range(0, len(rows), step):
        d = pairwise(rows[at : at + step], centres)
        near[at : at + step] = d.argmin(axis=1)
        far[at : at + step] = d[np.arange(len(d)), near[at : at + step]]
    return near, far


def two_level_kmeans(rows: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """About k centres: plain up to 1024, beyond that sqrt(k) groups first, each with centres by its share of the rows.

    Work is then rows * sqrt(k) instead of rows * k a step.
    """
    if k <= 1024 or len(rows) <= k:
        return kmeans(rows, k, seed)
    groups = kmeans(rows, round(k**0.5), seed)
    near, _ = assigned(rows, groups)
    count = np.bincount(near, minlength=len(groups))
    return np.concatenate([kmeans(rows[near == g], max(1, round(k * count[g] / len(rows))), seed) for g in np.flatnonzero(count)])


def kmeans(rows: np.ndarray, k: int, seed: int = 42, steps: int = 15) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; empty clusters start again at the farthest row."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)].astype(np.float64)
    for _ in range(steps):
        near, far = assigned(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        filled = count > 0
        centres[filled] = total[filled] / count[filled, None]
        if (~filled).any():
            centres[~filled] = rows[np.argsort(-far, kind="stable")[: (~filled).sum()]]
    return centres
