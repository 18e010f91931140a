"""Dealing work to workers: contiguous chunks, and longest-first balanced groups."""

from __future__ import annotations

import heapq
from collections.abc import Sequence


def array_split(items: Sequence, n: int) -> list[list]:
    """At most n contiguous chunks of equal size, the last maybe shorter."""
    items = list(items)
    if n <= 0:
        raise ValueError("n must be positive")
    if not items:
        raise ValueError("nothing to split")
    size = -(-len(items) // n)
    return [items[i : i + size] for i in range(0, len(items), size)]


def balanced(weights: dict[int, int], workers: int) -> list[list[int]]:
    """Groups of ids of about equal weight: the heaviest left goes to the lightest group, the first of equals."""
    if workers <= 0:
        raise ValueError("num_workers must be positive")
    groups: list[list[int]] = [[] for _ in range(workers)]
    heap = [(0, w) for w in range(workers)]
    for item in sorted(weights, key=lambda i: (-weights[i], i)):
        load, worker = heapq.heappop(heap)
        groups[worker].append(item)
        heapq.heappush(heap, (load + weights[item], worker))
    return [g for g in groups if g]
