"""Which adjacent fragments to merge."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from tessera.sources.manifest import Fragment


@dataclass(frozen=True)
class CompactionOptions:
    """Limits of a compaction; `num_threads` is accepted, Spark decides it. `fold_columns` also rewrites fragments with column files."""

    target_rows_per_fragment: int = 1_048_576
    materialize_deletions: bool = True
    materialize_deletions_threshold: float = 0.1
    num_threads: int | None = None
    fold_columns: bool = False

    @classmethod
    def of(cls, given: CompactionOptions | dict | None) -> CompactionOptions:
        return given if isinstance(given, cls) else cls(**(given or {}))


def small_bins(sizes: Iterable[int], target: int) -> list[list[int]]:
    """Runs of adjacent places whose sizes reach the target together; a large one stands alone."""
    bins: list[list[int]] = []
    total = target
    for place, size in enumerate(sizes):
        if total >= target or size >= target:
            bins.append([])
            total = 0
        bins[-1].append(place)
        total += size
    return bins


def plan(fragments: Iterable[Fragment], options: CompactionOptions) -> list[list[Fragment]]:
    """Groups to rewrite as one fragment each, in id order."""

    def crowded(f: Fragment) -> bool:
        return options.fold_columns and bool(f.columns) or options.materialize_deletions and f.rows > 0 and f.deleted_rows / f.rows > options.materialize_deletions_threshold

    groups: list[list[Fragment]] = [[]]
    total = 0
    for f in sorted(fragments, key=lambda f: f.id):
        if not (f.live_rows < options.target_rows_per_fragment or crowded(f)):
            groups.append([])
            total = 0
            continue
        if total >= options.target_rows_per_fragment:
            groups.append([])
            total = 0
        groups[-1].append(f)
        total += f.live_rows
    return [g for g in groups if len(g) > 1 or (g and crowded(g[0]))]
