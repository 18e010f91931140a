"""The table format: numbered manifests over immutable Parquet fragments.

A table is a folder: `_versions/<number>.json`, `data/`, `_deletions/`, `_indices/`. Each commit
creates the next manifest exclusively; readers see a version completely or not at all. When two
writers meet, the later one is rebased on the newer head where that is safe and fails where not:

* append, overwrite: always rebased; fragment ids are given at commit, so they never collide;
* merge, rewrite, delete: only if every fragment that they replace is still there unchanged;
* create-index: if its fragments still exist.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from tessera.sources import storage

ATTEMPTS = 20
MAX_FRAGMENT_ID = 0xFFFFFFFF


class ConflictError(RuntimeError):
    """Another commit changed what this one replaces."""


@dataclass(frozen=True)
class Fragment:
    """One Parquet file (path relative to the table), the files of columns added since, and the rows deleted from it.

    A column file (path, names) has the same rows in the same order.
    """

    id: int
    path: str
    rows: int
    bytes: int | None = None
    deletions: tuple[str, ...] = ()
    deleted_rows: int = 0
    columns: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def live_rows(self) -> int:
        return self.rows - self.deleted_rows


@dataclass(frozen=True)
class IndexMeta:
    """A named index: which fields and fragments it covers and what its files need."""

    uuid: str
    name: str
    type: str
    fields: tuple[int, ...]
    column: str
    dataset_version: int
    fragment_ids: tuple[int, ...]
    index_version: int = 0
    details: dict = field(default_factory=dict)
    #: The fragments that its files hold; `fragment_ids` are those of them that are still there.
    built: tuple[int, ...] = ()


@dataclass(frozen=True)
class Manifest:
    """One version of a table."""

    version: int
    schema_json: str
    field_ids: dict[str, int]
    fragments: tuple[Fragment, ...] = ()
    indices: tuple[IndexMeta, ...] = ()
    operation: str = "Overwrite"
    timestamp: float = 0.0
    next_fragment_id: int = 0
    properties: dict = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema_json))

    def dumps(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"))

    @classmethod
    def loads(cls, text: str) -> Manifest:
        raw = json.loads(text)
        raw["fragments"] = tuple(Fragment(**f | {"deletions": tuple(f["deletions"]), "columns": tuple((p, tuple(n)) for p, n in f.get("columns", ()))}) for f in raw["fragments"])
        raw["indices"] = tuple(IndexMeta(**i | {k: tuple(i.get(k, ())) for k in ("fields", "fragment_ids", "built")}) for i in raw["indices"])
        return cls(**raw)

    def with_schema(self, schema: StructType) -> Manifest:
        """Known fields keep their ids; new ones get the next."""
        ids, following = {}, max(self.field_ids.values(), default=-1) + 1
        for f in schema.fields:
            if f.name in self.field_ids:
                ids[f.name] = self.field_ids[f.name]
            else:
                ids[f.name], following = following, following + 1
        return replace(self, schema_json=schema.json(), field_ids=ids)

    def with_new(self, fragments: list[Fragment], keep: bool) -> Manifest:
        """Give ids to fragments and add them; without `keep` they replace all others."""
        first = self.next_fragment_id
        if first + len(fragments) > MAX_FRAGMENT_ID:
            raise ValueError("fragment ids are used up")
        numbered = tuple(replace(f, id=first + i) for i, f in enumerate(fragments))
        return replace(self, fragments=(self.fragments if keep else ()) + numbered, next_fragment_id=first + len(fragments))


def _file(uri: str, version: int) -> str:
    return f"{uri}/_versions/{version:020d}.json"


def versions(spark: SparkSession, uri: str) -> list[int]:
    return [int(n[:-5]) for n in storage.names(spark, f"{uri}/_versions") if n.endswith(".json")]


def load(spark: SparkSession, uri: str, version: int | None = None) -> Manifest:
    """A version, the latest by default."""
    known = versions(spark, uri)
    if not known:
        raise FileNotFoundError(f"Dataset at path {uri} was not found: it has no versions")
    if version is not None and version not in known:
        raise ValueError(f"version {version} was not found at {uri}; it has {known[0]} to {known[-1]}")
    return Manifest.loads(storage.read_text(spark, _file(uri, known[-1] if version is None else version)))


def empty(schema: StructType) -> Manifest:
    return Manifest(0, StructType().json(), {}).with_schema(schema)


def commit(spark: SparkSession, uri: str, operation: str, change: Callable[[Manifest | None], Manifest]) -> Manifest:
    """Create the next version from `change(head)`, again on a newer head if another writer was first.

    `change` raises ConflictError where the newer head rules it out.
    """
    for _ in range(ATTEMPTS):
        known = versions(spark, uri)
        head = load(spark, uri, known[-1]) if known else None
        made = replace(change(head), version=(known[-1] if known else 0) + 1, operation=operation, timestamp=time.time())
        if storage.create_text(spark, _file(uri, made.version), made.dumps()):
            return made
    raise ConflictError(f"{operation} at {uri} met other commits {ATTEMPTS} times")


def replaced(head: Manifest, before: dict[int, Fragment], after: list[Fragment]) -> Manifest:
    """The head with some fragments replaced, which must be there as they were."""
    now = {f.id: f for f in head.fragments}
    if any(now.get(i) != f for i, f in before.items()):
        raise ConflictError("a fragment was changed by another commit")
    kept = replace(head, fragments=tuple(f for f in head.fragments if f.id not in before))
    same = [f for f in after if f.id in before]
    merged = kept.with_new([f for f in after if f.id not in before], keep=True)
    order = sorted((*merged.fragments, *same), key=lambda f: f.id)
    live = {f.id for f in order}
    # An index no longer covers a fragment that is gone; what it doesn't cover is scanned.
    indices = tuple(replace(x, fragment_ids=tuple(i for i in x.fragment_ids if i in live)) for x in merged.indices)
    return replace(merged, fragments=tuple(order), indices=indices)
