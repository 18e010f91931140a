"""What scalar and vector index builds share: checks, naming and the commit."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from tessera.sources import manifest
from tessera.sources.manifest import ConflictError, Fragment, IndexMeta, Manifest
from tessera.table import Table


def open_target(spark: SparkSession, target: str | Table | None, table_id: list[str] | None, namespace_impl: str | None, namespace_properties: dict[str, str] | None) -> Table:
    """The table of a uri, a handle or a catalog id, at its latest version."""
    uri = target.uri if isinstance(target, Table) else target
    return Table(spark, uri, table_id=table_id, namespace_impl=namespace_impl, namespace_properties=namespace_properties)


def check_name(made: Manifest, name: str, replace_old: bool) -> None:
    if not replace_old and any(i.name == name for i in made.indices):
        raise ValueError(f"an index named '{name}' already exists: pass replace=True to build it again")


def check_column(made: Manifest, column: str):  # noqa: ANN201
    """The column's type."""
    if column not in made.schema.names:
        raise ValueError(f"Column '{column}' not found in dataset; available: {made.schema.names}")
    return made.schema[column].dataType


def covered(made: Manifest, fragment_ids: list[int] | None) -> list[Fragment]:
    """The fragments to index."""
    if not made.fragments:
        raise ValueError("Dataset contains no fragments")
    if fragment_ids is None:
        return list(made.fragments)
    known = {f.id: f for f in made.fragments}
    if unknown := [i for i in fragment_ids if i not in known]:
        raise ValueError(f"Fragment IDs {unknown} do not exist in the dataset")
    if not fragment_ids:
        raise ValueError("fragment_ids is empty: no fragments to index")
    return [known[i] for i in fragment_ids]


def commit_index(table: Table, index: IndexMeta, source: Manifest) -> Table:
    """Add the index in one commit, in place of one of its name."""
    held = set(index.fragment_ids)
    index = replace(index, built=index.fragment_ids)
    used = {f.id: f for f in source.fragments if f.id in held}

    def change(head: Manifest) -> Manifest:
        now = {f.id: f.path for f in head.fragments}
        if any(now.get(i) != f.path for i, f in used.items()):
            raise ConflictError("a fragment was changed while it was indexed")
        return replace(head, indices=(*(i for i in head.indices if i.name != index.name), index))

    manifest.commit(table.spark, table.uri, "CreateIndex", change)
    return Table(table.spark, table.uri)
