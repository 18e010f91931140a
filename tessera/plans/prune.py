"""Leaving fragments out by an index.

A filter's conjuncts that compare one B-tree column with literals are evaluated on that index, which gives the
fragments that can hold a match; the filter itself still runs on what is read, so an index never
changes a result. Conjuncts of any other shape (functions, subqueries, casts) and fragments that the index
doesn't cover are left to the scan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessera.sources.manifest import Fragment, Manifest


#: Parsed parts of a conjunct that an index may answer: comparisons, lists and null tests between a column and literals.
_PLAIN = {
    "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "In", "IsNull", "IsNotNull",
    "Like", "Literal", "UnaryMinus", "UnresolvedAttribute",
}


def _kind(node) -> str:  # noqa: ANN001
    """The part's class, or for a function its name."""
    name = node.getClass().getSimpleName()
    if name != "UnresolvedFunction":
        return name
    return ".".join(node.nameParts().apply(i) for i in range(node.nameParts().size())).lower()


def _children(node) -> list:  # noqa: ANN001
    return [node.children().apply(i) for i in range(node.children().size())]


def _names(node) -> set[str]:  # noqa: ANN001
    """Columns that a parsed expression speaks of."""
    if _kind(node) == "UnresolvedAttribute":
        return {".".join(node.nameParts().apply(i) for i in range(node.nameParts().size()))}
    return set().union(*map(_names, _children(node)))


def _plain(node) -> bool:  # noqa: ANN001
    return (_kind(node) in _PLAIN or _kind(node) == "between") and all(map(_plain, _children(node)))


def conjuncts(spark: SparkSession, predicate: str) -> list[tuple[set[str], object]]:
    """(columns, parsed expression) of each part of a filter that is joined by AND."""
    stack, out = [spark._jsparkSession.sessionState().sqlParser().parseExpression(predicate)], []
    while stack:
        node = stack.pop()
        if _kind(node) == "And":
            stack += reversed(_children(node))
        else:
            out.append((_names(node), node))
    return out


def _on_index(node, listed: bool) -> str | None:  # noqa: ANN001
    """The conjunct as a filter on the index's values; None if the index can't answer it.

    An index over a list column has the lists' elements, so it answers `array_contains` of a literal only.
    """
    if not listed:
        return node.sql() if _plain(node) else None
    if _kind(node) == "array_contains" and [_kind(c) for c in _children(node)] == ["UnresolvedAttribute", "Literal"]:
        column, element = _children(node)
        return f"{column.sql()} = {element.sql()}"
    return None


def fragments_for(spark: SparkSession, uri: str, made: Manifest, fragments: list[Fragment], predicate: str) -> list[Fragment]:
    """The fragments that may hold rows for the predicate; what comes to the driver is a set of fragment ids."""
    trees = {i.column.lower(): i for i in made.indices if i.type == "BTree"}
    if not trees or not fragments:
        return fragments
    for names, node in conjuncts(spark, predicate):
        index = trees.get(next(iter(names)).lower()) if len(names) == 1 else None
        if index is None:
            continue
        sql = _on_index(node, isinstance(made.schema[index.column].dataType, ArrayType))
        if sql is None:
            continue
        found = spark.read.parquet(f"{uri}/_indices/{index.uuid}").select(F.col("value").alias(index.column), F.col("fragment_id").alias("_fragment"))
        hit = {r[0] for r in found.where(sql).select("_fragment").distinct().collect()}
        covered = set(index.fragment_ids)
        fragments = [f for f in fragments if f.id not in covered or f.id in hit]
    return fragments
