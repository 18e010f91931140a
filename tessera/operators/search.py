"""Search over a table: full text ranked by BM25, and nearest neighbours.

Every search covers all live rows: what an index doesn't cover is scanned the plain way, and
deleted rows never appear.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions.distance import check_metric, distance
from tessera.functions.text import PATTERN
from tessera.operators import scalar_index, vector_index
from tessera.sources import reader
from tessera.sources.manifest import Fragment, IndexMeta
from tessera.sources.reader import ROW_ID
from tessera.table import Table

K1, B = 1.2, 0.75


def _query_tokens(query: str) -> list[str]:
    import regex

    return regex.findall(PATTERN, query.lower())


def _index_of(table: Table, kinds: tuple[str, ...], column: str | None) -> IndexMeta | None:
    return next((i for i in table.manifest.indices if i.type in kinds and column in (None, i.column)), None)


def _split(table: Table, index: IndexMeta | None) -> tuple[list[Fragment], list[Fragment]]:
    held = set(index.fragment_ids) if index else set()
    return [f for f in table.fragments() if f.id in held], [f for f in table.fragments() if f.id not in held]


#: So many fragment ids stand in a filter; beyond that they are joined.
LISTED = 1000


def _live(table: Table, rows: DataFrame, index: IndexMeta, done: list[Fragment]) -> DataFrame:
    """An index's rows without those of fragments that are gone and without deleted ones."""
    if len(done) < len(index.built):
        fragment = F.shiftright(ROW_ID, 32)
        if len(done) <= LISTED:
            rows = rows.where(fragment.isin([f.id for f in done]))
        else:
            ids = table.spark.createDataFrame([(f.id,) for f in done], "_fragment long")
            rows = rows.join(reader.bounded(ids, len(done)), fragment == F.col("_fragment"), "left_semi")
    cut = [f for f in done if f.deletions]
    if not cut:
        return rows
    return rows.join(reader.bounded(reader.deletions(table.spark, table.uri, cut), sum(f.deleted_rows for f in cut)), ROW_ID, "left_anti")


def full_text_search(table: Table, query: str, *, column: str | None = None, columns: list[str] | None = None, operator: str = "or", limit: int | None = None, phrase: bool = False) -> DataFrame:
    """Rows that hold the query's tokens, with `_score` (BM25), best first if `limit` is given.

    operator "or" wants any token, "and" all. `phrase` wants them one after another, which needs positions.
    """
    index = _index_of(table, ("Inverted",), column)
    if index is None and column is None:
        raise ValueError("no full-text index: name the column")
    column = column or index.column
    wanted = list(dict.fromkeys(_query_tokens(query)))
    done, rest = _split(table, index)
    stop = bool(index and index.details["remove_stop_words"])
    found, sizes = [], []
    if done:
        if phrase and not index.details["with_position"]:
            raise ValueError("phrase queries need an index with positions")
        folder = f"{table.uri}/_indices/{index.uuid}"
        listed = table.spark.read.parquet(f"{folder}/postings").where(F.col("token").isin(wanted))
        found.append(_live(table, listed, index, done).select(ROW_ID, "token", "tf", "positions"))
        sizes.append(_live(table, table.spark.read.parquet(f"{folder}/lengths"), index, done))
    if rest:
        rows = reader.live(table.spark, table.uri, table.schema, rest, row_ids=True).select(ROW_ID, F.col(f"`{column}`"))
        found.append(scalar_index.postings(rows, column, stop, True).where(F.col("token").isin(wanted)).select(ROW_ID, "token", "tf", "positions"))
        sizes.append(scalar_index.lengths(rows, column, stop))
    if not found or not wanted:
        return reader.live(table.spark, table.uri, table.schema, [], row_ids=False).withColumn("_score", F.lit(0.0))
    hits, size = reduce(DataFrame.union, found), reduce(DataFrame.union, sizes)
    if rest or len(done) < len(index.built) or any(f.deletions for f in done):
        sums = size.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    else:
        sums = (index.details["documents"], index.details["words"])
    documents, mean = sums[0], max(sums[1], 1) / max(sums[0], 1)
    # One row for each token of the query, with the fragments that hold it.
    known = hits.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.shiftright(ROW_ID, 32)).alias("fragments")).collect()
    idf = {r["token"]: float(np.log(1 + (documents - r["n"] + 0.5) / (r["n"] + 0.5))) for r in known}
    holding = {i for r in known for i in r["fragments"]}
    weight = F.lit(0.0)
    for t, v in idf.items():
        weight = F.when(F.col("token") == t, v).otherwise(weight)
    scored = hits.join(size, ROW_ID).withColumn("part", weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean)))
    lists = F.map_from_entries(F.collect_list(F.struct("token", "positions"))) if phrase else F.lit(None)
    ranked = scored.groupBy(ROW_ID).agg(F.sum("part").alias("_score"), F.count(F.lit(1)).alias("_n"), lists.alias("_at"))
    if phrase:
        order = _query_tokens(query)
        starts = reduce(F.array_intersect, [_moved(F.coalesce(F.col("_at")[t], F.array().cast("array<int>")), k) for k, t in enumerate(order)])
        ranked = ranked.where(F.size(starts) > 0)
    elif operator == "and":
        ranked = ranked.where(F.col("_n") == len(wanted))
    ranked = ranked.select(ROW_ID, "_score")
    names = columns or table.schema.names
    if limit is None:
        rows = reader.live(table.spark, table.uri, table.schema, [f for f in table.fragments() if f.id in holding], row_ids=True)
        return rows.join(ranked, ROW_ID).select(*(F.col(f"`{c}`") for c in names), "_score")
    return fetch(table, ranked.orderBy(F.desc("_score"), ROW_ID).limit(limit).collect(), names, ["_score"]).orderBy(F.desc("_score"), ROW_ID).drop(ROW_ID)


def _moved(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - k)


def fetch(table: Table, best: list[Row], names: list[str], extra: list[str]) -> DataFrame:
    """The columns of a few rows by `_rowid`, read from their fragments only; `extra` doubles come from `best`."""
    local = table.spark.createDataFrame([tuple(r) for r in best], ", ".join([f"{ROW_ID} long", *(f"{c} double" for c in extra)]))
    ids = {r[ROW_ID] >> 32 for r in best}
    data = reader.live(table.spark, table.uri, table.schema, [f for f in table.fragments() if f.id in ids], row_ids=True)
    return data.join(reader.bounded(local, len(best)), ROW_ID).select(ROW_ID, *(F.col(f"`{c}`") for c in names), *extra)


def nearest(
    table: Table,
    column: str,
    q: list[float],
    k: int = 10,
    *,
    metric: str | None = None,
    columns: list[str] | None = None,
    filter: str | None = None,  # noqa: A002
    use_index: bool = True,
    nprobes: int = 1,
    refine_factor: int | None = None,
) -> DataFrame:
    """The k nearest rows with `_distance`, nearest first, ties by row id.

    With an index only `nprobes` of its partitions are read, more only where they hold fewer than k live rows;
    `refine_factor` takes that many times k candidates by stored codes and ranks them by exact distance. A filter
    makes the search exact.
    """
    query = np.asarray(q, dtype=np.float64)
    index = _index_of(table, vector_index.SPELLED, column) if use_index and filter is None else None
    metric = check_metric(metric or (index.details["metric"] if index else "l2"))
    if index and index.details["metric"] != metric:
        index = None
    done, rest = _split(table, index)
    names = columns or table.schema.names
    order = [F.col("_distance").asc_nulls_last(), F.col(ROW_ID).asc()]
    exact = distance(F.col(f"`{column}`"), q, metric).alias("_distance")
    wanted = k * (refine_factor or 1)
    plain = None
    if rest or not done:
        rows = reader.live(table.spark, table.uri, table.schema, rest, row_ids=True)
        rows = rows.where(filter) if filter else rows
        plain = rows.where(F.col(f"`{column}`").isNotNull()).select(ROW_ID, exact)
    while True:
        parts = [plain] if plain is not None else []
        if done:
            near, partitions = vector_index.candidates(table, index, query, nprobes, metric)
            coarse = _live(table, near, index, done).orderBy(*order).limit(wanted)
            if refine_factor:
                coarse = fetch(table, coarse.select(ROW_ID).collect(), [column], []).select(ROW_ID, exact)
            parts.append(coarse)
        best = reduce(DataFrame.union, parts).orderBy(*order).limit(k).collect()
        if not done or len(best) == k or nprobes >= partitions:
            return fetch(table, best, names, ["_distance"]).orderBy(*order).drop(ROW_ID)
        nprobes *= 4
