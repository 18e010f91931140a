"""IVF vector indices: coarse centroids trained once, then every row assigned and encoded in one pass.

The index is a table partitioned by centroid, (part_id, _rowid, code): float vectors (FLAT), one byte a
dimension between the table's bounds (SQ), or product-quantised bytes (PQ, Jegou et al. 2011). Training
reads a sample of sample_rate rows a centroid, at most SAMPLE_BYTES of vectors; every row is indexed. Beyond 1024
centroids they are found in two levels. Centroids and codebooks are tables beside the index, so that
manifests stay small. The graph variants
(HNSW_*) keep the same codes and scan a probed partition whole instead of walking a graph (Malkov and Yashunin
2018), whose recall in a partition is therefore 1.
"""

from __future__ import annotations

import uuid as uuids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.distance import assigned, check_metric, distance, kmeans, pairwise, two_level_kmeans
from tessera.operators.index_common import check_column, check_name, commit_index, covered, open_target
from tessera.sources import reader
from tessera.sources.manifest import IndexMeta
from tessera.sources.reader import ROW_ID
from tessera.table import Table

TYPES = ("IVF_FLAT", "IVF_PQ", "IVF_SQ", "IVF_HNSW_FLAT", "IVF_HNSW_PQ", "IVF_HNSW_SQ")
SPELLED = TYPES
#: The training sample's vectors, as doubles on the driver.
SAMPLE_BYTES = 1 << 28


def check_vector_type(index_type: object) -> str:
    """The canonical type name of a string or an enum member."""
    value = getattr(index_type, "value", index_type)
    if not isinstance(value, str):
        raise TypeError(f"index_type must be a string or an enum of strings, not {type(index_type).__name__}")
    if value.upper() not in TYPES:
        raise ValueError(f"index_type must be one of {list(TYPES)}, not '{value}'")
    return value.upper()


def _sample(rows: DataFrame, column: str, n: int, total: int) -> np.ndarray:
    """At most about n vectors, drawn by a hash of the row id."""
    share = min(1.0, n / max(total, 1))
    unit = F.xxhash64(ROW_ID).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    found = rows.where(unit < share).select(ROW_ID, F.col(f"`{column}`").cast("array<double>").alias("v")).toArrow()
    order = np.argsort(found[ROW_ID].to_numpy())
    return np.array([np.asarray(v) for v in found["v"].to_pylist()], dtype=np.float64)[order] if len(order) else np.zeros((0, 0))


def _normal(rows: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return rows
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def create_index(
    spark: SparkSession,
    uri: str | Table | None = None,
    column: str = "vector",
    index_type: object = "IVF_FLAT",
    name: str | None = None,
    *,
    replace: bool = True,
    num_workers: int = 4,
    storage_options: dict[str, str] | None = None,
    metric: str = "l2",
    num_partitions: int | None = None,
    num_sub_vectors: int | None = None,
    ivf_centroids: np.ndarray | None = None,
    pq_codebook: np.ndarray | None = None,
    sample_rate: int = 256,
    table_id: list[str] | None = None,
    namespace_impl: str | None = None,
    namespace_properties: dict[str, str] | None = None,
    fragment_ids: list[int] | None = None,
    **options: object,
) -> Table:
    """Build an IVF index and commit it; given centroids or codebooks are used instead of training."""
    if not column:
        raise ValueError("Column name cannot be empty")
    if num_workers <= 0:
        raise ValueError(f"num_workers must be positive, got {num_workers}")
    kind = check_vector_type(index_type)
    metric = check_metric(metric)
    reader.set_storage(spark, storage_options)
    table = open_target(spark, uri, table_id, namespace_impl, namespace_properties)
    made = table.manifest
    held = check_column(made, column)
    if not (isinstance(held, T.ArrayType) and isinstance(held.elementType, T.NumericType)):
        raise TypeError(f"Column {column} must be a list of numbers for a vector index, got {held.simpleString()}")
    name = name or f"{column}_idx"
    check_name(made, name, replace)
    fragments = covered(made, fragment_ids)
    rows = reader.live(spark, table.uri, made.schema, fragments, row_ids=True).where(F.col(f"`{column}`").isNotNull()).select(ROW_ID, F.col(f"`{column}`"))
    shape = rows.agg(F.min(F.size(column)), F.max(F.size(column)), F.count(F.lit(1)), F.max(F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double"))))).first()
    low, high, total, broken = shape
    if not total:
        raise ValueError(f"Column {column} has no vectors")
    if low != high:
        raise ValueError(f"Column {column} has vectors of {low} to {high} dimensions")
    if broken:
        raise ValueError(f"Column {column} has vectors with missing or NaN elements")
    if options:
        raise ValueError(f"options {sorted(options)} are not supported")
    n_parts = num_partitions or max(1, round(total**0.5))
    pq = kind.endswith("PQ")
    wanted = min(sample_rate * max(n_parts, 256 if pq else 1), max(SAMPLE_BYTES // (8 * low), n_parts))
    trained = ivf_centroids is None or (pq and pq_codebook is None)
    sample = _normal(_sample(rows, column, wanted, total), metric) if trained else np.zeros((0, low))
    centres = np.asarray(ivf_centroids, dtype=np.float64) if ivf_centroids is not None else two_level_kmeans(sample, n_parts)
    details = {"metric": metric, "dimension": low, "encoding": kind.rsplit("_", 1)[1]}
    books = None
    if pq:
        m = num_sub_vectors or (low // 16 if low % 16 == 0 else low // 8 if low % 8 == 0 else 1)
        if low % m:
            raise ValueError(f"num_sub_vectors {m} does not divide the dimension {low}")
        books = np.asarray(pq_codebook, dtype=np.float64) if pq_codebook is not None else _codebooks(sample, centres, m)
    if details["encoding"] == "SQ":
        edge = rows.select(F.array_min(column).cast("double").alias("a"), F.array_max(column).cast("double").alias("b")).agg(F.min("a"), F.max("b")).first()
        details["low"], details["high"] = (-1.0, 1.0) if metric == "cosine" else (edge[0], edge[1])
    key = str(uuids.uuid4())
    folder = f"{table.uri}/_indices/{key}"
    _save(spark, f"{folder}/centroids", centres)
    if books is not None:
        _save(spark, f"{folder}/codebook", books.reshape(-1, books.shape[-1]))
        details["sub_vectors"] = len(books)
    encoded = rows.mapInArrow(_encoder(column, details, centres, books), f"part_id int, {ROW_ID} long, code {'array<float>' if details['encoding'] == 'FLAT' else 'binary'}")
    files = max(1, min(num_workers, len(fragments)))
    # Dealt by centroid and row, so that a crowded centroid is spread over several files.
    encoded.repartition(max(files, n_parts // 64), "part_id", F.pmod(ROW_ID, F.lit(4))).write.partitionBy("part_id").parquet(f"{folder}/rows")
    index = IndexMeta(key, name, kind, (made.field_ids[column],), column, made.version, tuple(f.id for f in fragments), 0, details)
    return commit_index(table, index, made)


def _save(spark: SparkSession, path: str, rows: np.ndarray) -> None:
    table = pa.table({"place": pa.array(np.arange(len(rows), dtype=np.int64)), "v": pa.array(list(rows), pa.list_(pa.float64()))})
    spark.createDataFrame(table).write.parquet(path)


def _load(spark: SparkSession, path: str) -> np.ndarray:
    """A trained table: of the sample's bounded size, so fit for the driver."""
    found = spark.read.schema("place long, v array<double>").parquet(path).toArrow().sort_by("place").combine_chunks()
    return np.array(found["v"].to_pylist(), dtype=np.float64)


def _codebooks(sample: np.ndarray, centres: np.ndarray, m: int) -> np.ndarray:
    """(sub-vector, code, dimension) of the residuals."""
    rest = sample - centres[assigned(sample, centres)[0]]
    return np.stack([np.pad(c := kmeans(part, 256), ((0, 256 - len(c)), (0, 0)), mode="edge") for part in np.split(rest, m, axis=1)])


def _encoder(column: str, details: dict, centres: np.ndarray, books: np.ndarray | None):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = _normal(np.array(batch.column(column).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1), details["metric"])
            part = assigned(rows, centres)[0]
            if details["encoding"] == "FLAT":
                code = pa.array(list(rows.astype(np.float32)), pa.list_(pa.float32()))
            elif details["encoding"] == "SQ":
                span = max(details["high"] - details["low"], 1e-12)
                code = pa.array([r.tobytes() for r in np.clip(np.round((rows - details["low"]) / span * 255), 0, 255).astype(np.uint8)], pa.binary())
            else:
                rest = np.split(rows - centres[part], len(books), axis=1)
                codes = np.stack([assigned(r, b)[0] for r, b in zip(rest, books, strict=True)], axis=1).astype(np.uint8)
                code = pa.array([r.tobytes() for r in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column(ROW_ID), code], ["part_id", ROW_ID, "code"])

    return run


def _decoded(code: np.ndarray, part: np.ndarray, details: dict, centres: np.ndarray, books: np.ndarray | None) -> np.ndarray:
    if details["encoding"] == "SQ":
        return details["low"] + code / 255 * (details["high"] - details["low"])
    return np.concatenate([books[m][code[:, m]] for m in range(len(books))], axis=1) + centres[part]


def candidates(table: Table, index: IndexMeta, query: np.ndarray, nprobes: int, metric: str) -> tuple[DataFrame, int]:
    """(_rowid, _distance) of the rows in the `nprobes` nearest partitions, by their stored codes; the number of partitions."""
    details = index.details
    point = _normal(query[None, :], metric)[0]
    folder = f"{table.uri}/_indices/{index.uuid}"
    centres = _load(table.spark, f"{folder}/centroids")
    rank = pairwise(point[None, :], centres)[0] if metric != "dot" else -(centres @ point)
    probed = np.argsort(rank, kind="stable")[: max(1, nprobes)].tolist()
    rows = table.spark.read.parquet(f"{folder}/rows").where(F.col("part_id").isin(probed))
    if details["encoding"] == "FLAT":
        return rows.select(ROW_ID, distance(F.col("code"), point.tolist(), metric).alias("_distance")), len(centres)

    books = None
    if details["encoding"] == "PQ":
        flat = _load(table.spark, f"{folder}/codebook")
        books = flat.reshape(details["sub_vectors"], -1, flat.shape[1])
    near = {p: centres[p] for p in probed}

    def run(batches):  # noqa: ANN001, ANN202
        held = np.zeros((max(near) + 1, len(point)))
        held[list(near)] = np.stack(list(near.values()))
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.array([np.frombuffer(c, dtype=np.uint8) for c in batch.column("code").to_pylist()])
            v = _decoded(code, batch.column("part_id").to_numpy(), details, held, books)
            if metric == "l2":
                d = ((v - point) ** 2).sum(axis=1)
            elif metric == "hamming":
                d = np.bitwise_count(np.round(v).astype(np.int64) ^ np.round(point).astype(np.int64)).sum(axis=1).astype(np.float64)
            else:
                d = 1 - v @ point / (np.linalg.norm(v, axis=1) * np.linalg.norm(point) if metric == "cosine" else 1)
            yield pa.RecordBatch.from_arrays([batch.column(ROW_ID), pa.array(d, pa.float64())], [ROW_ID, "_distance"])

    return rows.mapInArrow(run, f"{ROW_ID} long, _distance double"), len(centres)
