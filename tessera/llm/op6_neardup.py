"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

Signatures. A text's elements are its distinct five-word shingles, with weight 1 ("binary", plain
Jaccard similarity, the default) or their number of places ("count", weighted Jaccard). Every element
throws darts, seeded by its hash alone, on the plane weight x rank: the plane is cut into regions whose
number of darts is Poisson with the region's area, and a dart counts if it falls below the element's
weight. A dart also names one of K coordinates; the signature keeps the earliest dart of each. A text
looks only at ranks below (K ln K + 2 K) / total weight, and doubles that where a coordinate stays
empty: work per text follows K and its number of elements, not their product.

Candidates. BANDS bands of ROWS coordinates each are hashed to bucket keys. A bucket is never paired
with itself: its members are compared with one leader, the member that shares buckets with most others, and
those that are not near it with a second one, chosen among them alike. Verified links make components. Then every
two members of a bucket that are of different components are compared, unless a bound rules a link out:
their sizes; and for each leader c that both have met, as shingles they share are either in c or not,

    |x & y| <= min(|x & c|, |y & c|) + min(r(x), r(y)),   r(x) = |x - c| - (shingles that no other text has),

which holds exactly, so nothing is capped or sampled. (Shingles that no other text has are counted among the members of
all buckets with HOT members or more that are of several components; in smaller buckets none are taken off.) The comparison
goes by growing portions of the pairs, and components that a portion unites aren't compared further. In the end every
two texts that share a bucket are of one component, compared, or ruled out. A large family without links,
whose shingles the bound can't tell apart, is still compared pair by pair.

Check. Candidate pairs are verified on their shingle sets (44-bit ids). Verified links go to
alternating large-star and small-star rounds; classes, links and fingerprints stay in Spark.

A pair at similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^8)^50 = 0.9999.

Edge cases: equal texts are one class however short or empty; null texts are each a class of their own;
texts of one to four words have all their words as one shingle; texts that fold to no words link only
to equal texts. Rows that share a doc_id get the class of their own text; rows without doc_id get a null
class. class_id is the smallest doc_id of the class. An empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytetext import ALNUM, Chunk, chunks, mix
from tessera.llm.runtime import arrow_map, by_ids, cut, drop, read, unit_hash, unused

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 50
ROWS = 8
K = BANDS * ROWS
#: Up to these portions of the pairs across components are compared, with components joined in between; the last is all of them.
PORTIONS = (1 / 32, 1 / 4, 1.0)
#: Leaders that a bucket's members meet.
LEADERS = 2
#: From so many members on, shingles that no other text has count in a bucket's bound.
HOT = 16
#: About so many members of a bucket stand in a block.
BLOCK = 512
#: Texts whose darts are held together.
TEXTS_AT_ONCE = 64
#: The rank axis: [0, 2^-FINE), then [2^m, 2^(m+1)) for m from -FINE on.
FINE = 4
ID_BITS = 44

_MASK = np.uint64((1 << ID_BITS) - 1)
_STEP = np.array([0x9FB21C651E98DF25 * (2 * k + 1) & (1 << 64) - 1 | 1 for k in range(64)], dtype=np.uint64)
_cdfs: dict[float, np.ndarray] = {}


def shingles(chunk: Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 44-bit shingle id, places) of the chunk's distinct shingles, ordered by document and id."""
    words = chunk.scan(ALNUM)
    h, n = words.hashes(), len(words.doc)
    head = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    ids = np.zeros(len(head), dtype=np.uint64)
    for k in range(size):
        ids += h[head + k] * _STEP[k]
    doc = words.doc[head]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(words.counts)])
        few = np.array([(h[begin[d] : begin[d + 1]] * _STEP[: words.counts[d]]).sum(dtype=np.uint64) for d in short], dtype=np.uint64)
        ids, doc = np.concatenate([ids, few]), np.concatenate([doc, short])
    keys = np.sort((doc.astype(np.uint64) << np.uint64(ID_BITS)) | (mix(ids) & _MASK))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first] >> np.uint64(ID_BITS)).astype(np.int64), keys[first] & _MASK, np.diff(np.append(first, len(keys)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(area: float, u: np.ndarray) -> np.ndarray:
    """Poisson numbers of mean `area` by inversion."""
    if area not in _cdfs:
        top = int(area + 12 * math.sqrt(area) + 30)
        logs = np.arange(top) * math.log(area) - area - np.array([math.lgamma(k + 1) for k in range(top)])
        _cdfs[area] = np.cumsum(np.exp(logs))
    return np.searchsorted(_cdfs[area], u, side="right")


def throw(elements: np.ndarray, weights: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """All darts with a rank under the element's limit and a height under its weight: (element, coordinate, rank, dart)."""
    out: list[tuple[np.ndarray, ...]] = []
    slab = 0
    while len(elements) and (tall := np.flatnonzero(weights > 2**slab - 1)).size:
        for m in range(-FINE - 1, 64):
            low, width = (0.0, 2.0**-FINE) if m < -FINE else (2.0**m, 2.0**m)
            at = tall[limit[tall] > low]
            if not at.size:
                break
            region = mix(elements[at] ^ np.uint64((slab * 131 + m + FINE + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
            u = _uniform(region)
            area = width * 2.0**slab
            some = np.flatnonzero(u >= math.exp(-area))
            number = _poisson(area, u[some])
            place = np.repeat(some, number)
            nth = np.arange(len(place)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix(region[place] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            where = mix(dart ^ np.uint64(0x165667B19E3779F9))
            rank = low + width * _uniform(where)
            at = at[place]
            below = rank < limit[at]
            if (weights[at] < 2 ** (slab + 1) - 1).any():
                below &= 2**slab - 1 + 2.0**slab * _uniform(mix(where)) < weights[at]
            hit = np.flatnonzero(below)
            out.append((at[hit], ((dart[hit] >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64), rank[hit], dart[hit]))
        slab += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(doc: np.ndarray, elements: np.ndarray, weights: np.ndarray, rows: int, k: int = K) -> np.ndarray:
    """(row, coordinate) darts; rows without elements stay 0."""
    total = np.bincount(doc, weights=weights, minlength=rows)
    limit = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    out = np.zeros(rows * k, dtype=np.uint64)
    open_rows = total > 0
    while open_rows.any():
        use = np.flatnonzero(open_rows[doc])
        at, coordinate, rank, dart = throw(elements[use], weights[use], limit[doc[use]], k)
        cell = doc[use][at] * k + coordinate
        best = np.full(rows * k, np.inf)
        np.minimum.at(best, cell, rank)
        first = rank == best[cell]
        out[cell[first]] = dart[first]
        empty = np.isinf(best).reshape(rows, k).any(axis=1)
        open_rows &= empty
        limit = np.where(open_rows, limit * 2, limit)
    return out.reshape(rows, k)


def bands(signature: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """(row, band) bucket keys; the band's number is part of the key."""
    per_band = signature.shape[1] // n_bands
    parts = signature.reshape(len(signature), n_bands, per_band)
    return mix((parts * _STEP[:per_band]).sum(axis=2, dtype=np.uint64) ^ (np.arange(n_bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def signed(docs: DataFrame, weighting: str = "binary") -> DataFrame:
    """(doc_id, text keys a and b, bucket keys) of every row with a doc_id and a text; no shuffle."""
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), "text")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            # Short and long texts throw as many darts: their number bounds the memory.
            for chunk in chunks(batch.column("text"), rows=TEXTS_AT_ONCE):
                doc, ids, places = shingles(chunk)
                weights = np.ones(len(ids)) if weighting == "binary" else places.astype(np.float64)
                keys = bands(signatures(doc, ids, weights, chunk.rows)).view(np.int64)
                filled = np.bincount(doc, minlength=chunk.rows) > 0
                offsets = np.concatenate([[0], np.cumsum(filled * keys.shape[1])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[filled].ravel()))
                at = slice(chunk.first, chunk.first + chunk.rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[at] for c in ("doc_id", "a", "b")), lists], ["doc_id", "a", "b", "keys"])

    return arrow_map(keyed, run, "doc_id long, a long, b long, keys array<long>")


NODE = "struct<doc_id: long, a: long>"


def node(doc_id: str, key: Column) -> Column:
    """What stands for a text: the smallest doc_id that has it, then its key, as a doc_id may stand on several texts."""
    return F.struct(F.col(doc_id).alias("doc_id"), key.alias("a"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(rep, set): the shingle ids of each row (rep, text); rep is a node."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                doc, ids, _ = shingles(chunk)
                bounds = np.searchsorted(doc, np.arange(chunk.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("rep")[chunk.first : chunk.first + chunk.rows], pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.view(np.int64)))], ["rep", "set"])

    return arrow_map(docs.select("rep", "text"), run, f"rep {NODE}, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, shared, similarity) of pairs (u, v): shingles that both have, and the Jaccard similarity."""
    one = pairs.join(sets.withColumnsRenamed({"rep": "u", "set": "set_u"}), "u")
    two = one.join(sets.withColumnsRenamed({"rep": "v", "set": "set_v"}), "v")
    both = two.withColumn("shared", F.size(F.array_intersect("set_u", "set_v")))
    return both.select("u", "v", "shared", (F.col("shared") / (F.size("set_u") + F.size("set_v") - F.col("shared"))).alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in edges (u, v): the smallest id that it is connected with."""
    links = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return links.select(F.col("u").alias("id"), F.col("v").alias("label"))
        state = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, spent = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct()), links
        drop(least, large, low, spent)


def linked(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, label) of the nodes (rep, keys) that are linked to a smaller one, as the module's description says."""
    buckets = nodes.select("rep", F.explode("keys").alias("key"))
    shared = cut(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    placed = cut(buckets.join(shared, "key"))
    degree = cut(placed.groupBy("rep").agg((F.sum("n") - F.count(F.lit(1)) + unit_hash("rep")).alias("degree")))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(node("doc_id", F.xxhash64("text")).alias("rep"), "text")
    sets = cut(shingle_sets(by_ids(texts, degree.select("rep"), "rep", "left_semi")).dropDuplicates(["rep"]))
    members = cut(placed.join(degree, "rep").join(sets.select("rep", F.size("set").alias("size")), "rep").select("key", "n", "rep", "degree", "size"))
    drop(shared, placed, degree)

    # met<k>: shingles that a member shares with its bucket's k-th leader; null if it was near an earlier one.
    rest, judged = members, None
    for k in range(LEADERS):
        leaders = rest.groupBy("key").agg(F.max_by("rep", "degree").alias("leader"))
        led = cut(rest.join(leaders, "key").select("key", "rep", "degree", "size", "leader", F.greatest("rep", "leader").alias("u"), F.least("rep", "leader").alias("v")))
        pairs = led.where("u <> v").select("u", "v").distinct()
        new = cut(verified(pairs if judged is None else pairs.join(judged, ["u", "v"], "left_anti"), sets))
        judged = new if judged is None else judged.union(new)
        own = F.col("u") == F.col("v")
        met = cut(led.join(judged, ["u", "v"], "left").select("key", "rep", "degree", "size", F.when(own, F.col("size")).otherwise(F.col("shared")).alias(f"met{k}"), F.coalesce(own | (F.col("similarity") >= similarity), F.lit(False)).alias("near")))
        drop(led)
        both = members.join(met.select("key", "rep", f"met{k}"), ["key", "rep"], "left") if k else members.drop("degree").join(met.select("key", "rep", "met0"), ["key", "rep"])
        members, old = cut(both), members
        rest, spent = cut(met.where("NOT near").drop("near", f"met{k}")), rest
        drop(met, old, spent)
        if rest.isEmpty():
            break
    names = [c for c in members.columns if c.startswith("met")]
    return united(members, judged, sets, similarity, names)


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with several components, with their `label`, and their bucket's largest component as `home`."""
    placed = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    kinds = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    homes = kinds.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("home"), F.count(F.lit(1)).alias("kinds"))
    return placed.join(homes.where("kinds > 1").drop("kinds"), "key")


def lone(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, lone): how many shingles each of the texts `reps` has that no other of them has."""
    each = sets.join(reps, "rep", "left_semi").select("rep", F.explode("set").alias("shingle"))
    single = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.first("rep").alias("rep")).where("n = 1")
    return single.groupBy("rep").agg(F.count(F.lit(1)).cast("int").alias("lone"))


def may_link(similarity: float, met: list[str]) -> Column:
    """Whether the bounds of the module's description leave a link between a member and the one with columns <name>_s."""
    reach = similarity - 1e-9
    open_ = F.least("size", "size_s") >= F.greatest("size", "size_s") * reach
    for c in met:
        more = F.least(F.col("size") - F.col(c) - F.col("lone"), F.col("size_s") - F.col(f"{c}_s") - F.col("lone_s"))
        most = F.least(F.col(c), F.col(f"{c}_s")) + F.greatest(more, F.lit(0))
        # most / (both sizes - most) >= similarity, without a division
        open_ = open_ & F.coalesce(most * (1 + reach) >= (F.col("size") + F.col("size_s")) * reach, F.lit(True))
    return open_


def united(members: DataFrame, judged: DataFrame, sets: DataFrame, similarity: float, met: list[str]) -> DataFrame:
    """(id, label) once every two members (key, n, rep, size, met...) of a bucket are of one component, judged, or ruled out."""
    labels = cut(components(judged.where(F.col("similarity") >= similarity).select("u", "v")))
    mixed = cut(_mixed(members, labels).drop("label", "home"))
    drop(members)
    hot = mixed.where(F.col("n") >= HOT).select("rep").distinct()
    single = cut(lone(sets, hot))
    members = cut(mixed.join(single, "rep", "left").withColumn("lone", F.when(F.col("n") >= HOT, F.coalesce("lone", F.lit(0))).otherwise(F.lit(0))))
    drop(mixed, single)
    for portion in PORTIONS:
        mixed = cut(_mixed(members, labels).withColumn("parts", F.ceil(F.col("n") / BLOCK)))
        if mixed.isEmpty():
            break
        # Of two components one isn't the bucket's largest: its members go to each block of the others.
        strays = mixed.where("label <> home").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_s") for c in ("rep", "label", "size", "lone", *met)))
        blocks = mixed.withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
        u, v = F.greatest("rep", "rep_s"), F.least("rep", "rep_s")
        once = (F.col("label") == F.col("home")) | (F.col("rep") < F.col("rep_s"))
        chosen = (F.col("label") != F.col("label_s")) & once & may_link(similarity, met) & (unit_hash(u, v) < portion)
        pairs = blocks.join(strays, ["key", "part"]).where(chosen).select(u.alias("u"), v.alias("v"))
        new = cut(verified(pairs.distinct().join(judged, ["u", "v"], "left_anti"), sets))
        drop(mixed)
        judged = judged.union(new)
        found = new.where(F.col("similarity") >= similarity)
        if found.isEmpty():
            continue
        known = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}"))
        joints = found.join(known("u"), "u", "left").join(known("v"), "v", "left").select(F.coalesce("label_u", "u").alias("u"), F.coalesce("label_v", "v").alias("v"))
        merged = cut(components(joints))
        moved = labels.join(merged.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        labels, old = cut(moved.union(merged)), labels
        drop(old, merged)
    return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "binary") -> DataFrame:
    """(doc_id, text_key, class_id) for each row of `docs` (doc_id, text); text_key is xxhash64 of the text."""
    marked = cut(signed(docs, weighting))
    copies = cut(marked.groupBy("a", "b").agg(F.min("doc_id").alias("rep")))
    member = cut(marked.select("doc_id", "a", "b").join(copies, ["a", "b"]).select("doc_id", "a", node("rep", F.col("a")).alias("rep")))
    nodes = marked.join(copies.select("a", "b", F.col("rep").alias("doc_id")), ["a", "b", "doc_id"], "left_semi").where(F.size("keys") > 0).dropDuplicates(["doc_id", "a", "b"])
    labels = linked(nodes.select(node("doc_id", F.col("a")).alias("rep"), "keys"), docs, similarity)
    named = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("a").alias("text_key"), F.coalesce("label", "rep")["doc_id"].alias("class_id"))
    alone = docs.where("doc_id IS NULL OR text IS NULL").select("doc_id", F.xxhash64("text").alias("text_key"), F.col("doc_id").alias("class_id"))
    return named.union(alone)


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the rows that another document of their class stands for; rows without doc_id stay."""
    held = unused(docs, "text_key")
    keyed = docs.withColumn(held, F.xxhash64("text"))
    named = classes(docs, similarity)
    dropped = cut(named.where("class_id <> doc_id").select("doc_id", F.col("text_key").alias(held)).distinct())
    kept = by_ids(keyed, dropped, ["doc_id", held], "left_anti")
    # Of rows that repeat a document one stays; only such rows are shuffled whole.
    again = cut(keyed.where("doc_id IS NOT NULL").groupBy("doc_id", held).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if not again.isEmpty():
        once = by_ids(kept, again, ["doc_id", held], "left_semi").dropDuplicates(["doc_id", held])
        kept = by_ids(kept, again, ["doc_id", held], "left_anti").union(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the class of near copies it belongs to."""
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")
