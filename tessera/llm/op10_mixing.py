"""Mixing sources to target weights by Sainte-Laguë apportionment, all in DataFrame functions.

1. Sizes: words of every text, written once as a narrow table; only sums of it are aggregated.
2. Targets: each source gets `share` times all words by weight, stopped at `max_repeats` times its
   own size; what lies above is reshared by weight. That is water filling, solved in closed form
   over the sources ordered by capacity for a unit of weight.
3. Quotas: the budget is cut into blocks of `block_words` words, dealt to sources by highest
   quotients target / (2 s + 1), then each source's blocks to its shards by shard size. Both use
   `apportion`, which finds for each party the seats it surely gets and ranks only the few open
   quotients: about two for each party, however many blocks there are.
4. Selection: a shard's documents lie on a line in seeded order, `max_repeats` times in a row; the
   shard takes its first so many blocks of that line. `taken` is what of them falls into a document.

Shards are dealt by a hash of the document, and their number follows the square root of all words, so
that a source with a third of all rows is spread over many of them. Reruns agree.

Edge cases: a null text has size 0; null doc_ids and repeated rows are mixed each on its own; null
is a source, the last; without any words every target and every taken is 0; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.runtime import SPACE_CLASS, cut, read

BLOCK_WORDS = 16
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 42


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")).cast("long")


def seeded(seed: int, *columns: Column) -> Column:
    """The first 60 bits of an MD5 of the seed and the columns, as a number."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add `weight` (repeating, sources by code point, null last) and `target` to rows (source, source_size).

    One row per source: the single-partition windows here are as long as the list of sources.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(0))
    level = W.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before = level.rowsBetween(W.unboundedPreceding, -1)
    rest = level.rowsBetween(0, W.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    )
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    budget = F.sum("source_size").over(every).cast("double") * share
    filled = ranked.withColumn("left", budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(rest))
    # The first source that its share of what is left does not fill sets the level for all later ones.
    fits = F.col("cap") * F.col("open") <= F.col("left") * F.col("weight")
    stop = F.min(F.when(~fits, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), (F.col("left") / F.col("open")).alias("unit")))).over(every)
    return filled.withColumn("unit", stop["unit"]).withColumn(
        "target", F.when(F.col("unit").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("unit") * F.col("weight")))
    ).select("source", "source_size", "rank", "weight", "target")


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, tie: list[str], out: str) -> DataFrame:
    """Sainte-Laguë: within each group, deal `seats` (the same on all its rows) by highest quotients.

    With T seats, n parties and V votes, rounding votes * (T - n/2) / V gives no party too many seats and
    votes * (T + n/2) / V none too few; only quotients between the two are ranked.
    """
    whole = W.partitionBy(*(group or [F.lit(0)]))
    v, t = F.col(votes).cast("double"), F.col(seats)
    total, n = F.sum(v).over(whole), F.count(F.lit(1)).over(whole)
    bounded = parties.withColumns({"_total": total, "_n": n}).withColumns({
        "_low": F.when(F.col("_total") > 0, F.greatest(F.lit(0), F.round(v * (t - F.col("_n") / 2) / F.col("_total")).cast("long") - 1)).otherwise(F.lit(0)),
        "_high": F.when(F.col("_total") > 0, F.when(v > 0, F.round(v * (t + F.col("_n") / 2) / F.col("_total")).cast("long") + 1).otherwise(F.lit(0))).otherwise(F.lit(0)),
    }).withColumn("_open", t - F.sum("_low").over(whole))
    bids = bounded.where(F.col("_high") > F.col("_low")).select(
        *group, *tie, "_open", (F.col(votes).cast("double")).alias("_v"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_seat")
    )
    order = W.partitionBy(*(group or [F.lit(0)])).orderBy((F.col("_v") / (2 * F.col("_seat") - 1)).desc(), *tie, F.col("_seat"))
    won = bids.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= F.col("_open")).groupBy(*group, *tie).agg(F.count(F.lit(1)).alias("_won"))
    keys = [*group, *tie]
    joined = bounded.join(won, keys, "left")
    return joined.withColumn(out, F.col("_low") + F.coalesce(F.col("_won"), F.lit(0))).drop("_total", "_n", "_low", "_high", "_open", "_won")


def mix(
    docs: DataFrame,
    text: str = "text",
    block_words: int = BLOCK_WORDS,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of `docs` (doc_id, source and a text)."""
    sizes = cut(docs.select("doc_id", "source", n_words(F.col(text)).alias("size")))
    # (source, known) stands for the source, as null equals nothing in a join.
    sizes = sizes.withColumns({"known": F.col("source").isNotNull(), "name": F.coalesce("source", F.lit(""))})
    by_source = sizes.groupBy("name", "known").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, round(total**0.5 / 30))
    placed = sizes.withColumn("place", seeded(seed, F.col("doc_id"), F.col("size"))).withColumn("shard", F.pmod(F.col("place"), F.lit(shards)))
    shard_sizes = placed.groupBy("name", "known", "shard").agg(F.sum("size").alias("shard_size"))

    blocks = round(min(share, max_repeats) * total / block_words)
    goal = targets(by_source.select("source", "source_size", "name", "known").drop("name", "known"), weights, share, max_repeats)
    goal = goal.withColumns({"known": F.col("source").isNotNull(), "name": F.coalesce("source", F.lit("")), "seats": F.lit(blocks)})
    goal = cut(apportion(goal, [], "target", "seats", ["rank"], "source_blocks").select("name", "known", "source_size", "target", "source_blocks"))
    quotas = apportion(shard_sizes.join(goal, ["name", "known"]), ["name", "known"], "shard_size", "source_blocks", ["shard"], "blocks")

    line = W.partitionBy("name", "known", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    laid = placed.withColumn("start", F.sum("size").over(line) - F.col("size"))
    mixed = laid.join(quotas.select("name", "known", "shard", "shard_size", "source_size", "target", (F.col("blocks") * block_words).alias("quota")), ["name", "known", "shard"])
    taken = sum(
        (F.least(F.greatest(F.col("quota") - k * F.col("shard_size") - F.col("start"), F.lit(0)), F.col("size")) for k in range(1, max_repeats)),
        F.least(F.greatest(F.col("quota") - F.col("start"), F.lit(0)), F.col("size")),
    )
    return mixed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS name, source IS NOT NULL AS known,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), total AS (
  SELECT coalesce(sum(size), 0)::BIGINT AS words, greatest(1, round(sqrt(coalesce(sum(size), 0)) / 30))::BIGINT AS shards,
         round(1.5 * coalesce(sum(size), 0) / 16)::BIGINT AS blocks FROM d
), s AS (
  SELECT name, known, sum(size)::BIGINT AS source_size, 2.0 * sum(size)::DOUBLE AS cap,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY known DESC, encode(name)) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         row_number() OVER (ORDER BY known DESC, encode(name)) AS rank
  FROM d GROUP BY name, known
), fill AS (
  SELECT 0 AS step, []::BIGINT[] AS capped, (SELECT 1.5 * words FROM total)::DOUBLE AS budget, (SELECT sum(weight) FROM s) AS open
  UNION ALL
  SELECT step + 1, x.ids, x.budget, x.open FROM fill, LATERAL (
    SELECT list(rank) FILTER (is_full) AS ids, (SELECT 1.5 * words FROM total)::DOUBLE - coalesce(sum(cap) FILTER (is_full), 0) AS budget,
           coalesce(sum(weight) FILTER (NOT is_full), 0) AS open, count(*) FILTER (is_full) AS n
    FROM (SELECT *, list_contains(fill.capped, rank) OR cap * fill.open <= fill.budget * weight AS is_full FROM s)
  ) AS x WHERE x.n > len(fill.capped)
), level AS (
  SELECT capped, budget, open FROM fill ORDER BY step DESC LIMIT 1
), goal AS (
  SELECT s.*, CASE WHEN list_contains(capped, rank) OR open = 0 THEN cap ELSE budget / open * weight END AS target FROM s, level
), seats AS (
  SELECT rank, count(*) AS n FROM (
    SELECT rank, row_number() OVER (ORDER BY quotient DESC, rank, k) AS place FROM (
      SELECT rank, k, target / (2 * k - 1) AS quotient
      FROM (SELECT rank, target, unnest(generate_series(1, (target / 16 + 3)::BIGINT)) AS k FROM goal WHERE target > 0))
  ) WHERE place <= (SELECT blocks FROM total) GROUP BY rank
), placed AS (
  SELECT d.*, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '-') || '|' || size::VARCHAR), 1, 15))::BIGINT AS place FROM d
), dealt AS (
  SELECT placed.*, rank, source_size, target, coalesce(seats.n, 0) AS source_blocks, place % (SELECT shards FROM total) AS shard
  FROM placed JOIN goal USING (name, known) LEFT JOIN seats USING (rank)
), shard AS (
  SELECT rank, shard, any_value(source_blocks) AS source_blocks, sum(size)::DOUBLE AS shard_size FROM dealt GROUP BY rank, shard
), quota AS (
  SELECT rank, shard, count(*) AS n FROM (
    SELECT rank, shard, source_blocks, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * k - 1) DESC, shard, k) AS place FROM (
      SELECT *, unnest(generate_series(1, (shard_size * 2 / 16 + 12)::BIGINT)) AS k FROM shard WHERE shard_size > 0)
  ) WHERE place <= source_blocks GROUP BY rank, shard
), laid AS (
  SELECT dealt.*, coalesce(quota.n, 0) * 16 AS words,
         sum(size) OVER (PARTITION BY rank, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start,
         sum(size) OVER (PARTITION BY rank, shard) AS shard_size
  FROM dealt LEFT JOIN quota USING (rank, shard)
)
SELECT doc_id, size, source_size, target,
       (least(greatest(words - start, 0), size) + least(greatest(words - shard_size - start, 0), size))::BIGINT AS taken
FROM laid
"""
