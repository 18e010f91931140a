"""Quality rules: a short-circuit cascade of text rules, all in DataFrame functions.

Each rule's cost and selectivity (share of rows it rejects) are measured on a bounded sample drawn from all rows.
A cost is that of the statistics which no rule before it has computed; a statistic's is the difference between two
runs over the sample, repeated once and REPEATS times, so that what a job costs whatever its rows falls
out. The cascade runs the rules by rejection per cost, highest first. A rule's own statistics are computed in its turn, and only for rows that all earlier rules passed
(`kept_only`, which returns no statistics); `apply` owes the base statistics of every row and gates the others.
The verdict is a conjunction, so the measured order changes only how much work is done, never the result.

Edge cases: a null text counts as empty; an empty text has no words, fails the base and is not
kept; repeated rows are judged each on its own; further columns pass through `apply` and `kept_only` untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import runtime
from tessera.llm.runtime import SPACE_CLASS, cut, drop, read, unused

#: Rows of the sample on which costs and selectivities are measured, and how often the longer run repeats it.
SAMPLE_ROWS = 400
REPEATS = 9
#: Seconds of a rule's comparison alone, about.
TEST = 1e-8
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """A named rejection test over the statistics `needs`; `rejects` gets a function from their names to columns."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


#: Limits of the default rules; each is a share of the text's words, letters or lines.
RULES = [
    Rule("symbols", ("n_symbols", "n_words"), lambda c: c("n_symbols") * 10 > c("n_words") * 3),
    Rule("word_length", ("word_chars", "n_words"), lambda c: (c("word_chars") < c("n_words") * 2) | (c("word_chars") > c("n_words") * 14)),
    Rule("repetition", ("n_repeat_words", "n_words"), lambda c: c("n_repeat_words") * 10 > c("n_words") * 3),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda c: (c("n_dup_lines") > 2) & (c("n_dup_lines") * 10 > c("n_lines") * 3)),
    Rule("shouting", ("n_shouts", "n_words"), lambda c: c("n_shouts") * 10 > c("n_words") * 3),
    Rule("exclaiming", ("n_bangs", "n_words"), lambda c: c("n_bangs") * 10 > c("n_words") * 3),
]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_rules(min_words: int = MIN_WORDS) -> list[Rule]:
    """The base limits as rules of a cascade."""
    return [
        Rule("base_short", ("n_words",), lambda c: c("n_words") < min_words),
        Rule("base_repetition", ("n_repeat_words", "n_words"), lambda c: c("n_repeat_words") * 100 > c("n_words") * 50),
    ]


def with_statistics(docs: DataFrame, text: str, prefix: str, names: set[str] | None = None, gate: Column | None = None) -> DataFrame:
    """Add statistics as columns `prefix + name`, null where `gate` is not true; projections only, no shuffle.

    Words in repeated 3-word windows are found by sorting the text's window hashes together with
    their positions; texts without any repeated hash skip that. Words and windows of one text are compared
    by 64-bit hashes.
    """
    names = {*BASE, "n_lines"} if names is None else names
    c = lambda name: F.col(f"`{prefix}{name}`")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    gated = (lambda e: F.when(gate, e)) if gate is not None else (lambda e: e)
    repeats, lines = "n_repeat_words" in names, bool(names & {"n_lines", "n_dup_lines"})
    simple = {
        "n_words": F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")),
        "n_shouts": F.regexp_count(body, F.lit(r"[A-Z]{2}")),
        "n_bangs": F.regexp_count(body, F.lit("!")),
    }
    add = {f"{prefix}{n}": gated(simple[n].cast("long")) for n in simple if n in names and not (repeats and n == "n_words")}
    if repeats:
        add[f"{prefix}hashes"] = gated(F.transform(F.array_remove(F.split(body, f"{SPACE_CLASS}+"), ""), lambda w: F.xxhash64(w)))
    if lines:
        add[f"{prefix}lines"] = gated(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = docs.withColumns(add)
    counts = {}
    if repeats and "n_words" in names:
        counts["n_words"] = F.size(c("hashes"))
    if "n_lines" in names:
        counts["n_lines"] = F.size(c("lines"))
    if "n_dup_lines" in names:
        counts["n_dup_lines"] = F.size(c("lines")) - F.size(F.array_distinct(c("lines")))
    add = {f"{prefix}{n}": gated(v.cast("long")) for n, v in counts.items()}
    if repeats:
        third = lambda h, i: F.xxhash64(h, F.get(c("hashes"), i + 1), F.get(c("hashes"), i + 2))
        add[f"{prefix}windows"] = F.when(F.size(c("hashes")) >= 3, F.transform(F.slice(c("hashes"), F.lit(1), F.size(c("hashes")) - 2), third))
    df = df.withColumns(add).drop(f"{prefix}lines", f"{prefix}hashes") if add else df
    if not repeats:
        return df
    df = df.withColumn(
        f"{prefix}sorted",
        F.when(
            F.size(F.array_distinct(c("windows"))) < F.size(c("windows")),
            F.array_sort(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop(f"{prefix}windows")
    same = lambda x, k: F.coalesce(F.get(c("sorted"), k)["h"] == x["h"], F.lit(False))
    df = df.withColumn(
        f"{prefix}at",
        F.filter(F.transform(c("sorted"), lambda x, k: F.when(same(x, k + 1) | same(x, k - 1), x["i"])), lambda i: i.isNotNull()),
    ).drop(f"{prefix}sorted")
    covered = F.array_distinct(F.concat(c("at"), F.transform(c("at"), lambda i: i + 1), F.transform(c("at"), lambda i: i + 2)))
    return df.withColumn(f"{prefix}n_repeat_words", gated(F.coalesce(F.size(covered), F.lit(0)).cast("long"))).drop(f"{prefix}at")


def measure(docs: DataFrame, text: str, rules: list[Rule], known: set[str] = frozenset(), seed: int = 42) -> list[dict]:
    """Cost (seconds a row) and selectivity of each rule on the sample, in cascade order; empty without sample rows.

    A rule's cost is that of its statistics which neither `known` nor the rules before it have. The sample is about
    SAMPLE_ROWS rows of all partitions, kept as a table: no text comes to the driver.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    sample = cut(rows.sample(min(1.0, SAMPLE_ROWS / max(rows.count(), 1)), seed))
    n = sample.count()
    if not n:
        return []
    every = set().union(*(r.needs for r in rules)) if rules else set()
    cost = {name: _cost(sample, name) / n for name in sorted(every - set(known))}
    hits = with_statistics(sample, "text", "q_", every).agg(
        *(F.count_if(F.coalesce(r.rejects(lambda name: F.col(f"q_{name}")), F.lit(False))).alias(r.name) for r in rules)
    ).first() if rules else {}
    drop(sample)
    out, left, known = [], sorted(rules, key=lambda r: r.name), set(known)
    while left:
        found = [{"rule": r.name, "cost": TEST + sum(cost[x] for x in set(r.needs) - known), "selectivity": hits[r.name] / n} for r in left]
        best = max(range(len(left)), key=lambda k: (found[k]["selectivity"] / found[k]["cost"], -found[k]["cost"], -k))
        out.append(found[best] | {"rank": found[best]["selectivity"] / found[best]["cost"]})
        known |= set(left.pop(best).needs)
    return out


def _cost(sample: DataFrame, name: str) -> float:
    """Seconds that one statistic of all rows of the sample takes."""

    def run(times: int) -> float:
        repeated = sample.coalesce(1).withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        with_statistics(repeated, "text", "q_", {name}).agg(F.sum(f"q_{name}")).first()
        return time.perf_counter() - began

    run(1)
    return max(run(REPEATS) - run(1), 0.0) / (REPEATS - 1)


def ordered(docs: DataFrame, text: str, rules: list[Rule], known: set[str] = frozenset()) -> list[Rule]:
    order = [m["rule"] for m in measure(docs, text, rules, known)]
    return sorted(rules, key=lambda r: order.index(r.name) if r.name in order else len(order))


def cascade(docs: DataFrame, rules: list[Rule], text: str, prefix: str, verdict: str, known: set[str], gate: Column | None = None) -> DataFrame:
    """Add the boolean column `verdict`: no rule rejects, and `gate` is true if given.

    Each rule adds the statistics that no earlier one did, for the rows that are still in; a row that has left
    keeps nulls there.
    """
    c = lambda n: F.col(f"`{prefix}{n}`")
    df, known = docs.withColumn(verdict, F.lit(True) if gate is None else gate), set(known)
    for rule in rules:
        df = with_statistics(df, text, prefix, set(rule.needs) - known, F.col(f"`{verdict}`"))
        known |= set(rule.needs)
        df = df.withColumn(verdict, F.when(F.col(f"`{verdict}`"), ~F.coalesce(rule.rejects(c), F.lit(False))).otherwise(F.lit(False)))
    return df


def apply(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, prefix: str = "q_", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the base statistics, `base_failed` and `kept` added under `prefix`; every row stays."""
    rules = RULES if rules is None else rules
    c = lambda n: F.col(f"`{prefix}{n}`")
    base = with_statistics(docs, text, prefix)
    failed = F.lit(False)
    for rule in base_rules(min_words):
        failed = failed | rule.rejects(c)
    judged = base.withColumn(f"{prefix}base_failed", failed)
    known = {*BASE, "n_lines"}
    kept = cascade(judged, ordered(docs, text, rules, known), text, prefix, f"{prefix}kept", known, ~c("base_failed"))
    own = [*BASE, "base_failed", "kept"]
    return kept.select(*(F.col(f"`{n}`") for n in docs.columns if n not in {f"{prefix}{o}" for o in own}), *(c(o) for o in own))


def kept_only(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` that the base limits and all rules keep, with the columns of `docs`.

    The base limits take part in the cascade: nothing is computed for a row that has left it.
    """
    rules = base_rules(min_words) + (RULES if rules is None else rules)
    prefix = unused(docs, "q_")
    judged = cascade(docs, ordered(docs, text, rules), text, prefix, f"{prefix}kept", set())
    return runtime.kept_only(judged, F.col(f"`{prefix}kept`")).select(*(F.col(f"`{n}`") for n in docs.columns))


OUTPUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the base statistics and both verdicts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return apply(docs).select("doc_id", *(F.col(f"q_{n}").alias(n) for n in OUTPUT))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n >= 2
), p AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS t(o) GROUP BY rid
), s AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(text, '[A-Z]{2}')) AS shouts, len(regexp_extract_all(text, '!')) AS bangs
  FROM w LEFT JOIN p USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words * 3 OR word_chars < n_words * 2 OR word_chars > n_words * 14
            OR n_repeat_words * 10 > n_words * 3 OR (n_dup_lines > 2 AND n_dup_lines * 10 > n_lines * 3) OR shouts * 10 > n_words * 3
            OR bangs * 10 > n_words * 3) AS kept
FROM f
"""
