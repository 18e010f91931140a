"""URL filters: rules by longest match, and a path-template tree for the urls that no rule fits.

1. Each url's path is cut into segments; numbers and hexadecimal names become marks, which gives its
   skeleton. Urls are aggregated by (host, skeleton) with their labels: from here on the tree works on
   skeletons, a hot host costs partial sums only. What is below level DEPTH is one segment, marks included.
2. Top down, one level of all hosts at a time: below a node with more than FANOUT different segments,
   those with less than SHARE of its urls become a wildcard.
3. Bottom up, one level of all hosts at a time: of a node's children with MIN_URLS urls, those that two tests can't
   tell from their siblings' sum are merged, their segment becomes a wildcard. Shape: a two-sample chi-square of
   what stands below them, which branches without labels take part in. Labels: a two-proportion test (Z standard
   deviations) of the blocked shares, where both sides have labels. Merged levels are the shapes of the next one up.
4. A template is rejected if it has labels and its smoothed purity reaches PURITY:
   (blocked + s * overall rate) / (labelled + s), where s = STRENGTH + UNKNOWN * urls without a label,
   so the fewer of a template's urls are labelled, the purer they must be. Labels are what the rules say;
   `templates` takes any.

Edge cases: a null url, and one without "://", has an empty host and path and takes part as such; a
path of "/" alone and an empty one are different skeletons; with no labels nothing is rejected; an empty
table gives no rows; repeated rows are judged each on its own; further columns pass through `judge`, but for
columns of the names that it adds, which it replaces.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.runtime import cut, drop, read, unused

# The rules (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEPTH = 6
FANOUT = 8
SHARE = 0.05
Z = 2.0
MIN_URLS = 5
STRENGTH = 4.0
UNKNOWN = 0.25
PURITY = 0.8
ADDED = ["url_host", "url_path", "url_rule", "url_template", "url_purity", "url_verdict"]

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, else null."""
    found = None
    for name, prefix, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def skeleton(path: Column) -> Column:
    """The path's segments with numbers as <n> and long hexadecimal names as <x>; what is below DEPTH is one segment."""
    marked = lambda s: F.when(s.rlike("^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]") & s.rlike("[a-fA-F-]"), F.lit("<x>")).otherwise(F.regexp_replace(s, "[0-9]+", "<n>"))
    return F.transform(F.split(path, "/", DEPTH + 2), marked)


def templates(urls: DataFrame) -> DataFrame:
    """(host, skeleton, template, blocked, labelled, urls, purity) from rows (host, skeleton, label): label 1 blocked, 0 allowed, null unknown."""
    counted = urls.groupBy("host", "skeleton").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.col("label"), F.lit(0))).alias("blocked"),
        F.count("label").alias("labelled"),
    )
    tree = cut(counted.withColumn("template", F.col("skeleton")))
    deepest = tree.agg(F.max(F.size("skeleton"))).first()[0] or 0
    # Level 0 is what stands before a path's first slash: nothing.
    for level in range(1, deepest):
        tree = _rewritten(tree, level, _variable)
    for level in range(deepest - 1, 0, -1):
        tree = _rewritten(tree, level, _similar)
    tree = tree.withColumn("template", F.array_join("template", "/"))
    whole = tree.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    overall = (whole["b"] or 0) / whole["l"] if whole["l"] else 0.0
    sums = tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.sum("n").alias("urls"))
    strength = F.lit(STRENGTH) + F.lit(UNKNOWN) * (F.col("urls") - F.col("labelled"))
    purity = (F.col("blocked") + strength * overall) / (F.col("labelled") + strength)
    return tree.select("host", "skeleton", "template").join(sums.withColumn("purity", purity), ["host", "template"])


def _rewritten(tree: DataFrame, level: int, chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The tree with a wildcard at `level` of the branches (host, node, segment) that `chosen` names; the old table goes."""
    branch = tree.withColumns({
        "node": F.slice("template", 1, level),
        "segment": F.get("template", F.lit(level)),
        "below": F.slice("template", level + 2, DEPTH + 2),
    })
    wild = cut(chosen(branch.where("segment IS NOT NULL")).select("host", "node", "segment", F.lit(True).alias("wild")))
    starred = F.concat("node", F.array(F.lit("*")), "below")
    made = cut(branch.join(wild, ["host", "node", "segment"], "left").withColumn("template", F.when(F.col("wild"), starred).otherwise(F.col("template"))).select(tree.columns))
    drop(tree, wild)
    return made


def _variable(branch: DataFrame) -> DataFrame:
    """Rare segments of nodes with many."""
    kids = branch.groupBy("host", "node", "segment").agg(F.sum("n").alias("kid"))
    nodes = kids.groupBy("host", "node").agg(F.sum("kid").alias("total"), F.count(F.lit(1)).alias("fan"))
    return kids.join(nodes, ["host", "node"]).where((F.col("fan") > FANOUT) & (F.col("kid") < SHARE * F.col("total")))


def _similar(branch: DataFrame) -> DataFrame:
    """Branches that neither the shape below them nor their labels tell from their siblings."""
    cells = branch.groupBy("host", "node", "segment", "below").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    shapes = cells.groupBy("host", "node", "below").agg(F.sum("n").alias("all_n"))
    kids = cells.groupBy("host", "node", "segment").agg(F.sum("n").alias("kid_n"), F.sum("b").alias("b"), F.sum("l").alias("l"))
    nodes = kids.groupBy("host", "node").agg(F.sum("kid_n").alias("node_n"), F.sum("b").alias("node_b"), F.sum("l").alias("node_l"), F.count(F.lit(1)).alias("fan"))
    nodes = nodes.where("fan > 1").join(shapes.groupBy("host", "node").agg((F.count(F.lit(1)) - 1).alias("freedom")), ["host", "node"])
    open_kids = kids.join(nodes, ["host", "node"]).withColumn("rest_n", F.col("node_n") - F.col("kid_n")).where(F.col("kid_n") >= MIN_URLS)
    # Sum over the shapes of (n * sqrt(rest / kid) - others * sqrt(kid / rest))^2 / all; shapes that the branch lacks add others * kid / rest.
    other = F.col("all_n") - F.col("n")
    term = F.pow(F.col("n") * F.sqrt(F.col("rest_n") / F.col("kid_n")) - other * F.sqrt(F.col("kid_n") / F.col("rest_n")), 2) / F.col("all_n")
    met = cells.select("host", "node", "segment", "below", "n").join(shapes, ["host", "node", "below"]).join(open_kids.select("host", "node", "segment", "kid_n", "rest_n"), ["host", "node", "segment"])
    apart = met.groupBy("host", "node", "segment").agg((F.sum(term) + (F.first("kid_n") / F.first("rest_n")) * (F.first("rest_n") - F.sum(other))).alias("apart"))
    rest_b, rest_l = F.col("node_b") - F.col("b"), F.col("node_l") - F.col("l")
    share = F.col("node_b") / F.col("node_l")
    spread = F.lit(Z) * F.sqrt(share * (1 - share) * (1 / F.col("l") + 1 / rest_l))
    agree = (F.col("l") == 0) | (rest_l == 0) | (F.abs(F.col("b") / F.col("l") - rest_b / rest_l) <= spread + 1e-9)
    alike = F.col("apart") <= F.col("freedom") + Z * F.sqrt(2 * F.col("freedom")) + 1e-9
    merged = open_kids.join(apart, ["host", "node", "segment"]).where(alike & agree)
    several = merged.groupBy("host", "node").agg(F.count(F.lit(1)).alias("merged")).where("merged > 1")
    return merged.join(several, ["host", "node"])


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """`pages` with the columns ADDED: url_host, url_path, url_rule, url_template, url_purity, url_verdict; every row stays."""
    own = unused(pages, "tree_")
    split = pages.withColumn(f"{own}url", F.col(f"`{url}`")).drop(*ADDED)
    split = split.withColumns({"url_host": host_of(F.col(f"{own}url")), "url_path": path_of(F.col(f"{own}url"))}).drop(f"{own}url")
    found = longest_rule(F.col("url_host"), F.col("url_path"), RULES if rules is None else rules)
    ruled = split.withColumns({f"{own}found": found, f"{own}skeleton": skeleton(F.col("url_path"))})
    verdict = F.col(f"{own}found.verdict")
    label = F.when(verdict == "block", 1).when(verdict == "allow", 0)
    # Written, so that both sides of the join below are dealt anew and a hot host's part can be split.
    known = cut(templates(ruled.select(F.col("url_host").alias("host"), F.col(f"{own}skeleton").alias("skeleton"), label.alias("label")))).select(
        F.col("host").alias("url_host"), F.col("skeleton").alias(f"{own}skeleton"), F.col("template").alias("url_template"), F.col("purity").alias("url_purity"),
        ((F.col("labelled") > 0) & (F.col("purity") >= PURITY)).alias(f"{own}rejected"),
    )
    learnt = F.when(F.col(f"{own}rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(known, ["url_host", f"{own}skeleton"], "left").withColumns({
        "url_rule": F.col(f"{own}found.rule"),
        "url_verdict": F.coalesce(verdict, learnt),
    }).select(*(F.col(f"`{c}`") for c in pages.columns if c not in ADDED), *ADDED)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: host, path, the rule that fits, and the verdict."""
    judged = judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *(F.col(f"url_{n}").alias(n) for n in ("host", "path", "rule", "verdict", "template", "purity")))


def _rewriting(k: int, level: int, wild: str) -> str:
    """The common tables that make tree<k+1> of tree<k> by the branches that the table wild<k> names."""
    return f"""
branch{k} AS (SELECT *, template[1:{level}] AS node, template[{level + 1}] AS segment, template[{level + 2}:] AS below FROM tree{k}),
{wild},
tree{k + 1} AS (SELECT b.host, skeleton, n, blocked, labelled, CASE WHEN w.host IS NULL THEN template ELSE list_concat(list_append(b.node, '*'), b.below) END AS template
  FROM branch{k} AS b LEFT JOIN wild{k} AS w ON b.host = w.host AND b.node = w.node AND b.segment = w.segment)"""


def oracle(rules: list[tuple[str, str, str]] | None = None) -> str:
    """The query in DuckDB's SQL; the levels of the tree are one step of common tables each."""
    ordered = sorted(RULES if rules is None else rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in ordered]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for test, name, _ in fits)
    verdict = " ".join(f"WHEN {test} THEN '{v}'" for test, _, v in fits)
    steps, k = [], 0
    for level in range(1, DEPTH + 2):
        steps.append(_rewriting(k, level, f"""
kids{k} AS MATERIALIZED (SELECT host, node, segment, sum(n) AS kid FROM branch{k} WHERE segment IS NOT NULL GROUP BY ALL),
wild{k} AS (SELECT host, node, segment FROM kids{k} WINDOW w AS (PARTITION BY host, node) QUALIFY count(*) OVER w > {FANOUT} AND kid < {SHARE} * sum(kid) OVER w)""".strip()))
        k += 1
    for level in range(DEPTH + 1, 0, -1):
        steps.append(_rewriting(k, level, f"""
cells{k} AS MATERIALIZED (SELECT host, node, segment, below, sum(n) AS n, sum(blocked) AS b, sum(labelled) AS l FROM branch{k} WHERE segment IS NOT NULL GROUP BY ALL),
kids{k} AS (
  SELECT host, node, segment, kid_n, b, l, sum(kid_n) OVER w - kid_n AS rest_n, sum(b) OVER w - b AS rest_b, sum(l) OVER w - l AS rest_l, count(*) OVER w AS fan
  FROM (SELECT host, node, segment, sum(n) AS kid_n, sum(b) AS b, sum(l) AS l FROM cells{k} GROUP BY ALL) WINDOW w AS (PARTITION BY host, node)
), shapes{k} AS (
  SELECT host, node, below, sum(n) AS all_n, count(*) OVER (PARTITION BY host, node) - 1 AS freedom FROM cells{k} GROUP BY host, node, below
), apart{k} AS (
  SELECT host, node, segment, any_value(freedom) AS freedom, any_value(b) AS b, any_value(l) AS l, any_value(rest_b) AS rest_b, any_value(rest_l) AS rest_l,
    sum((n * sqrt(rest_n / kid_n) - (all_n - n) * sqrt(kid_n / rest_n)) ** 2 / all_n) + any_value(kid_n) / any_value(rest_n) * (any_value(rest_n) - sum(all_n - n)) AS apart
  FROM (SELECT host, node, segment, below, n FROM cells{k}) JOIN shapes{k} USING (host, node, below) JOIN kids{k} USING (host, node, segment) WHERE fan > 1 AND kid_n >= {MIN_URLS} GROUP BY host, node, segment
), wild{k} AS (
  SELECT host, node, segment FROM apart{k}
  WHERE apart <= freedom + {Z} * sqrt(2 * freedom) + 1e-9 AND (l = 0 OR rest_l = 0 OR abs(b / l - rest_b / rest_l) <= {Z} * sqrt((b + rest_b) / (l + rest_l) * (1 - (b + rest_b) / (l + rest_l)) * (1 / l + 1 / rest_l)) + 1e-9)
  QUALIFY count(*) OVER (PARTITION BY host, node) > 1
)""".strip()))
        k += 1
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_SPLIT}', 1), '{upper}', '{lower}') AS host, regexp_extract(coalesce(url, ''), '{_SPLIT}', 2) AS path FROM pages
), parts AS (
  SELECT *, string_split(path, '/') AS s FROM split
), ruled AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS said,
         list_transform(CASE WHEN len(s) > {DEPTH + 2} THEN list_append(s[1:{DEPTH + 1}], array_to_string(s[{DEPTH + 2}:], '/')) ELSE s END,
           lambda x: CASE WHEN regexp_matches(x, '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-fA-F-]') THEN '<x>' ELSE regexp_replace(x, '[0-9]+', '<n>', 'g') END) AS skeleton
  FROM parts
), tree0 AS (
  SELECT host, skeleton, count(*) AS n, count(*) FILTER (said = 'block') AS blocked, count(said) AS labelled, skeleton AS template FROM ruled GROUP BY host, skeleton
),{",".join(steps)},
named AS (SELECT host, skeleton, n, blocked, labelled, array_to_string(template, '/') AS template FROM tree{k}),
overall AS (
  SELECT CASE WHEN sum(labelled) > 0 THEN sum(blocked) / sum(labelled) ELSE 0.0 END AS rate FROM named
), judged AS (
  SELECT host, skeleton, template, labels, (blocked + strength * rate) / (labels + strength) AS purity FROM (
    SELECT host, skeleton, template, sum(blocked) OVER w AS blocked, sum(labelled) OVER w AS labels, {STRENGTH} + {UNKNOWN} * (sum(n) OVER w - sum(labelled) OVER w) AS strength
    FROM named WINDOW w AS (PARTITION BY host, template)), overall
)
SELECT page_id, ruled.host, path, rule, coalesce(said, CASE WHEN labels > 0 AND purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM ruled JOIN judged ON ruled.host = judged.host AND ruled.skeleton = judged.skeleton
"""
