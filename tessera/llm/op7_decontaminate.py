"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are folded to words (A-Z lower-cased, words joined by one space). An item of m bytes may
differ from a passage by e = floor(RATE * m) edits. Its e + 1 pieces cannot all be hit by e edits, so
one of them stands in the passage unchanged: an automaton over all pieces finds these places in one
scan of a text. Around each, a q-gram count (necessary for e edits) and then Myers' bit-parallel
distance decide; the bit vectors of a whole item are single Python integers.

A benchmark of at most BLOCK_BYTES of text is one block: it travels with the function, and a text is scanned
where it is read, without a shuffle. A larger one is cut into such blocks, which are scanned one after another, each
by a job of its own over the texts' keys and hits: the driver, a task and its Python worker hold one
block at a time, whatever the benchmark's size. The hits of all blocks, a table of the texts that have any,
are then joined to the rows by text.

Edge cases: null or empty texts and items match nothing; items too short for an edit need an exact place;
an item may begin or end within a word; of several places in one text the nearest, then first, is
reported; repeated items or documents report each on its own; further columns pass through `mark`.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.op1_license import fold
from tessera.llm.runtime import by_ids, cut, drop, kept_only, read, row_wise, unused

RATE = 0.08
GRAM = 4
BLOCK_BYTES = 1 << 21

HITS_DDL = "array<struct<item_id: long, distance: int, first_word: long, last_word: long>>"
HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def folded(text: bytes | None) -> str:
    """The folded text, one character for each UTF-8 byte."""
    return b" ".join(fold(text or b"")).decode("latin-1")


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def nearest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(smallest edit distance of the pattern to a substring of the text, the first place where such a one ends)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        x = peq.get(c, 0) | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(plus | d)), plus & d
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, at = score, j
        x = (up << 1) & full
        minus = x & d
        plus = ((down << 1) & full) | (full & ~(x | d))
    return best, at


class Item:
    """A folded test item with what its check needs."""

    def __init__(self, item_id: int, text: str, rate: float) -> None:
        self.id, self.text, self.m = item_id, text, len(text)
        self.budget = int(rate * self.m)
        self.masks, self.back = masks(text), masks(text[::-1])
        self.grams = [text[i : i + GRAM] for i in range(self.m - GRAM + 1)]
        self.needed = self.m - GRAM + 1 - GRAM * self.budget

    def pieces(self) -> list[tuple[int, str]]:
        n = self.budget + 1
        cuts = [self.m * k // n for k in range(n + 1)]
        return [(cuts[k], self.text[cuts[k] : cuts[k + 1]]) for k in range(n)]

    def check(self, window: str) -> tuple[int, int, int] | None:
        """(distance, begin, end) of the nearest passage in the window, if within the budget."""
        if self.needed > 0:
            there = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
            if sum(g in there for g in self.grams) < self.needed:
                return None
        distance, end = nearest(self.masks, self.m, window)
        if distance > self.budget:
            return None
        _, length = nearest(self.back, self.m, window[:end][::-1])
        return distance, end - length, end


class Matcher:
    """One block of items: the automaton over their pieces."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        places: dict[str, list] = defaultdict(list)
        for item_id, text in items:
            if line := folded(text):
                item = Item(item_id, line, rate)
                for offset, piece in item.pieces():
                    places[piece].append((item, offset))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def hits(self, text: bytes | None) -> list[dict]:
        if self.empty or not text:
            return []
        line = folded(text)
        begins: dict[Item, set[int]] = defaultdict(set)
        for end, (length, found) in self.automaton.iter(line):
            for item, offset in found:
                begins[item].add(end + 1 - length - offset)
        out = []
        for item, starts in begins.items():
            best, reach = None, None
            for start in sorted(starts):
                # Starts within the budget of each other look at one window.
                if reach is not None and start <= reach[1]:
                    reach[1] = max(reach[1], start + item.budget)
                    continue
                best = self._better(best, item, line, reach)
                reach = [start, start + item.budget]
            best = self._better(best, item, line, reach)
            if best:
                distance, begin, end = best
                out.append({"item_id": item.id, "distance": distance, "first_word": begin + 1, "last_word": end})
        if out:
            # Word places from ends in bytes, by one list of the line's spaces.
            spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 0x20)
            for x in out:
                x |= {k: int(np.searchsorted(spaces, x[k])) for k in ("first_word", "last_word")}
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["distance"], x["first_word"]))

    @staticmethod
    def _better(best: tuple | None, item: Item, line: str, reach: list | None) -> tuple | None:
        if reach is None:
            return best
        low = max(0, reach[0] - item.budget)
        found = item.check(line[low : reach[1] + item.m + item.budget])
        if found and (best is None or found[0] < best[0]):
            return found[0], found[1] + low, found[2] + low
        return best


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", rate: float = RATE) -> DataFrame:
    """`docs` with the array column `out` of the benchmark's items (item_id, text) that each text contains."""
    items = benchmark.where("text IS NOT NULL").select("item_id", F.col("text").cast("binary").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    if total <= BLOCK_BYTES:
        block = [(r["item_id"], bytes(r["text"])) for r in items.collect()]
        return docs.withColumn(out, _column(sorted(block, key=repr), rate)(body) if block else F.array().cast(HITS_DDL))
    key = unused(docs, "text_key")
    keyed = docs.withColumns({f"{key}a": F.xxhash64(body), f"{key}b": F.xxhash64(F.lit(1), body)})
    found = _in_blocks(keyed.select(F.col(f"{key}a").alias("a"), F.col(f"{key}b").alias("b"), body.alias("text")), items, -(-2 * total // BLOCK_BYTES), rate)
    hits = found.select(F.col("a").alias(f"{key}a"), F.col("b").alias(f"{key}b"), F.col("hits").alias(f"{key}hits"))
    joined = by_ids(keyed, hits, [f"{key}a", f"{key}b"], "left")
    return joined.withColumn(out, F.coalesce(f"{key}hits", F.array().cast(HITS_DDL))).drop(f"{key}a", f"{key}b", f"{key}hits")


def _in_blocks(texts: DataFrame, items: DataFrame, blocks: int, rate: float) -> DataFrame:
    """(a, b, hits) of each text (a, b, text) with hits, as a table; items are dealt to blocks of about half the bound by their hash."""
    dealt = cut(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    parts = []
    for k in range(blocks):
        block = [(r["item_id"], bytes(r["text"])) for r in dealt.where(F.col("block") == k).collect()]
        if block:
            scanned = texts.select("a", "b", _column(sorted(block, key=repr), rate)(F.col("text")).alias("hits"))
            parts.append(cut(kept_only(scanned, F.size("hits") > 0).groupBy("a", "b").agg(F.first("hits").alias("hits"))))
    whole = reduce(DataFrame.union, parts).groupBy("a", "b").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    made = cut(whole)
    drop(dealt, *parts)
    return made


def _column(block: list[tuple[int, bytes]], rate: float):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        matcher = Matcher(block, rate)
        for texts in batches:
            yield pa.array([matcher.hits(t) for t in texts.cast(pa.binary()).to_pylist()], HITS)

    return row_wise(run, HITS_DDL)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it contains, with its edit distance and place in words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs, read(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
