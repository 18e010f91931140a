"""Operators that compare rows or split the corpus: near duplicates, decontamination, mixing, and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import prose

import corpus_pipeline
from tessera.llm import op6_neardup, op7_decontaminate, op10_mixing
from tessera.llm.op1_license import fold


def brute_classes(docs):
    sets, parent = [], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, text in docs:
        w = fold((text or "").encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if docs[i][1] is not None and (docs[i][1] == docs[j][1] or (union and len(sets[i] & sets[j]) / union >= 0.8)):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(doc_id)
    return {d: min(g) for g in groups.values() for d in g}


def copies(seed):
    """Bases with near copies, among them chains; short and empty texts; exact copies."""
    rng = random.Random(seed)
    rows = []
    for b in range(8):
        words = prose(rng, "en", rng.randint(40, 150)).split()
        for _ in range(rng.randint(1, 12)):
            edited = list(words)
            for _ in range(rng.randint(0, 5)):
                edited[rng.randrange(len(edited))] = "edit" + str(rng.randrange(1000))
            rows.append(" ".join(edited))
            if rng.random() < 0.3:
                words = edited
    rows += ["", "", "one", "ONE!", "one two", "...", "a b c d e", "a b c d e", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    docs = copies(seed)
    got = {r.doc_id: r.class_id for r in op6_neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


def test_hot_groups_of_copies(spark):
    rng = random.Random(7)
    base = prose(rng, "en", 200).split()
    rows = [" ".join(base)] * 150
    for i in range(150):
        edited = list(base)
        edited[rng.randrange(200)] = f"edit{i}"
        rows.append(" ".join(edited))
    rows += [prose(rng, "de", 60) for _ in range(50)]
    got = op6_neardup.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).groupBy("class_id").count().orderBy(F.desc("count")).collect()
    assert (got[0]["class_id"], got[0]["count"]) == (0, 300) and len(got) == 51


def test_texts_linked_to_one_member_of_a_large_family(spark):
    """Of 1,500 near copies of a text, each of eight others is linked to one only, by the shingles of one edit."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(1000)]
    edit = lambda words, places, name: [f"{name}x{i}" if i in places else w for i, w in enumerate(words)]
    members = [edit(base, {5 * rng.randrange(2, 99)}, f"edit{i}") for i in range(1500)]
    far = [edit(members[i], set(rng.sample(range(510, 980, 10), 22)), f"far{i}") for i in range(0, 1500, 200)]
    sets = [set(zip(*(r[k:] for k in range(5)), strict=False)) for r in (base, *members, *far)]
    for text in sets[1501:]:
        assert sum(len(text & s) >= 0.8 * len(text | s) for s in sets[:1501]) == 1
    docs = list(enumerate(" ".join(r) for r in (base, *members, *far)))
    got = {r.doc_id: r.class_id for r in op6_neardup.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(docs) and set(got.values()) == {0}


def family(seed, n, edits, words=200):
    """Texts that differ from one base by some random words each, between the two numbers of `edits`."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    return list(enumerate(" ".join(f"e{i}x{k}" if k in places else w for k, w in enumerate(base)) for i in range(n) for places in [set(rng.sample(range(words), rng.randint(*edits)))]))


@pytest.mark.parametrize(("seed", "edits", "share"), [(31, (0, 7), 0.25), (32, (3, 3), 1.0)])
def test_a_family_around_the_threshold(spark, monkeypatch, seed, edits, share):
    """Every class is that of all pairs; with members near the base, most pairs are ruled out before they are compared."""
    docs, compared = family(seed, 300, edits), []
    verified = op6_neardup.verified

    def counted(pairs, sets):
        made = op6_neardup.cut(verified(pairs, sets))
        compared.append(made.count())
        return made

    monkeypatch.setattr(op6_neardup, "verified", counted)
    got = {r.doc_id: r.class_id for r in op6_neardup.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(docs) and len(set(got.values())) > 5
    assert sum(compared) < share * 300 * 299 / 2


def test_bounds_rule_out_no_link(spark):
    """The bounds against the sets themselves, for random sets and any leader."""
    rng = random.Random(33)
    sets = [set(rng.sample(range(40), rng.randint(10, 25))) | {100 + i for _ in range(rng.randint(0, 1))} | set(range(200, 200 + rng.randint(20, 60))) for i in range(60)]
    seen = {}
    for x in sets:
        for e in x:
            seen[e] = seen.get(e, 0) + 1
    rows = [(i, len(x), sum(seen[e] == 1 for e in x), len(x & sets[0]), len(x & sets[1]) if i % 3 else None) for i, x in enumerate(sets)]
    one = spark.createDataFrame(rows, "i int, size int, lone int, met0 int, met1 int")
    pairs = one.join(one.toDF("j", "size_s", "lone_s", "met0_s", "met1_s"), F.col("i") < F.col("j"))
    for similarity in (0.5, 0.8):
        got = {(r.i, r.j) for r in pairs.where(op6_neardup.may_link(similarity, ["met0", "met1"])).collect()}
        links = {(i, j) for j in range(60) for i in range(j) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
        assert links <= got and len(got) < 60 * 59 / 2
    listed = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "rep int, set array<long>")
    assert {r.rep: r.lone for r in op6_neardup.lone(listed, listed.select("rep")).collect()} == {i: r[2] for i, r in enumerate(rows) if r[2]}


def test_recall_on_documents(spark):
    """Of all pairs at 0.8 or more between every 50th document and all documents, none is apart in its class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in op6_neardup.classes(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = fold((r.text or "").encode())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = [(i, j) for i in sets if i % 50 == 0 for j in sets if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(got) == len(sets) and all(got[i] == got[j] for i, j in links)


def test_a_doc_id_on_two_texts(spark):
    rng = random.Random(19)
    words, other = prose(rng, "en", 100).split(), prose(rng, "de", 100)
    copy = " ".join([*words[:50], "edit", *words[51:]])
    docs = spark.createDataFrame([(3, " ".join(words)), (5, copy), (5, other)], "doc_id long, text string")
    got = {(r.doc_id, r.text, r.class_id) for r in op6_neardup.classes(docs).join(docs.withColumn("text_key", F.xxhash64("text")), ["doc_id", "text_key"]).collect()}
    assert got == {(3, " ".join(words), 3), (5, copy, 3), (5, other, 5)}
    assert {tuple(r) for r in op6_neardup.one_of_each(docs).collect()} == {(3, " ".join(words)), (5, other)}


def test_near_duplicate_edges(spark, odd, nothing):
    got = op6_neardup.classes(odd).collect()
    assert len(got) == 11 and {(r.doc_id, r.class_id) for r in got} == {(i, i) for i in range(1, 9)} | {(None, None)}
    kept = op6_neardup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, *range(1, 9)]
    assert op6_neardup.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("weighting", ["binary", "count"])
def test_signatures_estimate_weighted_similarity(weighting):
    rng = np.random.default_rng(3)
    left = rng.integers(0, 1 << 44, 300).astype(np.uint64)
    right = np.concatenate([left[:220], rng.integers(0, 1 << 44, 80).astype(np.uint64)])
    weights = [np.ones(300), np.ones(300)] if weighting == "binary" else [rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)]
    one, other = (op6_neardup.signatures(np.zeros(300, int), e, w, 1, 4096) for e, w in zip((left, right), weights, strict=True))
    held = [dict(zip(e.tolist(), w, strict=True)) for e, w in zip((left, right), weights, strict=True)]
    keys = set(held[0]) | set(held[1])
    true = sum(min(h.get(k, 0) for h in held) for k in keys) / sum(max(h.get(k, 0) for h in held) for k in keys)
    assert abs((one == other).mean() - true) < 0.04


def test_signatures_do_not_depend_on_the_chunk():
    rng = np.random.default_rng(4)
    e = rng.integers(0, 1 << 44, 50).astype(np.uint64)
    alone = op6_neardup.signatures(np.zeros(50, int), e, np.ones(50), 1)
    among = op6_neardup.signatures(np.repeat([0, 1], [9, 50]), np.concatenate([e[:9], e]), np.ones(59), 2)
    assert (alone[0] == among[1]).all() and (among[1] > 0).all()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.label for r in op6_neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = random.Random(6)
    for _ in range(300):
        p, s = ("".join(rng.choice("ab ") for _ in range(rng.randint(low, high))) for low, high in ((1, 12), (0, 25)))
        distance, end = op7_decontaminate.nearest(op7_decontaminate.masks(p), len(p), s)
        assert (distance, end) == brute_distance(p, s) or (distance, end) == (len(p), 0)


def test_decontamination_against_brute_force(spark, odd, nothing):
    rng = random.Random(8)
    items = [(i, prose(rng, "en", rng.randint(12, 30))) for i in range(6)] + [(6, None), (7, ""), (8, "tiny")]
    docs = []
    for i in range(60):
        text = prose(rng, "en", 40)
        passage = list(items[i % 6][1])
        for _ in range(rng.randint(0, 14)):
            passage[rng.randrange(len(passage))] = rng.choice("xyz ")
        docs.append((i, f"{text} {''.join(passage).upper()}, {text}" if i % 3 else text))
    docs += [(60, "tiny"), (61, None), (62, "")]
    benchmark = spark.createDataFrame([(i, x, "clash") for i, x in items], "item_id long, text string, leaks string")
    got = {(r.doc_id, x.item_id): x.distance for r in op7_decontaminate.mark(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect() for x in r.leaks}
    want = {}
    for d, text in docs:
        for i, item in items:
            folded = op7_decontaminate.folded((item or "").encode())
            distance, _ = brute_distance(folded, op7_decontaminate.folded((text or "").encode()))
            if folded and distance <= int(op7_decontaminate.RATE * len(folded)):
                want[d, i] = distance
    assert got == want and len(got) > 20
    assert op7_decontaminate.mark(odd, benchmark, out="hits").count() == 11
    assert {len(r.hits) for r in op7_decontaminate.mark(odd, benchmark.limit(0), out="hits").collect()} == {0}
    assert op7_decontaminate.mark(nothing, benchmark).count() == 0


def test_blocks_of_items(spark, odd, nothing, monkeypatch):
    """Many blocks find what one does; each is scanned by a function of its own, one after another."""
    items = spark.createDataFrame([(i, f"item number {i} is a text of its own") for i in range(20)] + [(None, "no id at all"), (7, "number 7 is")], "item_id long, text string")
    two = "here item number 7 is a text of its own and item number 13 is a text of its own"
    docs = spark.createDataFrame([(0, two), (1, two), (2, "nothing here"), (3, None), (4, "no id at all"), (None, two)], "doc_id long, text string").repartition(3)
    rows = lambda df: sorted(((r.doc_id or -1, sorted((-1 if x.item_id is None else x.item_id, x.distance, x.first_word, x.last_word) for x in r.hits)) for r in df.collect()))
    one = rows(op7_decontaminate.mark(docs, items, out="hits"))
    odd_one = rows(op7_decontaminate.mark(odd, items, out="hits"))
    seen, column = [], op7_decontaminate._column
    monkeypatch.setattr(op7_decontaminate, "BLOCK_BYTES", 600)
    monkeypatch.setattr(op7_decontaminate, "_column", lambda block, rate: (seen.append(len(block)), column(block, rate))[1])
    many = op7_decontaminate.mark(docs, items, out="hits")
    assert rows(many) == one and {7, 13} <= {x[0] for x in one[0][1]} and len(seen) > 3 and sum(seen) == 22
    assert many._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0
    assert rows(op7_decontaminate.mark(odd, items, out="hits")) == odd_one and op7_decontaminate.mark(nothing, items).count() == 0


def brute_seats(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_apportionment_against_brute_force(spark):
    rng = random.Random(10)
    rows, want = [], {}
    for g in range(15):
        votes = [rng.choice([0.0, 1.0, rng.random() * 10 ** rng.randint(0, 4)]) for _ in range(rng.randint(1, 12))]
        votes[0] += 1
        seats = rng.randint(0, 400)
        rows += [(g, i, v, seats) for i, v in enumerate(votes)]
        want |= {(g, i): n for i, n in enumerate(brute_seats(votes, seats))}
    df = spark.createDataFrame(rows, "g int, i int, v double, seats long")
    assert {(r.g, r.i): r.won for r in op10_mixing.apportion(df, ["g"], "v", "seats", ["i"], "won").collect()} == want


def brute_targets(sizes, total):
    names = sorted((n for n in sizes if n is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * total - sum(2 * sizes[n] for n in full)
        open_weight = sum(weight[n] for n in names if n not in full)
        share = {n: 2 * sizes[n] if n in full else left * weight[n] / open_weight for n in names}
        over = {n for n in names if n not in full and share[n] > 2 * sizes[n]}
        if not over:
            return share
        full |= over


def test_mixing(spark, odd, nothing):
    rng = random.Random(11)
    docs = [(i, "w " * rng.choice([0, 1, 5, 300]), rng.choice(["a", "B", "é", "\U0001f600", "", None, "hot", "hot", "hot"])) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = op10_mixing.mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, op10_mixing.mix(df.repartition(7)).collect()))
    source = {i: s for i, _, s in docs}
    sizes = {}
    for i, x, s in docs:
        sizes[s] = sizes.get(s, 0) + len(x.split())
    want = brute_targets(sizes, sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 4 * op10_mixing.BLOCK_WORDS for s in sizes)
    assert op10_mixing.mix(odd).count() == 11 and op10_mixing.mix(nothing).count() == 0
    assert {(r.target, r.taken) for r in op10_mixing.mix(odd.where("doc_id <= 3")).collect()} == {(0.0, 0)}


def test_pipeline_stages(spark, corpus, odd, tmp_path):
    docs, labels = corpus
    docs = docs.union(odd)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    item = docs.where("doc_id = 1").select(F.lit(1).cast("long").alias("item_id"), F.array_join(F.slice(F.split("text", " "), 5, 15), " ").alias("text"))
    item.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = {r.doc_id for r in kept.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        now = {r.doc_id for r in kept.collect()}
        assert now <= before, name
        before = now
    assert None not in before and 1 not in before and len(before) > 100 and sum(i % 4 == 0 for i in before) <= 6
    mixed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert mixed == before
