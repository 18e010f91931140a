"""Operators that judge each row on its own: license, url, quality, tokens, language, toxicity, LM."""

from __future__ import annotations

import dataclasses
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import op1_license, op2_urls, op3_quality, op4_tokens, op5_language, op8_lm, op9_toxicity
from tessera.llm.bytetext import ALNUM, SPACE, chunks

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ROW = lambda r: tuple("\0" if v is None else str(v) for v in r)


@pytest.mark.parametrize("limit", [1, 7, 1 << 19])
def test_word_scanner_against_patterns(limit):
    rng = random.Random(1)
    texts = [None, "", " ", *("".join(rng.choice("aB é\n-0\x00z") for _ in range(rng.randint(0, 40))) for _ in range(200))]
    for table, pattern in ((ALNUM, WORDS), (SPACE, re.compile(r"[^\x20\x09-\x0D]+"))):
        counts, hashes = [], {}
        for chunk in chunks(pa.array(texts), limit):
            words = chunk.scan(table)
            counts += words.counts.tolist()
            for d, s, e, h in zip(words.doc, words.start, words.end, words.hashes(), strict=True):
                hashes.setdefault(bytes(words.mapped[s:e]), set()).add(int(h))
                assert chunk.offsets[d] <= s < e <= chunk.offsets[d + 1]
        folded = [(t or "").translate(FOLD) if table is ALNUM else t or "" for t in texts]
        assert counts == [len(pattern.findall(t)) for t in folded]
        assert all(len(h) == 1 for h in hashes.values()) and len({h for s in hashes.values() for h in s}) == len(hashes)


def brute_base(text):
    words = WORDS.findall((text or "").translate(FOLD))
    places = [(i, label) for phrase, label in op1_license.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_against_brute_force(spark, odd):
    rng = random.Random(2)
    bits = ["Under", "the", "MIT-License", "Apache", "license,", "version 2", "CC", "BY", "NC", "cc-by-nc", "\n", "é", "under the mit license"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, x) for i, x in enumerate(texts)], "doc_id long, text string"))
    got = op1_license.scan(df).collect()
    assert len(got) == 211
    for r in got:
        x = r.license
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_base(r.text)
        assert 0 <= x.score <= 1 and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))


@pytest.mark.parametrize(
    ("expression", "postfix", "freedom", "labels"),
    [
        ("MIT", ["MIT"], 1.0, ["mit"]),
        ("MIT OR GPL-3.0-only", ["MIT", "GPL-3.0-only", "or"], 1.0, ["mit", "gpl-3"]),
        ("MIT AND GPL-3.0", ["MIT", "GPL-3.0", "and"], 0.3, ["mit", "gpl-3"]),
        ("MIT OR Apache-2.0 AND GPL-2.0", ["MIT", "Apache-2.0", "GPL-2.0", "and", "or"], 1.0, ["mit", "apache-2", "gpl-2"]),
        ("(MIT or Apache-2.0) and GPL-2.0 WITH Classpath-exception-2.0", ["MIT", "Apache-2.0", "or", "GPL-2.0", "Classpath-exception-2.0", "with", "and"], 0.5, ["mit", "apache-2", "gpl-2"]),
        ("MIT OR", ["MIT"], 1.0, ["mit"]),
        ("OR MIT", [], 0.0, []),
        ("MIT */", ["MIT"], 1.0, ["mit"]),
        ("", [], 0.0, []),
    ],
)
def test_license_expressions(expression, postfix, freedom, labels):
    got = op1_license.to_postfix(expression)
    assert got == postfix
    assert op1_license.evaluate(got) == (freedom, labels)


def test_license_tags(spark):
    df = spark.createDataFrame([("// SPDX-License-Identifier: (MIT OR CC-BY-NC-4.0)\nAll rights reserved",)], "text string")
    x = op1_license.scan(df).first().license
    assert x.labels == "cc-by-nc,mit,proprietary" and x.score == 0.0 and {f.kind for f in x.findings} == {"base", "tag", "notice"}


def descend(tokens):
    """(freedom, labels) of a whole expression by recursive descent; None if it has a fault."""
    at = 0

    def peek():
        return tokens[at].lower() if at < len(tokens) else None

    def atom():
        nonlocal at
        token = peek()
        at += 1
        if token == "(":
            value = either()
            at += 1
            return value if tokens[at - 1 : at] == [")"] else None
        return None if token in (None, ")", "and", "or", "with") else (op1_license.FREEDOM.get(op1_license.family(token), op1_license.UNKNOWN_FREEDOM), [op1_license.family(token)])

    def chain(names, part, join):
        nonlocal at
        value = part()
        while value and peek() in names:
            at += 1
            other = part()
            value = other and join(value, other)
        return value

    def relaxed():
        return chain({"with"}, atom, lambda a, b: (min(1.0, a[0] + op1_license.EXCEPTION_BONUS), a[1]))

    def both():
        return chain({"and"}, relaxed, lambda a, b: (min(a[0], b[0]), a[1] + b[1]))

    def either():
        return chain({"or"}, both, lambda a, b: (max(a[0], b[0]), a[1] + b[1]))

    value = either()
    return value if at == len(tokens) else None


def test_license_expressions_against_recursive_descent():
    """The longest beginning that is whole, with open parentheses closed, has the value that a recursive parser gives."""
    rng = random.Random(13)
    whole = 0
    for _ in range(3000):
        tokens = []
        for i in range(rng.randint(1, 9)):
            operand, operator = rng.choice(["MIT", "GPL-2.0", "Apache-2.0", "X-1", "mpl-2.0"]), rng.choice(["and", "OR", "With", "or", "AND"])
            tokens += [*["("] * (rng.random() < 0.2), operand] if i % 2 == 0 else [*[")"] * (rng.random() < 0.2), operator]
        if rng.random() < 0.4:
            tokens[rng.randrange(len(tokens))] = rng.choice(["(", ")", "MIT", "and"])
        best = (0.0, [])
        for n in range(len(tokens), 0, -1):
            start = tokens[:n]
            if value := descend(start + [")"] * max(0, start.count("(") - start.count(")"))):
                best, whole = value, whole + (n > 3)
                break
        assert op1_license.evaluate(op1_license.to_postfix(" ".join(tokens))) == best, tokens
    assert whole > 200


def test_license_labels_against_brute_force(spark):
    """Labels and score from all phrases and tags by plain search."""
    rng = random.Random(14)
    phrases = op1_license.NOTICE_PHRASES | op1_license.BASE_PHRASES
    bits = [*phrases, "GNU Lesser", "license", "cc by", "\n", "x", "\n// SPDX-License-Identifier: MIT and (GPL-3.0-only or\n", "\n# spdx-license-identifier BSD-3-Clause\n"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    for r in op1_license.scan(spark.createDataFrame([(x,) for x in texts], "text string").repartition(2)).collect():
        line = f" {' '.join(WORDS.findall(r.text.translate(FOLD)))} "
        labels = [label for p, label in phrases.items() if f" {p} " in line]
        values = [op1_license.FREEDOM.get(x, op1_license.UNKNOWN_FREEDOM) for x in labels]
        for m in re.finditer(r"(?i)spdx-license-identifier[ \t]*:?([^\r\n]*)", r.text):
            value, found = op1_license.evaluate(op1_license.to_postfix(m[1]))
            labels += found
            values += [value] if found else []
        assert r.license.labels == ",".join(sorted(set(labels))) and r.license.score == min([1.0, *values] if values else [0.0])


def test_license_scans_are_linear():
    """Hits, tags and expressions of a long text don't look at its beginning again."""
    scanner = op1_license.Scanner(op1_license.BASE_PHRASES, op1_license.NOTICE_PHRASES, op1_license.FREEDOM)
    began = time.process_time()
    n = 150_000
    got = scanner.scan(b"cc by nc, " * n)
    assert got[:4] == (3 * n, n, 0, 3 * n - 3)
    tags = scanner.scan(b"x SPDX-License-Identifier: MIT\n" * 20_000)
    assert tags[5] == "mit" and tags[7][2][:2] == [1, 6]
    assert len(op1_license.evaluate(op1_license.to_postfix("(" * n + "MIT or " * n))[1]) == n
    assert time.process_time() - began < 30


def brute_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in op2_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls_against_brute_force(spark):
    hosts = ["A.example.COM", "example.net", "x.Example.net", "y.org", "org", "notcom", "com", "b.example.com:80"]
    paths = ["", "/", "/en/", "/en/7", "/en/77?x=/en/", "/de/8", "/de/9#/de/8", "/es/1", "/EN/1", "//en/"]
    urls = [None, "", "nothing", "://", "http://", "a://b://c/d", *(f"http://{h}{p}" for h in hosts for p in paths)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[-1]])], "page_id long, url string, url_extra string")
    got = {r.page_id: r for r in op2_urls.judge(df).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        assert (got[i].url_host, got[i].url_path, got[i].url_rule) == (host, path, rule)
        assert got[i].url_verdict == verdict if verdict else got[i].url_verdict in ("allow", "block")
    assert op2_urls.judge(df.limit(0)).count() == 0


def test_url_columns_that_clash(spark):
    """Columns of the names that are added are replaced, all others pass."""
    names = [*op2_urls.ADDED, "url_skeleton", "url_rejected", "tree_found", "host"]
    df = spark.createDataFrame([(1, "http://a.com/en/1", *("x" for _ in names))], f"page_id long, url string, {', '.join(f'{n} string' for n in names)}")
    got = op2_urls.judge(df)
    assert set(got.columns) == set(df.columns) and len(got.columns) == len(df.columns)
    assert got.first().url_host == "a.com" and got.first().tree_found == "x"
    assert op2_urls.judge(df, url="url_host").first().url_verdict == "allow"


def brute_templates(rows):
    """{(host, path's skeleton): (template, purity)} by a walk of each host's tree in memory."""
    mark = lambda s: "<x>" if re.fullmatch(r"[0-9a-fA-F-]{8,}", s) and re.search(r"\d", s) and re.search(r"[a-fA-F-]", s) else re.sub(r"[0-9]+", "<n>", s)
    tree = {}
    for host, path, label in rows:
        parts = path.split("/", op2_urls.DEPTH + 1)
        cell = tree.setdefault((host, tuple(map(mark, parts))), [0, 0, 0])
        cell[0] += 1
        cell[1] += label == 1
        cell[2] += label is not None
    name = {key: key[1] for key in tree}
    nodes = lambda k: {(h, t[:k]) for (h, _), t in name.items() if len(t) > k}

    def star(h, node, segments, k):
        for key, t in name.items():
            if key[0] == h and len(t) > k and t[:k] == node and t[k] in segments:
                name[key] = (*t[:k], "*", *t[k + 1 :])

    for k in range(1, op2_urls.DEPTH + 2):
        for h, node in nodes(k):
            kids = {}
            for key, t in name.items():
                if key[0] == h and len(t) > k and t[:k] == node:
                    kids[t[k]] = kids.get(t[k], 0) + tree[key][0]
            if len(kids) > op2_urls.FANOUT:
                star(h, node, {s for s, n in kids.items() if n < op2_urls.SHARE * sum(kids.values())}, k)
    for k in range(op2_urls.DEPTH + 1, 0, -1):
        for h, node in nodes(k):
            kids, sums = {}, {}
            for key, t in name.items():
                if key[0] == h and len(t) > k and t[:k] == node:
                    below = kids.setdefault(t[k], {})
                    below[t[k + 1 :]] = below.get(t[k + 1 :], 0) + tree[key][0]
                    sums[t[k]] = [x + y for x, y in zip(sums.get(t[k], [0, 0, 0]), tree[key], strict=True)]
            total = [sum(v) for v in zip(*sums.values(), strict=True)]
            shapes = {x for below in kids.values() for x in below}
            good = set()
            for s, (n, b, l) in sums.items():
                rest, rest_b, rest_l = total[0] - n, total[1] - b, total[2] - l
                if not rest or n < op2_urls.MIN_URLS:
                    continue
                apart = 0.0
                for x in shapes:
                    mine, others = kids[s].get(x, 0), sum(v.get(x, 0) for o, v in kids.items() if o != s)
                    apart += (mine * (rest / n) ** 0.5 - others * (n / rest) ** 0.5) ** 2 / (mine + others)
                p = total[1] / total[2] if total[2] else 0
                agree = not l or not rest_l or abs(b / l - rest_b / rest_l) <= op2_urls.Z * (p * (1 - p) * (1 / l + 1 / rest_l)) ** 0.5 + 1e-9
                if agree and apart <= len(shapes) - 1 + op2_urls.Z * (2 * (len(shapes) - 1)) ** 0.5 + 1e-9:
                    good.add(s)
            if len(good) > 1:
                star(h, node, good, k)
    whole = [sum(v) for v in zip(*tree.values(), strict=True)]
    rate = whole[1] / whole[2] if whole[2] else 0.0
    sums = {}
    for key, t in name.items():
        at = sums.setdefault((key[0], t), [0, 0, 0])
        for i in range(3):
            at[i] += tree[key][i]
    out = {}
    for key, t in name.items():
        n, b, l = sums[key[0], t]
        strength = op2_urls.STRENGTH + op2_urls.UNKNOWN * (n - l)
        out[key] = ("/".join(t), round((b + strength * rate) / (l + strength), 9))
    return out


@pytest.mark.parametrize("seed", [21, 22])
def test_url_templates_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        host = rng.choice(["a", "b", "b", "c"])
        first = rng.choice(["en", "fr", "de", "blog", "s" + rng.choice("abcdefghijklmnop")])
        path = "/" + "/".join([first, *(rng.choice([str(i), f"{i}.html", "x", "deadbeef1", "list", rng.choice("uvwxyz")]) for _ in range(rng.choice([0, 1, 1, 2, 3, 8])))])
        rows.append((host, path, rng.choice([1, 1, 1, 0]) if first in ("en", "blog") and host != "c" else rng.choice([None, None, 0]) if first == "de" else None))
    df = spark.createDataFrame(rows, "host string, path string, label int").select("host", op2_urls.skeleton(F.col("path")).alias("skeleton"), "label")
    got = {(r.host, tuple(r.skeleton)): (r.template, round(r.purity, 9)) for r in op2_urls.templates(df).collect()}
    assert got == brute_templates(rows) and sum("*" in t for t, _ in got.values()) > 10


def test_url_templates(spark):
    rows = [("h", f"/shop/item{i}/{i}", 1 if i % 9 else 0) for i in range(200)] + [("h", f"/about/{w}", 0) for w in "abc"] + [("h", f"/user/{chr(97 + i % 26)}{chr(97 + i // 26)}/x", None) for i in range(100)]
    df = spark.createDataFrame(rows, "host string, path string, label int").select("host", op2_urls.skeleton(F.col("path")).alias("skeleton"), "label")
    got = {r.template: r for r in op2_urls.templates(df).collect()}
    assert got["/shop/item<n>/<n>"].purity >= op2_urls.PURITY and got["/user/*/x"].labelled == 0
    assert all(got[f"/about/{w}"].purity < op2_urls.PURITY for w in "abc")


def test_url_tree_reaches_urls_without_a_rule(spark, monkeypatch):
    """Branches without labels join labelled ones of their shape; without the tree these urls would pass."""
    urls = [f"http://bad.com/{lang}/{i}{end}" for i in range(60) for lang in ("en", "en", "fr") for end in ("", "/")] + [f"http://bad.com/shop/{w}/list" for w in "abcdefghij"]
    urls += [f"http://good.net/{lang}/{i}" for i in range(40) for lang in ("de", "fr")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    said = lambda: {(r.url_rule, r.url_path.split("/")[1], r.url_verdict) for r in op2_urls.judge(df).collect()}
    got = said()
    assert (None, "fr", "block") in got and (None, "shop", "allow") in got and (None, "fr", "allow") in got and (None, "shop", "block") not in got
    monkeypatch.setattr(op2_urls, "_similar", lambda branch: branch.where("false"))
    assert (None, "fr", "block") not in said()


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + o for at in windows.values() if len(at) > 1 for i in at for o in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_against_brute_force(spark, odd):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "ab$ ", "\n", "é "]) for _ in range(rng.randint(0, 150))) for _ in range(150)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, x) for i, x in enumerate(texts)], "doc_id long, text string"))
    for r in op3_quality.apply(df).collect():
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed) == brute_quality(r.text)
        assert not (r.q_base_failed and r.q_kept)


def test_quality_order_does_not_change_the_verdict(spark, corpus):
    docs = corpus[0].select("doc_id", "text")
    measured = op3_quality.measure(docs, "text", op3_quality.RULES)
    assert sorted(m["rule"] for m in measured) == sorted(r.name for r in op3_quality.RULES)
    known = op3_quality.measure(docs, "text", op3_quality.RULES, {*op3_quality.BASE, "n_lines"})
    assert all((m["cost"] == op3_quality.TEST) == (m["rule"] not in ("shouting", "exclaiming")) for m in known)
    one, other = (sorted(ROW(r) for r in op3_quality.apply(docs, rules=rules).collect()) for rules in (op3_quality.RULES, op3_quality.RULES[::-1]))
    assert one == other


def test_quality_cascade_evaluates_what_is_left(spark, odd, monkeypatch):
    """A rule's statistics are null, so not computed, for rows that an earlier rule rejected; rules that would fail on them don't see them."""
    texts = ["a " * 60, "word " * 20, "# " * 80, " ".join(f"w{i}" for i in range(80))]
    df = spark.createDataFrame([(100 + i, x) for i, x in enumerate(texts)], "doc_id long, text string").union(odd.select("doc_id", "text"))
    rules = [r for r in (*op3_quality.base_rules(), *op3_quality.RULES)]
    steps = op3_quality.cascade(df, rules, "text", "q_", "q_kept", set()).collect()
    for r in steps:
        short = len((r.text or "").split()) < 50
        assert (r.q_n_repeat_words is None) == short and (not short or r.q_n_symbols is None)
        assert (r.q_n_bangs is not None) >= r.q_kept
    seen = op3_quality.Rule("last", ("n_words",), lambda c: F.when(c("n_words") < 50, F.raise_error(F.lit("evaluated"))).otherwise(False).cast("boolean"))
    monkeypatch.setattr(op3_quality, "ordered", lambda docs, text, rules, known=(): [*(r for r in rules if r.name != "last"), *(r for r in rules if r.name == "last")])
    kept = op3_quality.kept_only(df, rules=[*op3_quality.RULES, seen])
    assert sorted(map(ROW, kept.collect())) == sorted(ROW((r.doc_id, r.text)) for r in op3_quality.apply(df).collect() if r.q_kept) and kept.count() >= 1
    assert kept.columns == ["doc_id", "text"]


def test_quality_measures_costs(spark):
    """A rule that takes far more work costs more, whatever the jobs' own time; of two that reject as many the cheap one goes first."""
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(2000)),)] * 60, "text string").repartition(3)
    got = {m["rule"]: m for m in op3_quality.measure(docs, "text", op3_quality.RULES)}
    costs = {name: op3_quality._cost(docs, name) for name in ("n_repeat_words", "n_bangs")}
    assert costs["n_repeat_words"] > 2 * costs["n_bangs"]
    all_of = lambda name, need: op3_quality.Rule(name, (need,), lambda c: c(need) >= 0)
    order = op3_quality.measure(docs, "text", [all_of("dear", "n_repeat_words"), all_of("late", "n_bangs")])
    assert [m["rule"] for m in order] == ["late", "dear"] and len(got) == len(op3_quality.RULES)
    assert op3_quality.measure(docs.limit(0), "text", op3_quality.RULES) == []


def brute_tokens(pieces, text):
    known, tokens, unknown = set(pieces), 0, 0
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for w in words:
        s, i, n = op4_tokens.MARK + w, 0, 0
        while i < len(s):
            end = next((j for j in range(len(s), i, -1) if s[i:j] in known and op4_tokens.MARK not in s[i + 1 : j]), None)
            if end is None:
                n, i = None, len(s)
            else:
                n, i = n + 1, end
        tokens, unknown = tokens + (n or 1), unknown + (n is None)
    return len(words), tokens, unknown


def test_tokens_against_brute_force(spark, odd):
    rng = random.Random(5)
    for _ in range(60):
        pieces = sorted({rng.choice(["", op4_tokens.MARK]) + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 5))) for _ in range(25)} - {""})
        texts = ["".join(rng.choice("aabbccé \t") for _ in range(rng.randint(0, 60))) for _ in range(8)] + ["ab" * 400, ""]
        automaton = op4_tokens.Automaton(pieces)
        got = [row for chunk in chunks(pa.array(texts)) for row in zip(*(v.tolist() for v in automaton.lengths(chunk)), strict=True)]
        assert got == [brute_tokens(pieces, x) for x in texts]
    deep = ["a", "c", op4_tokens.MARK, "a" * 258 + "b"]
    texts = ["a" * n + "c" for n in (1, 257, 258, 600)]
    found = op4_tokens.Automaton(deep).lengths(next(chunks(pa.array(texts))))
    assert list(zip(*(v.tolist() for v in found), strict=True)) == [brute_tokens(deep, x) for x in texts]
    pieces = op4_tokens.load_pieces()
    for r in op4_tokens.count(odd, pieces).collect():
        assert tuple(r.tokens) == brute_tokens(pieces, r.text if r.doc_id != 6 else "") or r.doc_id == 6


def test_language(spark, corpus, odd, nothing):
    docs, _ = corpus
    network = op5_language.fit(docs.where("doc_id % 4 <> 2").select("doc_id", "text", "lang"))
    got = op5_language.predict(docs, network).collect()
    held = [r for r in got if r.doc_id % 4 == 2]
    assert len(got) == 300 and sum(r.language.lang == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.language.score <= 1 and r.language.lang in network.languages for r in got)
    for r in op5_language.predict(odd, network).collect():
        assert (r.language.lang == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
    assert op5_language.fit(nothing.select("doc_id", "text", "lang")) is None
    assert {r.language.lang for r in op5_language.predict(odd, None).collect()} == {"und"}
    assert op5_language.predict(nothing, network).count() == 0


def test_language_gradients():
    """The loss against a plain network, and its gradients against differences."""
    rng = np.random.default_rng(4)
    shapes = [(256, 8), *((w, 8, 16) for w in op5_language.WIDTHS), *[(16,)] * 3, (48, 3), (3,)]
    params = [rng.standard_normal(s) * 0.5 for s in shapes]
    x, y = rng.integers(97, 105, (20, 6)).astype(np.uint8), rng.integers(0, 3, 6)
    loss, grads = op5_language.gradients(params, x, y)
    plain = 0.0
    for i in range(6):
        pooled = np.concatenate([np.maximum(np.max([sum(params[0][x[t + k, i]] @ params[1 + j][k] for k in range(w)) for t in range(21 - w)], axis=0) + params[4 + j], 0) for j, w in enumerate(op5_language.WIDTHS)])
        logits = pooled @ params[-2] + params[-1]
        plain -= logits[y[i]] - np.log(np.exp(logits).sum())
    assert abs(loss - plain / 6) < 1e-9
    for k, p in enumerate(params):
        for _ in range(15):
            at = tuple(rng.integers(0, n) for n in p.shape) if k else (rng.integers(97, 105), rng.integers(0, 8))
            held = p[at]
            ends = []
            for step in (1e-6, -1e-6):
                p[at] = held + step
                ends.append(op5_language.gradients(params, x, y)[0])
            p[at] = held
            assert abs(grads[k][at] - (ends[0] - ends[1]) / 2e-6) < 1e-5


def test_language_sample_covers_all_windows(spark):
    """Windows come from every part of every labelled row, about as many a language as asked for."""
    text = lambda k: "".join(f"{k}{i:04d}" + "abcdefghi " * 26 for i in range(300))
    docs = spark.createDataFrame([(k, text(k), "long") for k in range(3)] + [(100 + i, f"short text {i}", "few") for i in range(50)] + [(200, "123", "none"), (201, None, "none"), (202, "abc", None)], "doc_id long, text string, lang string")
    data, labels, languages = op5_language.training_windows(docs, 200)
    assert languages == ["few", "long"] and (labels == 0).sum() == 50 and 150 < (labels == 1).sum() < 250
    whole = [t.encode() for t in map(text, range(3))]
    at = sorted(max(w.find(data[:, i].tobytes().rstrip(b"\0")) for w in whole) for i in np.flatnonzero(labels == 1))
    assert at[0] < 8000 and at[-1] > 70_000 and len(set(at)) > 100


def test_folded_network_equals_plain_convolution():
    rng = np.random.default_rng(0)
    network = op5_language.train(rng.integers(0, 256, (op5_language.WINDOW, 40)).astype(np.uint8), np.arange(40) % 2, ["a", "b"])
    data = rng.integers(0, 256, (op5_language.WINDOW, 5)).astype(np.uint8)
    pooled = [np.maximum(np.max([sum(network.embedding[data[t + k]] @ f[k] for k in range(w)) for t in range(len(data) - w + 1)], axis=0) + b, 0) for w, f, b in zip(op5_language.WIDTHS, network.filters, network.biases, strict=True)]
    logits = np.concatenate(pooled, axis=1) @ network.out + network.out_bias
    plain = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(network.log_probabilities(data), plain, atol=1e-4)


def test_toxicity(spark, corpus, odd, nothing):
    docs, labels = corpus
    got = op9_toxicity.score(docs, labels).collect()
    unseen = [r for r in got if r.doc_id % 3 == 0]
    assert len(got) == 300 and sum((r.toxicity.severity >= 0.5) == (r.doc_id % 4 == 0) for r in unseen) >= 0.97 * len(unseen)
    assert {r.toxicity.grade for r in got} <= {0, 1, 2}
    assert op9_toxicity.score(odd, labels).count() == 11
    assert {r.toxicity.severity for r in op9_toxicity.score(odd, labels.limit(0)).collect()} == {0.0}
    one = labels.where("toxic = 0").union(spark.createDataFrame([(None, None, None), (5, None, 0)], labels.schema))
    assert max(r.toxicity.severity for r in op9_toxicity.score(docs, one).collect()) < 1e-9
    assert op9_toxicity.score(nothing, labels).count() == 0


def test_toxicity_orders_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    rows = [np.array([0, *range(1, g + 1)]) for g in grades]
    kept = np.array([1, 10, 11])
    model = op9_toxicity.fit(kept, rows, grades, np.ones(600))
    severity, grade = model.judge(np.array([model.weights[kept[r]].sum() for r in rows]))
    assert (np.diff(model.thresholds) > 0).all() and (grade == grades).all()
    assert [severity[grades == g].mean() for g in range(3)] == sorted(severity[grades == g].mean() for g in range(3))


def test_toxicity_gradients():
    """The likelihood against a plain sum over rows, and its gradients against differences."""
    rng = np.random.default_rng(2)
    grades, w, theta, weights = rng.integers(0, 4, 40), rng.normal(size=5), np.array([-0.5, -0.2, 0.3]), rng.random(40)
    rows = [np.flatnonzero(rng.random(5) < 0.5) for _ in grades]
    args = (np.repeat(np.arange(40), [len(r) for r in rows]), np.concatenate(rows), grades, weights)
    t = [-np.inf, -0.5, -0.5 + np.exp(-0.2), -0.5 + np.exp(-0.2) + np.exp(0.3), np.inf]
    cdf = lambda x: 1 / (1 + np.exp(-x))
    plain = -sum(q * np.log(cdf(t[g + 1] - w[r].sum()) - cdf(t[g] - w[r].sum())) for r, g, q in zip(rows, grades, weights, strict=True)) + op9_toxicity.L2 / 5 * (w**2).sum() / 2
    value, grad_w, grad_theta = op9_toxicity.likelihood(w, theta, *args)
    assert abs(value - plain) < 1e-9
    numeric = lambda x, f: [(f(x + e) - f(x - e)) / 2e-6 for e in 1e-6 * np.eye(len(x))]
    assert np.allclose(grad_w, numeric(w, lambda x: op9_toxicity.likelihood(x, theta, *args)[0]), atol=1e-6)
    assert np.allclose(grad_theta, numeric(theta, lambda x: op9_toxicity.likelihood(w, x, *args)[0]), atol=1e-6)


def test_toxicity_sample(spark, monkeypatch):
    """One id on many rows, and copies of a text with different grades, teach once; the screen takes the strongest features."""
    docs = spark.createDataFrame([(1, f"row {i}") for i in range(500)] + [(2, "same"), (3, "same"), (4, None), (4, "four")], "doc_id long, text string")
    grades = spark.createDataFrame([(1, 0), (2, 0), (3, 2), (4, 1), (9, 1)], "doc_id long, grade int")
    table, counts = op9_toxicity.taught(docs, grades, "text", 100)
    got = sorted((r.grade, r.text) for r in table.collect())
    assert len(got) == 3 and got[1:] == [(1, "four"), (2, "same")] and got[0][1].startswith("row ") and counts == {0: 2, 1: 2, 2: 1}
    again, _ = op9_toxicity.taught(docs.repartition(5), grades, "text", 100)
    assert sorted((r.grade, r.text) for r in again.collect()) == got
    rng = np.random.default_rng(3)
    held = rng.random((3, 300, 40)) < np.array([0.2, 0.3, 0.9])[:, None, None] * (np.arange(40) < 3) + 0.1
    counts, rows = held.sum(axis=1).astype(float), np.full(3, 300)
    grade, weight = np.repeat(np.arange(3), 300), np.repeat([1.0, 2.0, 0.5], 300)
    weight = weight / weight.sum()
    residual = grade - (grade * weight).sum()
    flat = held.reshape(900, 40)
    z = [abs((residual * weight)[flat[:, f]].sum()) / np.sqrt((residual**2 * weight).sum() * (weight[flat[:, f]] ** 2).sum()) for f in range(40)]
    want = [f for f in np.argsort(-np.array(z), kind="stable") if z[f] > op9_toxicity.MIN_Z and counts.sum(axis=0)[f] >= op9_toxicity.MIN_ROWS]
    assert op9_toxicity.screened(counts, rows, np.array([1.0, 2.0, 0.5])).tolist() == want and {0, 1, 2} <= set(want)
    monkeypatch.setattr(op9_toxicity, "SCREENED", 2)
    assert op9_toxicity.screened(counts, rows, np.array([1.0, 2.0, 0.5])).tolist() == want[:2]


def test_lm_scores_against_brute_force(spark, corpus, odd, nothing):
    docs, _ = corpus
    network, lexicon = op8_lm.fit(docs)
    for r in op8_lm.score(docs.limit(5), (network, lexicon)).collect() + op8_lm.score(odd.where("doc_id IS NULL OR doc_id < 5 OR doc_id > 6"), (network, lexicon)).collect():
        wide = next((op8_lm.tokens(c)[1] for c in chunks(pa.array([r.text or ""]))), np.zeros(0, int))
        bins = [int(w) >> (op8_lm.WIDEST - lexicon.bits) for w in wide]
        total = 0.0
        for i, b in enumerate(bins):
            around = [lexicon.row[bins[j]] if 0 <= j < len(bins) else lexicon.rows for j in (i - 2, i - 1, i + 1, i + 2)]
            hidden = np.tanh(network.hidden_bias + sum(network.embedding[v] @ network.hidden[k] for k, v in enumerate(around)))
            top, leaf = hidden @ network.top + network.top_bias, int(lexicon.leaf[b])
            inner = hidden @ network.leaf[leaf // 64] + network.leaf_bias[leaf // 64]
            total += top[leaf // op8_lm.INNER] - np.log(np.exp(top).sum()) + inner[leaf % 64] - np.log(np.exp(inner).sum()) + lexicon.log_within[b]
        assert r.lm.n_tokens == len(bins) and abs(r.lm.log_likelihood - total) <= 1e-3 * max(1, abs(total))
        assert (r.lm["mean"] is None) == (len(bins) == 0)
    mass = np.bincount(lexicon.leaf, weights=np.exp(lexicon.log_within.astype(np.float64)), minlength=op8_lm.LEAVES)
    assert np.allclose(mass[mass > 0], 1, atol=1e-3)
    assert op8_lm.score(nothing, op8_lm.fit(nothing)).count() == 0


def test_lm_gradients():
    """The loss is the weighted mean of log_leaf, and the gradients agree with differences."""
    rng = np.random.default_rng(6)
    network = op8_lm.Network(*(p.astype(np.float64) for p in op8_lm.Network.start(dataclasses.replace(op8_lm.Lexicon.of(np.arange(50), np.arange(1, 51)), rows=30)).parts()))
    context, leaves, weights = rng.integers(0, 31, (4, 50)), rng.integers(0, 200, 50), rng.integers(1, 5, 50).astype(float)
    loss, rows, g_rows, dense, by_class = network.gradients(context, leaves, weights)
    assert abs(loss + (network.log_leaf(context, leaves) * weights).sum() / weights.sum()) < 1e-6
    whole = [np.zeros_like(p) for p in network.parts()]
    whole[0][rows] = g_rows
    whole[1:5] = dense
    for c, (g, g_bias) in by_class.items():
        whole[5][c], whole[6][c] = g, g_bias
    for p, g in zip(network.parts(), whole, strict=True):
        for _ in range(10):
            at = tuple(rng.integers(0, n) for n in (p.shape if p.shape[0] != op8_lm.CLASSES else (4, *p.shape[1:])))
            held, ends = p[at], []
            for step in (1e-5, -1e-5):
                p[at] = held + step
                ends.append(network.gradients(context, leaves, weights)[0])
            p[at] = held
            assert abs(g[at] - (ends[0] - ends[1]) / 2e-5) < 1e-5
    lines, of = network.listed()
    assert len(lines) == len(of) and all((a == b).all() for a, b in zip(network.filled(lines).parts(), (p.astype(np.float32) for p in network.parts()), strict=True))


def test_lm_trains_on_every_place(spark, corpus, monkeypatch):
    """Each place of each text is a target once, with the number of the text's rows as its weight."""
    docs = corpus[0].where("doc_id < 40").select("text")
    docs = docs.union(docs.limit(15)).union(docs.limit(15)).repartition(5)
    monkeypatch.setattr(op8_lm, "SHARD_BYTES", 4000)
    shards = op8_lm.sharded(docs)
    table = shards.toArrow()
    seen = {}
    for r in docs.collect():
        seen[r.text] = seen.get(r.text, 0) + 1
    assert dict(zip(table["text"].to_pylist(), table["n"].to_pylist(), strict=True)) == seen and max(seen.values()) == 3 and len(set(table["shard"].to_pylist())) > 3
    learnt, nets = [], []
    monkeypatch.setattr(op8_lm, "arrow_map", lambda df, run, ddl: spark.createDataFrame([r for b in run(iter(df.toArrow().to_batches(max_chunksize=7))) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)], ddl))
    monkeypatch.setattr(op8_lm.Network, "learn", lambda self, context, leaves, weights, memory: (nets.append(self), learnt.extend(zip(map(tuple, context.T.tolist()), leaves.tolist(), weights.tolist(), strict=True))))
    lexicon = op8_lm.Lexicon.of(*op8_lm.counts(shards))
    for nth in range(op8_lm.ROUNDS):
        op8_lm.trained(shards, lexicon, op8_lm.Network.start(lexicon), nth)
    want = []
    for text, n in seen.items():
        doc, wide = op8_lm.tokens(next(chunks(pa.array([text]))))
        bins = lexicon.bins(wide)
        want += zip(map(tuple, op8_lm.contexts(doc, lexicon.row[bins], lexicon.rows).T.tolist()), lexicon.leaf[bins].tolist(), [float(n)] * len(bins), strict=True)
    assert len(want) > 1000 and sorted(learnt) == sorted(want)


def test_lm_does_not_depend_on_the_layout(spark, corpus, monkeypatch):
    docs = corpus[0].select("doc_id", "text")
    docs = docs.union(docs.where("doc_id < 100")).union(docs.where("doc_id < 3"))
    monkeypatch.setattr(op8_lm, "SHARD_BYTES", 40_000)
    one, other = ({r.doc_id: r.lm["mean"] for r in op8_lm.score(docs, op8_lm.fit(docs.repartition(n, key))).collect()} for n, key in ((1, "doc_id"), (7, "text")))
    assert len(one) == 300 and all(abs(one[i] - other[i]) < 1e-4 for i in one)


def test_lm_lexicon_grows_with_the_corpus():
    rng = np.random.default_rng(7)
    made = [op8_lm.Lexicon.of(w := np.unique(rng.integers(0, 1 << op8_lm.WIDEST, n)), rng.zipf(1.5, len(w)).clip(max=10**6)) for n in (100, 10_000, 400_000)]
    assert [x.bits for x in made] == [12, 15, 20] and [x.rows for x in made] == [1024, 2048, 65536]
    for x in made:
        assert np.allclose(np.bincount(x.leaf, np.exp(x.log_within.astype(float)), op8_lm.LEAVES)[np.unique(x.leaf)], 1, atol=1e-3) and x.row.max() < x.rows


def test_lm_context_beats_the_unigram(spark):
    """On texts that were not trained on, words that their neighbours foretell have more than their own frequency."""
    rng = random.Random(9)
    text = lambda: " ".join(w for _ in range(40) for k in [rng.randrange(30)] for w in (f"a{k}", f"b{k}", f"c{k}"))
    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    network, lexicon = model = op8_lm.fit(docs.where("doc_id >= 20"))
    mean = op8_lm.score(docs.where("doc_id < 20"), model).agg(F.sum("lm.log_likelihood") / F.sum("lm.n_tokens")).first()[0]
    assert mean > -np.log(90) + 1.5


def test_lm_prefers_the_corpus(spark, corpus):
    docs, _ = corpus
    model = op8_lm.fit(docs)
    known = docs.where("doc_id < 40")
    mixed = known.withColumn("text", F.array_join(F.shuffle(F.split("text", "")), ""))
    mean = lambda df: op8_lm.score(df, model).agg(F.sum("lm.log_likelihood") / F.sum("lm.n_tokens")).first()[0]
    assert mean(known) > mean(mixed)


def test_url_query_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(12)
    segments = ["en", "de", "es", "about", "x", "", "7", "8", "42.html", "deadbeef01", "2024-01-02", *(f"{a}{b}" for a in "abcde" for b in "vwxyz")]
    urls = [None, "none"]
    for _ in range(1500):
        host = rng.choice(["A.com", "a.com", "b.example.com", "example.net", "c.org", "d.e"])
        urls.append(f"https://{host}" + "".join("/" + rng.choice(segments) for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 9]))) + rng.choice(["", "?q=/en/", "#z", "/"]))
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = op2_urls.op2_url_filter(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(op2_urls.oracle())
    assert want.columns == list(got[0].asDict())
    close = lambda rows: sorted((*r[:6], round(r[6], 9)) for r in ((x[0], *(v or "" for v in x[1:6]), x[6]) for x in rows))
    assert close(map(tuple, got)) == close(want.fetchall())
    assert any("*" in r.template for r in got) and {r.verdict for r in got if r.rule is None} == {"allow", "block"}
