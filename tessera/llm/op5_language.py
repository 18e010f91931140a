"""Language identification by a byte convolutional network, trained here in numpy.

A text is cut into windows of WINDOW bytes that do not overlap and together cover all of it. Bytes
are embedded; filters of several widths slide over a window; the largest response of each filter
goes through a softmax layer. A text's language has the highest mean log-probability over its
windows, weighted by their bytes; its score is the mean probability.

Training draws about PER_LANGUAGE windows of each language by a hash, evenly from all windows of all labelled rows
that are not held out; this bound is a parameter. For prediction the filters are folded into tables
indexed by byte pairs, so a convolution of width 4 is two lookups and one addition; windows lie
side by side in time-major order. The pass over the table needs no shuffle.

Edge cases: a null text, and a text without letters, is `und` with score 0; without any labelled row
every row is `und`; one language only is predicted with score 1; repeated rows are judged each on
its own; a null doc_id is not held out and is learnt from; further columns pass through `predict`. The
network has an output for each lang value, so their number must fit a driver's memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytetext import Chunk, chunks
from tessera.llm.runtime import arrow_map, by_ids, cut, drop, one_thread, read, row_wise

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
PER_LANGUAGE = 3600
STEPS = 500
BATCH = 96
SEED = 42
#: Bytes of text folded at once in prediction; the lookups of a chunk then stay in a core's cache.
CHUNK = 1 << 17
#: Every text has a padded window at least, so their number is bounded too.
CHUNK_TEXTS = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def windows(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, time-major and zero-padded; document of each window; its share of real bytes)."""
    sizes = np.diff(chunk.offsets)
    each = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(chunk.rows), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    begin = chunk.offsets[doc] + nth * WINDOW
    at = begin[None, :] + np.arange(WINDOW)[:, None]
    end = chunk.offsets[doc + 1]
    data = np.where(at < end[None, :], _LOWER[chunk.data[np.minimum(at, len(chunk.data) - 1)]], 0).astype(np.uint8) if len(doc) else np.zeros((WINDOW, 0), np.uint8)
    return data, doc, np.minimum(end - begin, WINDOW) / WINDOW


@dataclass
class Network:
    """Embedding, one weight block (width, embedding, filter) and bias for each width, and the output layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    tables: list = field(default_factory=list)

    def folded(self) -> list:
        """For each width the lookup tables: ('pair' or 'byte', offset, table)."""
        if not self.tables:
            for w, block in zip(WIDTHS, self.filters, strict=True):
                single = [(self.embedding @ block[k]).astype(np.float32) for k in range(w)]
                parts = [("pair", k, (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, FILTERS)) for k in range(0, w - 1, 2)]
                self.tables.append(parts + [("byte", w - 1, single[w - 1])] * (w % 2))
        return self.tables

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(window, language) log-probabilities of time-major bytes."""
        pairs = data[:-1].astype(np.int32) * 256 + data[1:]
        pooled = []
        for w, bias, parts in zip(WIDTHS, self.biases, self.folded(), strict=True):
            span = len(data) - w + 1
            total = None
            for kind, k, table in parts:
                part = np.take(table, (pairs if kind == "pair" else data)[k : k + span], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(np.maximum(total.max(axis=0) + bias, 0))
        logits = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy of time-major windows and its gradients; they flow through the pooled places only."""
    n_w, size = len(WIDTHS), len(y)
    embedded = params[0][x]
    pooled, places = [], []
    for i, w in enumerate(WIDTHS):
        span = len(x) - w + 1
        response = sum(embedded[k : k + span] @ params[1 + i][k] for k in range(w))
        best = response.argmax(axis=0)
        places.append(best)
        pooled.append(np.take_along_axis(response, best[None], axis=0)[0] + params[1 + n_w + i])
    hidden = np.concatenate(pooled, axis=1)
    active = np.maximum(hidden, 0)
    logits = active @ params[-2] + params[-1]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(p[np.arange(size), y]).mean()
    p[np.arange(size), y] -= 1
    p /= size
    grads = [np.zeros_like(q) for q in params]
    grads[-2], grads[-1] = active.T @ p, p.sum(axis=0)
    back = (p @ params[-2].T) * (hidden > 0)
    rows = np.arange(size)[:, None]
    for i, w in enumerate(WIDTHS):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        grads[1 + n_w + i] = g.sum(axis=0)
        for k in range(w):
            at = places[i] + k
            grads[1 + i][k] = np.einsum("bf,bfe->ef", g, embedded[at, rows])
            np.add.at(grads[0], x[at, rows], g[:, :, None] * params[1 + i][k].T[None])
    return loss, grads


def train(data: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = SEED) -> Network:
    """Adam on the cross-entropy of windows (time-major bytes)."""
    rng = np.random.default_rng(seed)
    n_out = len(languages)
    shapes = [(256, EMBEDDING)] + [(w, EMBEDDING, FILTERS) for w in WIDTHS] + [(FILTERS,)] * len(WIDTHS) + [(FILTERS * len(WIDTHS), n_out), (n_out,)]
    scales = [0.5] + [1 / np.sqrt(w * EMBEDDING) for w in WIDTHS] + [0.0] * len(WIDTHS) + [1 / np.sqrt(FILTERS * len(WIDTHS)), 0.0]
    params = [(rng.standard_normal(s) * k).astype(np.float32) for s, k in zip(shapes, scales, strict=True)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n_w = len(WIDTHS)
    # Windows of every language are drawn equally often.
    weight = 1 / np.bincount(labels, minlength=n_out)[labels]
    weight /= weight.sum()
    for step in range(1, STEPS + 1):
        pick = rng.choice(len(labels), size=BATCH, p=weight)
        _, grads = gradients(params, data[:, pick], labels[pick])
        for q, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Network(languages, params[0], params[1 : 1 + n_w], params[1 + n_w : 1 + 2 * n_w], params[-2], params[-1])


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A sample of all windows of all rows (doc_id, text, lang): bounded by the number of languages, not by the table."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("n", F.ceil(F.octet_length("text") / WINDOW).cast("int"))
    totals = cut(known.groupBy("lang").agg(F.sum("n").alias("total")))
    drawn = lambda i: F.xxhash64("key", i).bitwiseAND((1 << 53) - 1) < F.col("keep") * float(1 << 53)
    shares = totals.select("lang", (F.lit(float(per_language)) / F.col("total")).alias("keep"))
    keyed = by_ids(known.withColumn("key", F.xxhash64("doc_id", "text")), shares, "lang", "inner")
    sample = keyed.select("text", "lang", F.filter(F.sequence(F.lit(0), F.col("n") - 1), drawn).alias("drawn")).where(F.size("drawn") > 0)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            drawn = batch.column("drawn")
            for chunk in chunks(batch.column("text"), CHUNK, CHUNK_TEXTS):
                data, doc, _ = windows(chunk)
                first = np.searchsorted(doc, np.arange(chunk.rows))
                rows = drawn[chunk.first : chunk.first + chunk.rows]
                each = rows.value_lengths().to_numpy()
                of = np.repeat(np.arange(chunk.rows), each)
                use = first[of] + rows.flatten().to_numpy()
                langs = batch.column("lang").take(pa.array(of + chunk.first))
                yield pa.RecordBatch.from_arrays([pa.array([data[:, i].tobytes() for i in use], pa.binary()), langs], ["bytes", "lang"])

    found = arrow_map(sample, run, "bytes binary, lang string").toArrow().to_pydict()
    drop(totals)
    pairs = sorted(zip(found["lang"], found["bytes"], strict=True))
    languages = sorted({lang for lang, _ in pairs})
    data = np.frombuffer(b"".join(b for _, b in pairs), dtype=np.uint8).reshape(-1, WINDOW).T
    return np.ascontiguousarray(data), np.array([languages.index(lang) for lang, _ in pairs], dtype=np.int64), languages


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = SEED) -> Network | None:
    """A network from labelled rows (doc_id, text, lang); None without any."""
    data, labels, languages = training_windows(docs, per_language)
    return train(data, labels, languages, seed) if languages else None


def predicted(text: Column, network: Network | None) -> Column:
    """The struct (lang, score) of a text column."""
    readable = F.coalesce(F.when(text.rlike(r"\p{L}"), text), F.lit(""))
    if network is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))

    def run(batches):  # noqa: ANN001, ANN202
        one_thread()
        names = np.array([*network.languages, "und"], dtype=object)
        for texts in batches:
            best, score = np.full(len(texts), len(network.languages)), np.zeros(len(texts))
            for chunk in chunks(texts, CHUNK, CHUNK_TEXTS):
                total = np.zeros((chunk.rows, len(network.languages)))
                mean = np.zeros_like(total)
                data, doc, share = windows(chunk)
                for lo in range(0, len(doc), CHUNK // WINDOW):
                    part = slice(lo, lo + CHUNK // WINDOW)
                    logs = network.log_probabilities(data[:, part])
                    np.add.at(total, doc[part], logs * share[part, None])
                    np.add.at(mean, doc[part], np.exp(logs) * share[part, None])
                rows = np.flatnonzero(np.diff(chunk.offsets))
                pick = total[rows].argmax(axis=1)
                best[chunk.first + rows] = pick
                score[chunk.first + rows] = np.clip(mean[rows, pick] / mean[rows].sum(axis=1), 0, 1)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], names=["lang", "score"])

    return row_wise(run, "lang string, score double")(readable)


def predict(docs: DataFrame, network: Network | None, text: str = "text", out: str = "language") -> DataFrame:
    """`docs` with the struct column `out` (lang, score); every row stays."""
    return docs.withColumn(out, predicted(F.col(f"`{text}`"), network))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it was held out of training, its predicted language and score."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    network = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), network).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )
