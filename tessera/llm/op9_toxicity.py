"""Toxicity: cumulative-link (proportional odds) ordinal regression on sparse text features.

Features of a text are its distinct hashed words and word beginnings of 3 to 6 bytes. All severity
grades share one weight vector w; grade k has the ordered threshold t_k:
P(grade <= k | x) = sigmoid(t_k - w.x). The expected severity is the sum over k of P(grade > k).

The model is fitted on a bounded sample of labelled ids (PER_GRADE a grade, drawn by a hash of the id,
weighted back to the grade's share). Each id teaches by one text and each text once, with the highest grade of
its ids. Features are screened by their score statistic, at most SCREENED of them, which keeps long clean
texts from gathering noise; its sums are formed in Spark, and only screened features of the sample come to
the driver: PER_GRADE * SCREENED numbers a grade at most, however long the texts are. Every row of the table is then scored by one pass
without a shuffle; the model that travels to the executors has a fixed size (2^BITS floats).

Edge cases: a null or empty text has no features, and only the thresholds count; with no labels, or
labels of one grade only, nothing is learnt and every row has that grade (0 without labels); labels of
unknown documents are ignored, of repeated ids the highest grade counts; null labels are ignored; of
different texts with one id that with the smallest hash teaches;
repeated rows are scored each on its own; further columns pass through `score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytetext import ALNUM, Chunk, chunks
from tessera.llm.runtime import arrow_map, cut, drop, read, row_wise, unit_hash

BITS = 18
PREFIXES = (3, 4, 5, 6)
PER_GRADE = 4000
#: Features in fewer sampled rows, or whose score statistic is smaller, in standard deviations, are left out.
MIN_Z = 5.0
MIN_ROWS = 5
SCREENED = 2048
L2 = 1e-3
STEPS = 400
THRESHOLD = 0.5


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document of the chunk, feature) of every distinct feature, in document order."""
    words = chunk.scan(ALNUM)
    mask = np.uint64((1 << BITS) - 1)
    kinds = []
    for k, h in enumerate(words.span_hashes([None, *PREFIXES])):
        bins = (h >> np.uint64(7 * k)) & mask
        doc = words.doc
        if k:
            longer = words.end - words.start > PREFIXES[k - 1]
            bins, doc = bins[longer], doc[longer]
        kinds.append((doc.astype(np.uint64) << np.uint64(BITS)) | bins)
    keys = np.unique(np.concatenate(kinds))
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & mask).astype(np.int32)


@dataclass
class Model:
    """Shared weights and ordered thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def margins(self, chunk: Chunk) -> np.ndarray:
        doc, bins = features(chunk)
        return np.bincount(doc, weights=self.weights[bins], minlength=chunk.rows)

    def judge(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, likeliest grade)."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -60, 60)))
        edges = np.concatenate([np.ones((len(margins), 1)), above, np.zeros((len(margins), 1))], axis=1)
        return above.sum(axis=1), np.argmax(edges[:, :-1] - edges[:, 1:], axis=1)


def screened(counts: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The features whose score statistic at w = 0 stands out, strongest first.

    `counts` has for each (grade, feature) how many sampled rows hold it, `rows` the sampled rows of each grade and
    `weights` what a row of each grade weighs.
    """
    share = weights / (rows * weights).sum()
    residual = np.arange(len(rows)) - (np.arange(len(rows)) * rows * share).sum()
    variance = (residual**2 * rows * share).sum()
    score = (residual * share) @ counts
    spread = np.sqrt(variance * (share**2 @ counts))
    z = np.abs(score) / np.maximum(spread, 1e-300)
    kept = np.flatnonzero((counts.sum(axis=0) >= MIN_ROWS) & (z > MIN_Z))
    return kept[np.argsort(-z[kept], kind="stable")[:SCREENED]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def likelihood(w: np.ndarray, theta: np.ndarray, doc: np.ndarray, place: np.ndarray, grades: np.ndarray, row_weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised negative log-likelihood and its gradients by w and theta.

    Row doc[i] has the feature place[i]; theta is the first threshold and the logarithms of the gaps to the next.
    """
    top = len(theta)
    t = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
    margin = np.bincount(doc, w[place], minlength=len(grades))
    below = np.where(grades == top, 1.0, _sigmoid(t[np.minimum(grades, top - 1)] - margin))
    under = np.where(grades == 0, 0.0, _sigmoid(t[np.maximum(grades - 1, 0)] - margin))
    p = np.maximum(below - under, 1e-12)
    d_below, d_under = below * (1 - below), under * (1 - under)
    d_margin = row_weights * (d_below - d_under) / p
    penalty = L2 / max(len(w), 1)
    grad_w = np.bincount(place, d_margin[doc], minlength=len(w)) + penalty * w
    grad_t = np.array([-(row_weights * d_below / p)[grades == k].sum() + (row_weights * d_under / p)[grades == k + 1].sum() for k in range(top)])
    grad_theta = np.concatenate([[grad_t.sum()], [grad_t[k + 1 :].sum() * np.exp(theta[k + 1]) for k in range(top - 1)]])
    return -(row_weights * np.log(p)).sum() + penalty * (w**2).sum() / 2, grad_w, grad_theta


def fit(kept: np.ndarray, rows: list[np.ndarray], grades: np.ndarray, row_weights: np.ndarray) -> Model:
    """Maximum likelihood by Adam with an L2 penalty; `rows` hold places in the screened features `kept`."""
    top = int(grades.max()) if len(grades) else 0
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not len(grades) or grades.min() == top:
        return Model(weights, np.full(top, -60.0))
    row_weights = row_weights / row_weights.sum()
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.concatenate(rows).astype(np.int64)
    w = np.zeros(len(kept))
    cumulative = np.array([(row_weights[grades <= k]).sum() for k in range(top)])
    cumulative = np.clip(cumulative, 1e-4, 1 - 1e-4)
    first = np.log(cumulative / (1 - cumulative))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    state = [np.zeros(len(w) + top) for _ in range(2)]
    for step in range(1, STEPS + 1):
        _, grad_w, grad_theta = likelihood(w, theta, doc, place, grades, row_weights)
        grad = np.concatenate([grad_w, grad_theta])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w -= move[: len(w)]
        theta -= move[len(w) :]
    weights[kept] = w
    return Model(weights, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 clean, 1 toxic, 2 toxic and of low quality too; the highest of repeated ids."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    return labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(grade).alias("grade"))


def taught(docs: DataFrame, grades: DataFrame, text: str, per_grade: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, grade) of the sample as a table, each text once, and how many ids each grade has."""
    counts = {r["grade"]: r["n"] for r in grades.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(0.0)
    for grade, n in counts.items():
        keep = F.when(F.col("grade") == grade, min(1.0, per_grade / n)).otherwise(keep)
    # About per_grade ids a grade: the broadcast has a fixed bound.
    sample = grades.where(unit_hash("doc_id") < keep)
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))).alias("text"), F.max("grade").alias("grade"))
    return cut(one.groupBy("text").agg(F.max("grade").alias("grade"))), counts


def train(docs: DataFrame, grades: DataFrame, text: str = "text", per_grade: int = PER_GRADE) -> Model:
    """Fit on about `per_grade` labelled ids of each grade; feature sums and screened features reach the driver."""
    sample, counts = taught(docs, grades, text, per_grade)
    top = max(counts, default=0)

    def tally(batches):  # noqa: ANN001, ANN202
        total = np.zeros((top + 1, 1 << BITS), dtype=np.int64)
        rows = np.zeros(top + 1, dtype=np.int64)
        for batch in batches:
            grade = batch.column("grade").to_numpy()
            rows += np.bincount(grade, minlength=top + 1)
            for chunk in chunks(batch.column("text")):
                doc, bins = features(chunk)
                np.add.at(total, (grade[doc + chunk.first], bins), 1)
        of, bins = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([of, np.arange(top + 1)]).astype(np.int32)), pa.array(np.concatenate([bins, np.full(top + 1, -1)]).astype(np.int32)), pa.array(np.concatenate([total[of, bins], rows]))], ["grade", "bin", "n"])

    sums = arrow_map(sample, tally, "grade int, bin int, n long").groupBy("grade", "bin").agg(F.sum("n").alias("n")).toArrow()
    grade, bins, n = (sums[c].to_numpy() for c in ("grade", "bin", "n"))
    held, seen = np.zeros((top + 1, 1 << BITS)), np.zeros(top + 1, dtype=np.int64)
    held[grade[bins >= 0], bins[bins >= 0]] = n[bins >= 0]
    seen[grade[bins < 0]] = n[bins < 0]
    if not seen.sum():
        drop(sample)
        return fit(np.zeros(0, int), [], np.zeros(0, int), np.zeros(0))
    weights = np.array([counts.get(g, 0) / max(seen[g], 1) for g in range(top + 1)])
    kept = screened(held, seen, weights)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))

    def found(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                doc, bins = features(chunk)
                doc, at = doc[place[bins] >= 0], place[bins[place[bins] >= 0]]
                bounds = np.searchsorted(doc, np.arange(chunk.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("grade")[chunk.first : chunk.first + chunk.rows], pa.ListArray.from_arrays(pa.array(bounds), pa.array(at))], ["grade", "places"])

    table = arrow_map(sample, found, "grade int, places array<int>").toArrow()
    drop(sample)
    rows = sorted((g, sorted(p)) for g, p in zip(table["grade"].to_pylist(), table["places"].to_pylist(), strict=True))
    got = np.array([g for g, _ in rows], dtype=np.int64)
    return fit(kept, [np.array(p, dtype=np.int64) for _, p in rows], got, weights[got])


def severity(text: Column, model: Model) -> Column:
    """The struct (severity, grade) of a text column; the model travels with the function."""

    def run(batches):  # noqa: ANN001, ANN202
        for texts in batches:
            margin = np.zeros(len(texts))
            for chunk in chunks(texts):
                margin[chunk.first : chunk.first + chunk.rows] = model.margins(chunk)
            expected, grade = model.judge(margin)
            yield pa.StructArray.from_arrays([pa.array(expected, pa.float64()), pa.array(grade.astype(np.int32))], names=["severity", "grade"])

    return row_wise(run, "severity double, grade int")(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` with the struct column `out` (severity, grade); every row stays."""
    model = train(docs, graded(labels), text)
    return docs.withColumn(out, severity(F.col(f"`{text}`"), model))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: expected severity, likeliest grade, and whether it counts as toxic."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("toxicity.severity").alias("severity"), F.col("toxicity.grade").alias("grade"), (F.col("toxicity.severity") >= THRESHOLD).alias("toxic"))
