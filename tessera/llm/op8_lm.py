"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token of a text from
both sides, and the text's score is the sum of the conditional log-probabilities.

Tokens are folded words. What the model holds follows the corpus:

1. Shards. Texts are dealt by their hash to shards of about SHARD_BYTES and sorted there, copies of a text as one row
   with its number: one shuffle, after which everything below is the same however the table was laid out.
2. Counts. Words are counted in 2^WIDEST bins over the whole corpus. The number of bins kept is twice to four times
   that of the distinct ones, so it grows with the corpus (up to 2^WIDEST, 4.2 million). The most frequent bins
   have an embedding row of their own, others share one; rows grow with the bins up to ROWS. In a tree of
   CLASSES x INNER leaves the OWN most frequent bins have a leaf each, the others share leaves of bins
   of about equal frequency, and unseen bins have the last leaf.
3. Training. In each of ROUNDS rounds every shard trains the network from one shared start; the average of what
   the shards learnt, each weight by how often its inputs or targets occurred, is formed in Spark, and the next round
   starts from it. A place's hash names its round: every token of every text is a target once. A text
   weighs as often as it occurs. Shards, so what is gathered, grow with the input.
4. Scores. P(token | both sides) = P(class | window) * P(leaf | class, window) * P(bin | leaf), for every
   token of every text. Only the last factor, within leaves of rare words, is a count without context.

The network: the embeddings of SIDE words on either side, a hidden tanh layer, a softmax over the classes and one
over the leaves of each class. Words beyond a text's ends are a padding row.

Edge cases: a null text, and one without words, scores 0 with no tokens and a null mean; a text of one
word is predicted from padding; an empty table gives no rows; repeated rows score the same, each on its
own; further columns pass through `score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytetext import ALNUM, Chunk, chunks, mix
from tessera.llm.runtime import arrow_map, cut, drop, one_thread, read, row_wise

FEWEST, WIDEST = 12, 22
ROWS = 1 << 16
CLASSES, INNER = 32, 64
OWN = 1792
SIDE = 2
EMBEDDING = 8
HIDDEN = 24
ROUNDS = 2
#: Targets of a step: FIRST, twice as many every GROWS steps, BATCH at most.
FIRST, GROWS, BATCH = 256, 16, 4096
RATE = 0.05
SEED = 42
#: A shard's bytes, about, and the most shards: from 1.7 TB of text on, shards grow instead of their number.
SHARD_BYTES = 1 << 24
SHARDS = 100_000
#: Keys that a task holds while it joins copies.
KEYS = 200_000
#: Bytes of text scored at once: the window's intermediate arrays stay small.
CHUNK = 1 << 17

LEAVES = CLASSES * INNER
WIDTH = 8


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin of 2^WIDEST) of every word of the chunk."""
    words = chunk.scan(ALNUM)
    return words.doc, (words.hashes() >> np.uint64(64 - WIDEST)).astype(np.int32)


def contexts(doc: np.ndarray, rows: np.ndarray, pad: int) -> np.ndarray:
    """(place, token) embedding rows of the words on either side, `pad` beyond the document."""
    out = np.full((2 * SIDE, len(rows)), pad, dtype=np.int32)
    for k in range(1, SIDE + 1):
        same = np.flatnonzero(doc[k:] == doc[:-k])
        out[SIDE - k, same + k] = rows[same]
        out[SIDE + k - 1, same] = rows[same + k]
    return out


@dataclass
class Lexicon:
    """What the counts say: for each of 2^bits bins its leaf, its log-probability there, and its embedding row."""

    bits: int
    leaf: np.ndarray
    log_within: np.ndarray
    row: np.ndarray
    rows: int
    #: Each leaf's share of the corpus.
    share: np.ndarray

    @classmethod
    def of(cls, wide: np.ndarray, n: np.ndarray) -> Lexicon:
        """From the corpus' counts n of the bins `wide` (of 2^WIDEST)."""
        bits = min(max(len(wide).bit_length() + 1, FEWEST), WIDEST)
        size = 1 << bits
        held = np.bincount(wide >> (WIDEST - bits), weights=n, minlength=size)
        order = np.argsort(-held, kind="stable")
        leaf = np.full(size, LEAVES - 1, dtype=np.int16)
        leaf[order[:OWN]] = np.arange(min(OWN, size))
        common = order[OWN : np.count_nonzero(held)]
        if len(common):
            before = np.cumsum(held[common]) - held[common]
            leaf[common] = OWN + np.minimum(before / held[common].sum() * (LEAVES - 1 - OWN), LEAVES - 2 - OWN).astype(np.int16)
        leaf[held == 0] = LEAVES - 1
        weight = np.where(held == 0, 0.5, held)
        mass = np.bincount(leaf, weights=weight, minlength=LEAVES)
        rows = min(ROWS, max(1 << 10, size >> 4))
        own = rows * 3 // 4
        row = own + (np.arange(size, dtype=np.int64) * 0x9E3779B1 >> 7) % (rows - own)
        row[order[:own]] = np.arange(min(own, size))
        mass = np.maximum(mass, 0.5)
        return cls(bits, leaf, (np.log(weight) - np.log(mass[leaf])).astype(np.float32), row.astype(np.int32), rows, mass / mass.sum())

    def bins(self, wide: np.ndarray) -> np.ndarray:
        return wide >> (WIDEST - self.bits)


def _softmax(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, in place of the logits; log-probability of each row's target)."""
    rows = np.arange(len(logits))
    logits -= logits.max(axis=1, keepdims=True)
    at = logits[rows, target]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1)
    logits /= total[:, None]
    return logits, at - np.log(total)


def _by_class(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(an order in which classes are contiguous, each class that occurs with its part of that order)."""
    classes = (leaves // INNER).astype(np.int16)
    order = np.argsort(classes, kind="stable")
    bounds = np.searchsorted(classes[order], np.arange(CLASSES + 1))
    return order, [(c, slice(bounds[c], bounds[c + 1])) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]


@dataclass
class Network:
    """Weights, all float32: embeddings (row), hidden (place, embedding, hidden), classes (hidden, class), leaves (class, hidden, leaf)."""

    embedding: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    leaf: np.ndarray
    leaf_bias: np.ndarray

    @classmethod
    def start(cls, lexicon: Lexicon, seed: int = SEED) -> Network:
        """Random but for the biases, which are the leaves' shares of the corpus."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        share = lexicon.share.reshape(CLASSES, INNER)
        whole = share.sum(axis=1, keepdims=True)
        return cls(
            normal(lexicon.rows + 1, EMBEDDING) * np.float32(0.3), normal(2 * SIDE, EMBEDDING, HIDDEN) / np.float32(np.sqrt(2 * SIDE * EMBEDDING)), np.zeros(HIDDEN, np.float32),
            normal(HIDDEN, CLASSES) * np.float32(0.1), np.log(whole[:, 0]).astype(np.float32), normal(CLASSES, HIDDEN, INNER) * np.float32(0.1), np.log(share / whole).astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.hidden, self.hidden_bias, self.top, self.top_bias, self.leaf, self.leaf_bias]

    def copy(self) -> Network:
        return Network(*(p.copy() for p in self.parts()))

    def _active(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the embeddings around each place side by side, the hidden layer)."""
        seen = self.embedding[np.ascontiguousarray(context.T)].reshape(context.shape[1], -1)
        active = seen @ self.hidden.reshape(-1, HIDDEN)
        active += self.hidden_bias
        return seen, np.tanh(active, out=active)

    def log_leaf(self, context: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """log P(leaf | window) of each place."""
        order, classes = _by_class(leaves)
        leaves = leaves[order]
        _, active = self._active(context[:, order])
        _, found = _softmax(active @ self.top + self.top_bias, leaves // INNER)
        for c, at in classes:
            found[at] += _softmax(active[at] @ self.leaf[c] + self.leaf_bias[c], leaves[at] - c * INNER)[1]
        out = np.empty(len(order))
        out[order] = found
        return out

    def gradients(self, context: np.ndarray, leaves: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, list[np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
        """(weighted mean loss, embedding rows met, their gradients, those of hidden to top_bias, those of each class' leaf and leaf_bias)."""
        order, classes = _by_class(leaves)
        leaves, context = leaves[order], context[:, order]
        share = (weights[order] / weights.sum()).astype(self.top.dtype)
        seen, active = self._active(context)
        places = np.arange(len(leaves))
        p, loss = _softmax(active @ self.top + self.top_bias, leaves // INNER)
        p[places, leaves // INNER] -= 1
        p *= share[:, None]
        back = p @ self.top.T
        by_class = {}
        for c, at in classes:
            inner = leaves[at] - c * INNER
            q, more = _softmax(active[at] @ self.leaf[c] + self.leaf_bias[c], inner)
            loss[at] += more
            q[places[: len(inner)], inner] -= 1
            q *= share[at, None]
            back[at] += q @ self.leaf[c].T
            by_class[c] = active[at].T @ q, q.sum(axis=0)
        back *= 1 - active**2
        dense = [(seen.T @ back).reshape(self.hidden.shape), back.sum(axis=0), active.T @ p, p.sum(axis=0)]
        each = (back @ self.hidden.reshape(-1, HIDDEN).T).reshape(-1, EMBEDDING)
        touched = context.T.ravel()
        order = np.argsort(touched, kind="stable")
        rows, first = np.unique(touched[order], return_index=True)
        return -float(loss @ share), rows, np.add.reduceat(each[order], first, axis=0), dense, by_class

    def learn(self, context: np.ndarray, leaves: np.ndarray, weights: np.ndarray, memory: list[np.ndarray]) -> None:
        """One AdaGrad step; `memory` holds the squared gradients, part by part."""
        _, rows, g_rows, dense, by_class = self.gradients(context, leaves, weights)

        def step(part: np.ndarray, held: np.ndarray, g: np.ndarray, at: object = slice(None)) -> None:
            held[at] += g * g
            part[at] -= np.float32(RATE) * g / (np.sqrt(held[at]) + np.float32(1e-6))

        step(self.embedding, memory[0], g_rows, rows)
        for part, held, g in zip(self.parts()[1:5], memory[1:5], dense, strict=True):
            step(part, held, g)
        for c, (g, g_bias) in by_class.items():
            step(self.leaf, memory[5], g, c)
            step(self.leaf_bias, memory[6], g_bias, c)

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """(all weights in lines of WIDTH, what each line counts by): an embedding row, rows + 1 for the dense parts, rows + 2 + class."""
        rows = len(self.embedding)
        dense = np.concatenate([p.ravel() for p in self.parts()[1:5]])
        dense = np.concatenate([dense, np.zeros(-len(dense) % WIDTH, np.float32)]).reshape(-1, WIDTH)
        inner = np.concatenate([self.leaf.reshape(CLASSES, -1), self.leaf_bias], axis=1).reshape(-1, WIDTH)
        per_class = len(inner) // CLASSES
        return np.concatenate([self.embedding, dense, inner]), np.concatenate([np.arange(rows), np.full(len(dense), rows), rows + 1 + np.repeat(np.arange(CLASSES), per_class)])

    def filled(self, lines: np.ndarray) -> Network:
        """The network whose weights `listed` gives as `lines`."""
        rows = len(self.embedding)
        sizes = [p.size for p in self.parts()[1:5]]
        end = rows + -(-sum(sizes) // WIDTH)
        dense = np.split(lines[rows:end].ravel()[: sum(sizes)], np.cumsum(sizes)[:-1])
        inner = lines[end:].reshape(CLASSES, -1)
        parts = [lines[:rows], *dense, inner[:, : HIDDEN * INNER], inner[:, HIDDEN * INNER :]]
        return Network(*(np.ascontiguousarray(new.reshape(old.shape), dtype=np.float32) for new, old in zip(parts, self.parts(), strict=True)))


def sharded(docs: DataFrame) -> DataFrame:
    """(shard, n, text) as a table: each distinct text of the column `text` once, with its number of rows, by shard and hash.

    A shard lies in one file, in one order. Copies are joined before the shuffle too, so a text that a third of all
    rows have is sent once by each task.
    """
    filled = docs.where("text IS NOT NULL").select("text")
    total = filled.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = min(max(1, -(-total // SHARD_BYTES)), SHARDS)
    keyed = filled.select(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), "text")

    def joined(batches):  # noqa: ANN001, ANN202
        more: dict[tuple[int, int], int] = {}
        for batch in batches:
            first = []
            for i, key in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if key in more:
                    more[key] += 1
                else:
                    more[key] = 0
                    first.append(i)
            found = batch.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(np.ones(len(first), dtype=np.int64))], ["a", "b", "text", "n"])
            if len(more) > KEYS:
                yield _counts_only(more)
                more.clear()
        yield _counts_only(more)

    once = arrow_map(keyed, joined, "a long, b long, text string, n long").withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    dealt = once.repartitionById(shards, F.col("shard")).groupBy("shard", "a", "b").agg(F.sum("n").alias("n"), F.max("text").alias("text"))
    return cut(dealt.sortWithinPartitions("shard", "a", "b").select("shard", "n", "text"))


def _counts_only(more: dict[tuple[int, int], int]) -> pa.RecordBatch:
    found = [(*key, n) for key, n in more.items() if n]
    a, b, n = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(found), pa.string()), pa.array(n, pa.int64())], ["a", "b", "text", "n"])


def counts(shards: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(bin of 2^WIDEST, how often it stands in the corpus); tasks send sums, and the result has a bounded size."""

    def run(batches):  # noqa: ANN001, ANN202
        total = np.zeros(1 << WIDEST, dtype=np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            for chunk in chunks(batch.column("text")):
                doc, bins = tokens(chunk)
                np.add.at(total, bins, n[doc + chunk.first])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bin", "n"])

    found = arrow_map(shards.select("text", "n"), run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    return found["bin"].to_numpy(), found["n"].to_numpy()


def turn(doc: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The round in which each place is a target, by its place in the document, so the same however texts are batched."""
    place = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(place + bins.astype(np.uint64)) % np.uint64(ROUNDS)


class Shard:
    """One shard's training in one round."""

    def __init__(self, network: Network) -> None:
        self.network = network.copy()
        self.memory = [np.full(p.shape, 1e-4, dtype=np.float32) for p in network.parts()]
        self.seen = np.zeros(len(network.embedding) + 1 + CLASSES, dtype=np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.steps = 0

    def _batch(self) -> int:
        return min(FIRST << self.steps // GROWS, BATCH)

    def add(self, context: np.ndarray, leaves: np.ndarray, weights: np.ndarray) -> None:
        self.held.append((context, leaves, weights))
        self.size += len(leaves)
        if self.size >= self._batch():
            self._learn()

    def _learn(self, last: bool = False) -> None:
        """Whole steps of what waits; all of it if it is the last."""
        context, leaves, weights = (np.concatenate(x, axis=-1) for x in zip(*self.held, strict=True))
        done = 0
        while self.size - done >= self._batch() or (last and done < self.size):
            part = slice(done, min(done + self._batch(), self.size))
            self.network.learn(context[:, part], leaves[part], weights[part], self.memory)
            done, self.steps = part.stop, self.steps + 1
        rows = len(self.network.embedding)
        self.seen[:rows] += np.bincount(context[:, :done].ravel(), np.tile(weights[:done], len(context)), rows).astype(np.int64)
        self.seen[rows] += int(weights[:done].sum())
        self.seen[rows + 1 :] += np.bincount(leaves[:done] // INNER, weights[:done], CLASSES).astype(np.int64)
        self.held, self.size = [(context[:, done:], leaves[done:], weights[done:])], self.size - done

    def result(self) -> pa.RecordBatch:
        """The lines that were met, with what they count by."""
        if self.size:
            self._learn(last=True)
        lines, of = self.network.listed()
        met = np.flatnonzero(self.seen[of])
        columns = [pa.array(met.astype(np.int32)), *(pa.array(lines[met, k]) for k in range(WIDTH)), pa.array(self.seen[of[met]])]
        return pa.RecordBatch.from_arrays(columns, ["line", *(f"v{k}" for k in range(WIDTH)), "weight"])


def trained(shards: DataFrame, lexicon: Lexicon, start: Network, nth: int) -> Network:
    """Round `nth`: shards train apart, and the average of what they learnt is formed in Spark."""

    def run(batches):  # noqa: ANN001, ANN202
        one_thread()
        shard, now = None, None
        for batch in batches:
            of, n = batch.column("shard").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
            for chunk in chunks(batch.column("text")):
                doc, wide = tokens(chunk)
                bins = lexicon.bins(wide)
                around, use = contexts(doc, lexicon.row[bins], lexicon.rows), turn(doc, bins) == nth
                which = of[chunk.first : chunk.first + chunk.rows][doc]
                for name in np.unique(which).tolist():
                    if name != now:
                        if shard:
                            yield shard.result()
                        shard, now = Shard(start), name
                    at = np.flatnonzero(use & (which == name))
                    shard.add(around[:, at], lexicon.leaf[bins[at]].astype(np.int64), n[doc[at] + chunk.first])
        if shard:
            yield shard.result()

    names = [f"v{k}" for k in range(WIDTH)]
    learnt = arrow_map(shards, run, f"line int, {', '.join(f'{v} float' for v in names)}, weight long")
    sums = learnt.groupBy("line").agg(*((F.sum(F.col(v).cast("double") * F.col("weight")) / F.sum("weight")).alias(v) for v in names)).toArrow()
    lines, _ = start.listed()
    lines[sums["line"].to_numpy()] = np.stack([sums[v].to_numpy() for v in names], axis=1)
    return start.filled(lines)


def fit(docs: DataFrame) -> tuple[Network, Lexicon]:
    """The network and lexicon of a corpus (a text column named text)."""
    shards = sharded(docs)
    lexicon = Lexicon.of(*counts(shards))
    network = Network.start(lexicon)
    for nth in range(ROUNDS):
        network = trained(shards, lexicon, network, nth)
    drop(shards)
    return network, lexicon


def score(docs: DataFrame, model: tuple[Network, Lexicon], text: str = "text", out: str = "lm") -> DataFrame:
    """`docs` with the struct column `out` (n_tokens, log_likelihood, mean); every row stays."""
    network, lexicon = model

    def run(batches):  # noqa: ANN001, ANN202
        one_thread()
        for texts in batches:
            total, n = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for chunk in chunks(texts, CHUNK):
                doc, wide = tokens(chunk)
                bins = lexicon.bins(wide)
                around, leaves = contexts(doc, lexicon.row[bins], lexicon.rows), lexicon.leaf[bins].astype(np.int64)
                logs = lexicon.log_within[bins].astype(np.float64)
                for at in range(0, len(bins), 1 << 14):
                    part = slice(at, at + (1 << 14))
                    logs[part] += network.log_leaf(around[:, part], leaves[part])
                rows = slice(chunk.first, chunk.first + chunk.rows)
                total[rows], n[rows] = np.bincount(doc, weights=logs, minlength=chunk.rows), np.bincount(doc, minlength=chunk.rows)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(total), mean], names=["n_tokens", "log_likelihood", "mean"])

    return docs.withColumn(out, row_wise(run, "n_tokens long, log_likelihood double, mean double")(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its tokens, the sum of their conditional log-probabilities, and the mean."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select("doc_id", "lm.*")
