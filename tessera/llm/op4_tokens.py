"""Token counts: greedy longest-match word-piece lengths by a linear automaton.

The vocabulary's pieces form a byte trie; a piece that may only begin a word starts with the word mark.
Every node has a failure link and the number of tokens popped on it: if no child fits the next byte, the
tokens of the node's longest-match split are counted and matching goes on at the link, so each byte
costs a bounded number of steps however pieces overlap, and no piece is ever built. Links are folded into a
transition table (state, byte) -> (state, tokens popped), and all words of a chunk advance through it
together, one byte position at a time. Nodes without children pop on arrival and need no row.

Words are runs of characters other than ASCII white space. A word that has no split into pieces
counts as one unknown token. No shuffle; the table has the size of the vocabulary.

Edge cases: null and empty texts have no words and no tokens; words longer than LONG bytes advance one by
one; repeated rows are counted each on its own; further columns pass through `count`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytetext import SPACE, Chunk, chunks
from tessera.llm.runtime import read, row_wise

#: The vocabulary file of the query, on the driver; the session setting VOCABULARY_KEY names another.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
VOCABULARY_KEY = "spark.tessera.vocabulary"
#: The character that public piece vocabularies put before pieces that begin a word.
MARK = "▁"
LONG = 256
UNKNOWN = -(1 << 40)
_built: dict[int, Automaton] = {}


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a public vocabulary file; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """The transition table of a vocabulary. State 0 is the root, state 1 is dead."""

    def __init__(self, pieces: list[str]) -> None:
        self.classes = np.zeros(257, dtype=np.int32)
        keyed = sorted({self._symbols(p) for p in pieces if p and MARK not in p[1:]})
        used = sorted({b for key in keyed for b in key})
        for i, b in enumerate(used):
            self.classes[b] = i + 1
        self.width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for key in keyed:
            at = 0
            for b in key:
                at = children[at].setdefault(int(self.classes[b]), len(children))
                if at == len(children):
                    children.append({})
                    whole.append(False)
            whole[at] = True
        self._complete(children, whole)

    @staticmethod
    def _symbols(piece: str) -> tuple[int, ...]:
        return (256, *piece[1:].encode()) if piece[0] == MARK else tuple(piece.encode())

    def _complete(self, children: list[dict[int, int]], whole: list[bool]) -> None:
        """Breadth first: links lead to shallower nodes, whose rows are complete by then."""
        n = len(children)
        row = np.full(n, -1, dtype=np.int64)
        row[0] = 0
        inner = [v for v in range(1, n) if children[v]]
        row[inner] = np.arange(2, len(inner) + 2)
        state = np.ones((len(inner) + 2, self.width), dtype=np.int32)
        pops = np.zeros_like(state)
        end = np.zeros(len(inner) + 2, dtype=np.int64)
        end[1] = UNKNOWN
        link, popped = np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        queue = [0]
        for v in queue:
            r = row[v]
            if v:
                state[r], pops[r] = state[link[v]], pops[link[v]] + popped[v]
                end[r] = end[link[v]] + popped[v]
            for c, u in children[v].items():
                if whole[u]:
                    link[u], popped[u] = 0, 1
                else:
                    link[u], popped[u] = state[link[v], c], popped[v] + pops[link[v], c]
                # A node without children pops on arrival.
                state[r, c], pops[r, c] = (row[u], 0) if children[u] else (link[u], popped[u])
                if children[u]:
                    queue.append(u)
        # A transition holds its state above the tokens popped, which take as many bits as the vocabulary's longest split needs.
        self.bits = max(1, int(pops.max()).bit_length())
        wide = int(state.max()).bit_length() + self.bits > 31
        self.table = (state.astype(np.int64 if wide else np.int32) << self.bits | pops).ravel()
        self.end = end
        self.begin = int(self.table[self.classes[256]]) if self.classes[256] else 0

    def lengths(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, tokens, unknown words) of every text of the chunk."""
        words = chunk.scan(SPACE)
        size = words.end - words.start
        order = np.argsort(-size, kind="stable")
        start, size = words.start[order], size[order]
        symbols = self.classes[chunk.data]
        popped = (1 << self.bits) - 1
        state = np.full(len(order), self.begin >> self.bits, dtype=np.int64)
        tokens = np.full(len(order), self.begin & popped, dtype=np.int64)
        longest = min(int(size[0]), LONG) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        for j in range(longest):
            part = slice(0, active[j])
            step = self.table[state[part] * self.width + symbols[start[part] + j]]
            state[part] = step >> self.bits
            tokens[part] += step & popped
        for i in range(int(np.searchsorted(-size, -LONG, side="left"))):
            at, total = int(state[i]), int(tokens[i])
            for c in symbols[start[i] + LONG : start[i] + size[i]].tolist():
                step = int(self.table[at * self.width + c])
                at, total = step >> self.bits, total + (step & popped)
                if at == 1:
                    break
            state[i], tokens[i] = at, total
        tokens += self.end[state]
        unknown = (state == 1) | (tokens < 0)
        tokens[unknown] = 1
        doc = words.doc[order]
        sums = lambda v: np.bincount(doc, weights=v, minlength=chunk.rows).astype(np.int64)
        return words.counts, sums(tokens), sums(unknown)


COUNTS_DDL = "n_words long, n_tokens long, n_unknown long"


def count(docs: DataFrame, pieces: list[str], text: str = "text", out: str = "tokens") -> DataFrame:
    """`docs` with the struct column `out` (n_words, n_tokens, n_unknown); every row stays."""

    def run(batches):  # noqa: ANN001, ANN202
        automaton = built(pieces)
        for texts in batches:
            found = [automaton.lengths(chunk) for chunk in chunks(texts)]
            columns = [np.concatenate(v) for v in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 3
            yield pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["n_words", "n_tokens", "n_unknown"])

    return docs.withColumn(out, row_wise(run, COUNTS_DDL)(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def built(pieces: list[str]) -> Automaton:
    """The automaton of a vocabulary, built once in each Python worker."""
    key = hash(tuple(pieces))
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(pieces)
    return _built[key]


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """One row per document: words, word-piece tokens and unknown words."""
    vocabulary = vocabulary or spark.conf.get(VOCABULARY_KEY, VOCABULARY)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count(docs, load_pieces(vocabulary)).select("doc_id", "tokens.*")


def oracle(vocabulary: str = VOCABULARY) -> str:
    """The query in DuckDB's SQL: every distinct word is walked by its longest fitting piece."""
    pieces = sorted({p for p in load_pieces(vocabulary) if p and MARK not in p[1:]})
    longest = max(map(len, pieces))
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in pieces)
    return f"""
WITH RECURSIVE vocabulary AS (
  SELECT unnest([{listed}]) AS piece
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), w AS (
  SELECT rid, '{MARK}' || unnest(words) AS word FROM d
), walk AS (
  SELECT DISTINCT word, 1 AS pos, 0 AS n FROM w
  UNION ALL
  SELECT word, pos + reach, n + 1 FROM (
    SELECT word, pos, n, max(k) AS reach FROM walk CROSS JOIN (SELECT unnest(generate_series(1, {longest})) AS k) AS s JOIN vocabulary ON piece = substr(word, pos, k)
    WHERE pos + k - 1 <= length(word) AND (pos = 1 OR NOT starts_with(piece, '{MARK}')) GROUP BY word, pos, n)
), counted AS (
  SELECT word, max(n) FILTER (pos > length(word)) AS n FROM walk GROUP BY word
), sums AS (
  SELECT rid, sum(coalesce(n, 1)) AS n_tokens, count(*) FILTER (n IS NULL) AS n_unknown FROM w JOIN counted USING (word) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_unknown, 0)::BIGINT AS n_unknown FROM d LEFT JOIN sums USING (rid)
"""
