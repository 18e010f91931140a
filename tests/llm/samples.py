"""Texts and rows for the tests of the training-data operators."""

from __future__ import annotations

import random

#: Names that the operators add or use on the way.
CLASHES = ["q_n_words", "q_kept", "toxicity", "leaks", "text_key", "license", "tokens", "language", "lm", "class_id", "kept_only", "hits", "size", "taken", "rep", "a", "b", "n", "shard", "key", "grade"]
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{c} string' for c in CLASHES)}"
SYLLABLES = {"en": ["the", "ing", "ter", "wh", "ou", "and", "ly"], "de": ["sch", "ung", "ein", "ü", "keit", "ber", "ä"], "fr": ["eau", "é", "oi", "que", "ê", "leu", "ç"]}


def prose(rng: random.Random, lang: str, words: int) -> str:
    out = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


def odd_rows() -> list[tuple]:
    base = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, "b", 3), (4, "word", "en", None, 4), (4, "word", "en", None, 4),
        (5, "word " * 30_000, "en", "a", None), (6, "x" * 200_000, "de", "", 1), (7, "\x00\x7f # ! | 12", "fr", "b", 2), (8, "ünïcödé 😀 …", "de", "\U0001f600", 2), (None, "no id here at all", "en", "a", 1),
    ]
    return [(*r, *CLASHES) for r in base]
