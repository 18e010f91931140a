"""The tokenizer of full-text search: runs of letters and digits of the lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"[\p{L}\p{N}]+"
# The stop words that `remove_stop_words` leaves out.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]


def tokens(text: Column) -> Column:
    """The tokens of a text in order; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(PATTERN), F.lit(0))
