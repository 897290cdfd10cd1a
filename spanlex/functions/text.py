"""Text analysis: lower case, word characters, stop words, stems."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlex.functions.stemmer import stem_column
from spanlex.functions.stopwords import ENGLISH

# Letters, numbers and the underscore of every script: what Python's \w matches.
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column | str) -> Column:
    """All words of the lower-cased text in order; null for a null text, empty for an empty one."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def without_stopwords(words: Column, stopwords: Iterable[str] = ENGLISH) -> Column:
    """The words that are no stop words. The list is a literal, so the test stays in the scan stage."""
    return F.filter(words, lambda w: ~w.isin(*stopwords))


def term_rows(
    df: DataFrame, keys: list[str], text: str = "text", stop: bool = False, stem: bool = False, mode: str = "extended"
) -> DataFrame:
    """Count the terms of every text: one row ``(keys..., term, tf)``.

    The same analysis serves documents and queries. Stemming runs over the distinct vocabulary
    only, which is joined back to the counted terms, so Python never sees single tokens.
    """
    words = tokens(text)
    if stop:
        words = without_stopwords(words)
    counted = (
        df.select(*keys, F.explode(words).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    if not stem:
        return counted
    stems = counted.select("term").distinct().select("term", stem_column("term", mode).alias("stem"))
    return (
        counted.join(stems, "term")
        .groupBy(*keys, F.col("stem").alias("term"))
        .agg(F.sum("tf").alias("tf"))
    )
