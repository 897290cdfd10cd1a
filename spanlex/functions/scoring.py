"""Ranking formulas as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n: Column, df: Column) -> Column:
    """``ln(N/df)``, 0 for a term in no document."""
    return F.when(df <= 0, F.lit(0.0)).otherwise(F.log(F.try_divide(n.cast("double"), df.cast("double"))))


def tfidf(tf: Column, idf_: Column) -> Column:
    """``idf * (1 + ln tf)``, 0 for a tf below 1."""
    return F.when(tf <= 0, F.lit(0.0)).otherwise(idf_ * (1.0 + F.log(tf.cast("double"))))


def bm25_tf(tf: Column, dl: Column, avdl: Column, k1: float = 1.6, b: float = 0.75) -> Column:
    """The saturated and length-normalized term frequency."""
    t = tf.cast("double")
    norm = k1 * ((1.0 - b) + b * F.try_divide(dl.cast("double"), avdl)) + t
    return F.when(tf <= 0, F.lit(0.0)).otherwise(F.try_divide((k1 + 1.0) * t, norm))


def bm25(tf: Column, idf_: Column, dl: Column, avdl: Column, k1: float = 1.6, b: float = 0.75) -> Column:
    """BM25 weight of one term in one document."""
    return idf_ * bm25_tf(tf, dl, avdl, k1, b)


def bm25_bound(max_tf: Column, idf_: Column, min_dl: Column, avdl: Column, k1: float = 1.6, b: float = 0.75) -> Column:
    """Largest BM25 weight a term can reach: its largest tf in the shortest document."""
    return idf_ * bm25_tf(max_tf, min_dl, avdl, k1, b)


def weights_of(
    method: str, tf: np.ndarray, idf_: np.ndarray, dl: np.ndarray, avdl: float, k1: float = 1.6, b: float = 0.75
) -> np.ndarray:
    """The weights of many postings at once, for scoring whole blocks of documents."""
    if method == "tfidf":
        return idf_ * (1.0 + np.log(tf))
    return idf_ * ((k1 + 1.0) * tf / (k1 * ((1.0 - b) + b * (dl / avdl)) + tf))
