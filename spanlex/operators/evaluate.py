"""Effectiveness of rankings: RBP, DCG, NDCG and average precision as coded in classic toolkits.

Input is ``judged(qid, rank, rel)`` with ranks from 1 without gaps. Where a formula divides by zero
(no relevant document for NDCG) the value is null, and means leave such queries out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("RBP", "DCG", "NDCG", "AP")


def clean_qrels(qrels: DataFrame) -> DataFrame:
    """One judgment per pair: null counts as 0, of contradicting ones the largest holds."""
    return qrels.where("qid is not null and doc_id is not null").groupBy("qid", "doc_id").agg(
        F.max(F.coalesce("rel", F.lit(0))).alias("rel")
    )


def judge(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Relevance by rank; what was not judged is not relevant."""
    return (
        ranking.select("qid", "rank", "doc_id")
        .join(clean_qrels(qrels), ["qid", "doc_id"], "left")
        .select("qid", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    )


def rbp(judged: DataFrame, p: float = 0.8) -> DataFrame:
    """Rank-biased precision with persistence p."""
    gain = F.col("rel") * F.pow(F.lit(p), F.col("rank") - 1)
    return judged.groupBy("qid").agg(((1.0 - p) * F.sum(gain)).alias("value"))


def dcg(judged: DataFrame, rank: str = "rank") -> DataFrame:
    return judged.groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col(rank) + 1.0)).alias("value"))


def ndcg(judged: DataFrame) -> DataFrame:
    """DCG over the DCG of the same documents in the best order."""
    ideal = F.row_number().over(W.partitionBy("qid").orderBy(F.col("rel").desc(), F.col("rank")))
    both = judged.withColumn("best", ideal)
    return both.groupBy("qid").agg(
        F.try_divide(
            F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)), F.sum(F.col("rel") / F.log2(F.col("best") + 1.0))
        ).alias("value")
    )


def ap(judged: DataFrame) -> DataFrame:
    """Precision at the relevant ranks, divided by the number of retrieved documents."""
    w = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        judged.withColumn("precision", F.avg("rel").over(w))
        .groupBy("qid")
        .agg((F.sum(F.col("precision") * F.col("rel")) / F.count(F.lit(1))).alias("value"))
    )


def metric(judged: DataFrame, name: str) -> DataFrame:
    """One value per query by a metric's name, in any case."""
    known = {"RBP": rbp, "DCG": dcg, "NDCG": ndcg, "AP": ap}
    if name.upper() not in known:
        raise ValueError(f"unknown metric {name!r}")
    return known[name.upper()](judged)


def values_of(rel: np.ndarray, p: float = 0.8) -> tuple[float, float, float | None, float]:
    """All metrics of one ranking, in the order of ``METRICS``: ``rel`` is the relevance by rank."""
    rank = np.arange(1.0, len(rel) + 1)
    discount = np.log2(rank + 1.0)
    gain, ideal = float((rel / discount).sum()), float((np.sort(rel)[::-1] / discount).sum())
    precision = np.cumsum(rel) / rank
    return float((1.0 - p) * (rel * p ** (rank - 1)).sum()), gain, gain / ideal if ideal else None, float((precision * rel).sum() / len(rel))


def mean(judged: DataFrame, name: str) -> DataFrame:
    """The mean over queries, one row."""
    return metric(judged, name).agg(F.lit(name.upper()).alias("metric"), F.avg("value").alias("value"))


def doc_number(doc_name: str = "doc_name"):
    """The number in names such as ``collection/3/17.txt``, as an expression."""
    return F.expr(f"try_cast(regexp_extract({doc_name}, '(\\\\d+)(\\\\.txt)?$', 1) as bigint)")
