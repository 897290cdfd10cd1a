"""Top N items within every group, by two-stage salted ranking.

Input is ``results(qid, doc_id, doc_name, score, scored_at)``. Defined results:

* rows whose score is null or NaN are left out; of the rows of one (qid, doc_id) the latest ``scored_at``
  counts (a null one is the earliest; of rows equal in it the highest score, then the greatest name);
* order within a group is score descending, then ``doc_name`` descending as a string, null names last,
  then ``doc_id`` descending; 0.0 and -0.0 are equal;
* null qids form one group, null doc_ids one item; smaller groups come out whole; an empty table gives
  an empty result; further columns are ignored.

A group of any size is hashed into subgroups by item, at least as many as there are tasks, so no task ever holds a
whole large group. Superseded rows are dropped in every task before the shuffle and resolved after it, so an item
delivered very often is one row per task. Each subgroup keeps its first N, again before its rows meet; the survivors, at most
N per subgroup, are ranked once more. The first ranking is exact because all rows of an item share a subgroup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlex.session import shuffle_width

#: Subgroups of a group at least.
SUBGROUPS = 32


def latest(results: DataFrame, subgroups: int | None = None) -> DataFrame:
    """Usable rows, the one that counts of each (qid, doc_id), with the item's subgroup."""
    subgroups = subgroups or max(SUBGROUPS, shuffle_width(results.sparkSession))
    usable = results.where(F.col("score").isNotNull() & ~F.isnan("score")).select(
        "qid",
        F.pmod(F.xxhash64("doc_id"), F.lit(subgroups)).alias("sub"),
        "doc_id",
        F.struct("scored_at", (F.col("score") + F.lit(0.0)).alias("score"), "doc_name").alias("v"),
    )
    best = usable.groupBy("qid", "sub", "doc_id").agg(F.max("v").alias("v"))
    return best.select("qid", "sub", "doc_id", F.col("v.score").alias("score"), F.col("v.doc_name").alias("doc_name"))


def top_n(results: DataFrame, n: int = 10, subgroups: int | None = None) -> DataFrame:
    """``(qid, rank, doc_id, doc_name, score)`` of the n first items of every group."""
    if n < 1:
        raise ValueError("n must be at least 1")
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("doc_name"), F.desc_nulls_last("doc_id")]
    inner = W.partitionBy("qid", "sub").orderBy(*order)
    outer = W.partitionBy("qid").orderBy(*order)
    survivors = (
        latest(results, subgroups).withColumn("r", F.row_number().over(inner)).where(F.col("r") <= n).drop("r")
    )
    return (
        survivors.withColumn("rank", F.row_number().over(outer))
        .where(F.col("rank") <= n)
        .select("qid", "rank", "doc_id", "doc_name", "score")
    )
