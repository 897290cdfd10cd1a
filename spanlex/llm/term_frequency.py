"""Frequency of every distinct term, by last-seen counters.

Input and cleaning are those of the partial postings (see the cleaning operator of the core). Results for
every term: occurrences, records (documents) that hold it, and a mark: ``rare`` for a term of at most
``rare`` documents, ``common`` for one of more than ``common`` times the documents that have usable rows,
null for the rest. A term that is both is marked ``rare``. An empty table gives an empty result.

Tokens are hash-partitioned by term and ordered by record. A term keeps a counter of three numbers: its
occurrences, its records, and the last record in which it was seen. Going through its tokens in order, an
occurrence adds its frequency (once per passage, where corrections end), and a record is counted only
if it isn't the last one seen. No term holds a set of records. Heavy terms are found by a sketch first and their
records divided over several counters by salt; as no record is in two of them, occurrences and records of
the counters of a term add up, and the later of the last records is the last. The number of all records is
counted in a pass of its own, over ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlex.operators.partials import ordered, usable


def counters(postings: DataFrame, most: int | None = None) -> DataFrame:
    """``(term, salt, occurrences, records, last_record)``: the counters of every task."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    new = ~F.col("last_record").eqNullSafe(F.col("doc_id"))
    return ordered(postings, most).groupBy("h", "term", "salt").agg(
        F.sum(F.when(F.col("counts"), F.col("tf")).otherwise(zero)).alias("occurrences"),
        F.sum(F.when(new, one).otherwise(zero)).alias("records"),
        F.max("doc_id").alias("last_record"),
    ).drop("h")


def merged(counts: DataFrame) -> DataFrame:
    """The counters of each term as one."""
    return counts.groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.max("last_record").alias("last_record")
    )


def term_frequencies(postings: DataFrame, rare: int = 2, common: float = 0.5, most: int | None = None) -> DataFrame:
    """``(term, occurrences, records, mark)`` of every term of the collection."""
    counts = merged(counters(postings, most))
    total = usable(postings).select("doc_id").distinct().agg(F.count(F.lit(1)).alias("total"))  # a single row by construction
    mark = F.when(F.col("records") <= rare, "rare").when(
        F.col("records") > F.col("total") * F.lit(common), "common"
    )
    return counts.crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))
