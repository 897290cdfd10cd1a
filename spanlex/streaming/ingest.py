"""Continuous ingestion: documents arriving as a stream become runs of partial postings.

Every micro-batch writes one run ``(run_id, term, doc_id, tf)``; the index is made of all runs. A batch that
is repeated after a failure replaces its own run. A document that comes again in a later batch replaces
what earlier runs hold of it, also if no term of it is left; of rows of a document in one batch the terms are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlex.operators.index import SURFACE, Analyzer, Index


def index_stream(docs: DataFrame, path: str, analyzer: Analyzer = SURFACE) -> StreamingQuery:
    """Index a stream of ``docs(doc_id, doc_name, text)`` under ``path`` until what is there has been read."""

    def write(batch: DataFrame, run: int) -> None:
        counts = analyzer.counts(batch.select("doc_id", "text"), ["doc_id"])
        counts.write.mode("overwrite").parquet(f"{path}/runs/run_id={run}")
        batch.select("doc_id", "doc_name").write.mode("overwrite").parquet(f"{path}/names/run_id={run}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str, analyzer: Analyzer = SURFACE) -> Index:
    """The index over all runs written so far."""
    names = spark.read.parquet(f"{path}/names")
    latest = names.groupBy("doc_id").agg(F.max(F.struct("run_id", "doc_name")).alias("m"))
    latest = latest.select("doc_id", F.col("m.run_id").alias("run_id"), F.col("m.doc_name").alias("doc_name"))
    runs = spark.read.parquet(f"{path}/runs").join(latest.select("doc_id", "run_id"), ["doc_id", "run_id"], "left_semi")
    return Index(runs.select("doc_id", "term", "tf"), latest.select("doc_id", "doc_name"), analyzer)
