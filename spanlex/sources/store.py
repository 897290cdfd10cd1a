"""Index storage: parquet tables and a metadata row that records the analyzer and the posting codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlex.operators import lsi
from spanlex.operators.index import Analyzer, Index, decode_parts, encode_parts, posting_parts


def save(index: Index, path: str, codec: str | None = None, tables: str = "errorifexists") -> None:
    """Write an index to a fresh folder.

    With a codec, posting lists are stored as encoded bytes in parts, clustered by term; without one, as plain rows
    clustered by term, which Spark can prune. Either suits lists of any size. Nothing is overwritten.
    """
    spark = index.postings.sparkSession
    if codec:
        parts = encode_parts(posting_parts(index.postings), codec).repartitionByRange("term", "part")
        parts.sortWithinPartitions("term", "part").write.mode(tables).parquet(f"{path}/postings")
    else:
        rows = index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id")
        rows.write.mode(tables).parquet(f"{path}/postings")
    index.names.write.mode(tables).parquet(f"{path}/names")
    a = index.analyzer
    meta = [(codec or "rows", a.stop, a.stem, a.mode)]
    spark.createDataFrame(meta, "codec string, stop boolean, stem boolean, mode string").coalesce(1).write.mode(
        tables
    ).parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    """Read an index; the codec comes from its metadata. Readers never write."""
    meta = spark.read.parquet(f"{path}/meta").first()
    stored = spark.read.parquet(f"{path}/postings")
    postings = stored if meta["codec"] == "rows" else decode_parts(stored)
    names = spark.read.parquet(f"{path}/names")
    return Index(postings.select("doc_id", "term", "tf"), names, Analyzer(meta["stop"], meta["stem"], meta["mode"]))


def point_lookup(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Postings of some terms of a stored index: only the row groups that may hold them are read, only their bytes decoded."""
    stored = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(terms))
    return stored.select("term", "doc_id", "tf") if "tf" in stored.columns else decode_parts(stored)


def save_lsi(model: lsi.Model, path: str) -> None:
    """Write a model: vectors first, the singular values last, which make it complete."""
    spark = model.doc_vectors.sparkSession
    model.doc_vectors.write.mode("overwrite").parquet(f"{path}/lsi_vectors")
    spark.createDataFrame([(model.sigma,)], "sigma array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/lsi_sigma")


def load_lsi(spark: SparkSession, path: str) -> lsi.Model:
    sigma = spark.read.parquet(f"{path}/lsi_sigma").first()["sigma"]
    return lsi.Model(spark.read.parquet(f"{path}/lsi_vectors"), list(sigma))


def load_or_build_lsi(spark: SparkSession, index: Index, path: str, k: int | None = None) -> lsi.Model:
    """The stored model, or a new one, stored for the next time; one whose writing broke off is replaced."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lsi_sigma/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        save_lsi(lsi.build(index, k), path)
    return load_lsi(spark, path)


def scan(index: Index) -> DataFrame:
    """Parts of posting lists in term order, as a sequential reader sees them."""
    return posting_parts(index.postings).orderBy("term", "part")
