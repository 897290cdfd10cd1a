"""Session helpers: table access and the folder for durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whether the shuffle files of a query are removed as soon as it has ended.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, as the cluster names it.

    Only in a local session (tests, a laptop) a temporary folder takes its place where the setting is absent.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    own = getattr(spark.sparkContext, "_spanlex_shared", None)
    if own is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spanlex-")
        spark.sparkContext._spanlex_shared = own
    return own


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one, below one of this session that is removed when the session's driver ends."""
    context = spark.sparkContext
    base = getattr(context, "_spanlex_tables", None)
    if base is None:
        base = context._spanlex_tables = f"{shared_dir(spark)}/spanlex/{context.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, context, base)
    return f"{base}/{what}-{uuid.uuid4().hex}"


def _remove(context: SparkContext, path: str) -> None:
    """Delete a folder if the session is still there; what a killed driver leaves is for the cluster to clear."""
    try:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:
        pass


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made and run inside go as soon as each has ended."""
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


def durable(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The written table survives the loss of executors and cuts the lineage. A fresh folder
    is used for every call, so nothing is ever overwritten. The shuffle files of the writing go with its end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanlex_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``durable`` returned and nothing reads any more; others are left alone."""
    for each in tables:
        path = each.__dict__.get("_spanlex_path")
        if path:
            discard(each.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``fresh_path`` named."""
    _remove(spark.sparkContext, path)


def shuffle_width(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Arrow functions find it there."""
    context = spark.sparkContext
    if getattr(context, "_spanlex_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spanlex-ship-")) / "spanlex.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                archive.write(path, Path("spanlex") / path.relative_to(root))
    context.addPyFile(str(target))
    context._spanlex_shipped = True
