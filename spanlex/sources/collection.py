"""Sources: text collections, query files and relevance judgments."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlex.session import shuffle_width


def text_collection(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_id, doc_name, block, text)`` of a directory tree of UTF-8 files, one document per file.

    ``doc_name`` is the path below ``root``, ``block`` its first folder. Ids are dense in the order of names,
    numbered per range partition. Undecodable bytes separate words, as other non-word characters do.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    base = root.rstrip("/").removeprefix("file://")
    path = F.expr("url_decode(regexp_replace(input_file_name(), '[+]', '%2B'))")
    rows = files.select(path.alias("path"), F.col("value").alias("text"))
    name = F.expr(f"substring_index(path, '{base}/', -1)")
    rows = rows.select(name.alias("doc_name"), "text")
    from spanlex.operators.index import vocabulary

    ids = vocabulary(rows.select(F.col("doc_name").alias("term"))).withColumnsRenamed({"term": "doc_name", "term_id": "doc_id"})
    block = F.when(F.instr("doc_name", "/") > 0, F.substring_index("doc_name", "/", 1)).otherwise("")
    return rows.join(ids, "doc_name").select("doc_id", "doc_name", block.alias("block"), "text")


def write_files(docs: DataFrame, root: str) -> None:
    """One file for every row of ``docs(block, doc_id, text)``, in a folder per block, written by the tasks that hold the rows."""
    rows = docs.where("text is not null").select("block", "doc_id", F.monotonically_increasing_id().alias("n"), F.encode("text", "utf-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        made: dict[str | None, str] = {}
        written = 0
        for batch in batches:
            for block, doc, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if block not in made:
                    made[block] = f"{base}/none" if block is None else f"{base}/block={quote(block, safe='')}"
                    files.create_dir(made[block])
                with files.open_output_stream(f"{made[block]}/{doc}-{n}.txt") as out:  # a repeated task writes the same file
                    out.write(text)
            written += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([written])], names=["n"])

    rows.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def _folders(spark: SparkSession, root: str) -> DataFrame:
    """``(folder)``: the folders of blocks below the root, a task for each."""
    files, base = fs.FileSystem.from_uri(root)
    below = [(x.base_name,) for x in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory]
    return spark.createDataFrame(below, "folder string").repartition(max(1, len(below)), "folder")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_id, block, text)`` of the files of ``write_files``. Folders are listed by tasks; the driver sees the folders only."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f"{folder}/{x.base_name}" for x in files.get_file_info(fs.FileSelector(f"{base}/{folder}"))]
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 10_000], pa.string())], names=["name"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.column(0).slice(at, 1000).to_pylist()
                data = []
                for name in some:
                    with files.open_input_stream(f"{base}/{name}") as file:
                        data.append(file.read().decode("utf-8", "replace"))
                ids = [int(x.rsplit("/", 1)[1].rsplit("-", 1)[0]) for x in some]
                blocks = [unquote(x.split("/", 1)[0].removeprefix("block=")) if x.startswith("block=") else None for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blocks, pa.string()), pa.array(data, pa.string())], names=["doc_id", "block", "text"])

    listed = _folders(spark, root).mapInArrow(names, "name string")
    return listed.repartition(shuffle_width(spark), "name").mapInArrow(texts, "doc_id bigint, block string, text string")


def remove_files(spark: SparkSession, root: str) -> None:
    """Delete the folders of blocks, a task for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                if files.get_file_info(f"{base}/{folder}").type == fs.FileType.Directory:
                    files.delete_dir(f"{base}/{folder}")
            yield batch

    _folders(spark, root).mapInArrow(run, "folder string").agg(F.count(F.lit(1))).collect()


def plain_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, text)`` of a file with one query per line; blank lines are dropped, qids are line numbers from 1."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return lines.where(F.trim("line") != "").select((F.col("n") + 1).cast("string").alias("qid"), F.trim("line").alias("text"))


def keyed_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, text)`` of lines ``qid word word ...``; blank lines are dropped."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(words.alias("w"))
    return rows.select(F.element_at("w", 1).alias("qid"), F.array_join(F.expr("slice(w, 2, size(w))"), " ").alias("text"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, doc_id, rel)``: every pair listed in the first two columns is relevant; lines without a number there are left out."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(words.alias("w")).where(F.size("w") >= 2)
    pairs = rows.select(F.element_at("w", 1).alias("qid"), F.element_at("w", 2).try_cast("bigint").alias("doc_id"), F.lit(1).alias("rel"))
    return pairs.where("doc_id is not null").distinct()
