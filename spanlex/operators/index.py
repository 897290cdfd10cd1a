"""Inverted index as DataFrames.

``postings(doc_id, term, tf)``, ``term_stats(term, df, max_tf, cf)``, ``doc_stats(doc_id, dl)`` and
``corpus_stats(n, avdl, min_dl)``. A document counts in ``n`` only if a term of it survives analysis.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlex.functions import codec as C
from spanlex.functions.text import term_rows, tokens, without_stopwords
from spanlex.session import durable, shuffle_width

#: Bits of an id inside a range of documents, in which lists are walked, and postings of a stored part of a list.
RANGE_BITS, PART = 16, 512 * C.BLOCK
#: A term is heavy if it has more than one in so many times the tasks of all postings.
SHARE = 4


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms; one object serves documents and queries."""

    stop: bool = False
    stem: bool = False
    mode: str = "extended"

    def counts(self, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        return term_rows(df, keys, text, self.stop, self.stem, self.mode)


SURFACE = Analyzer()
STOPPED = Analyzer(stop=True)
FULL = Analyzer(stop=True, stem=True)


@dataclass
class Index:
    """The frames of one index. ``names(doc_id, doc_name)`` gives the tie-break key of rankings."""

    postings: DataFrame
    names: DataFrame
    analyzer: Analyzer = field(default_factory=Analyzer)

    @property
    def term_stats(self) -> DataFrame:
        return term_stats(self.postings)

    @property
    def doc_stats(self) -> DataFrame:
        return doc_stats(self.postings)

    @property
    def corpus_stats(self) -> DataFrame:
        return corpus_stats(self.doc_stats)


def build(docs: DataFrame, analyzer: Analyzer = SURFACE, method: str = "spimi") -> Index:
    """Index ``docs(doc_id, doc_name, text[, block])``.

    ``spimi`` counts each document in one pass. ``bsbi`` counts per block and merges the blocks' runs;
    both give the same index. Spilling and merging of runs are Spark's own.
    """
    if method == "spimi":
        postings = analyzer.counts(docs.select("doc_id", "text"), ["doc_id"])
    elif method == "bsbi":
        runs = analyzer.counts(docs.select("block", "doc_id", "text"), ["block", "doc_id"])
        postings = merge_postings(runs)
    else:
        raise ValueError(f"unknown method {method!r}")
    return Index(postings.select("doc_id", "term", "tf"), docs.select("doc_id", "doc_name"), analyzer)


def token_counts(docs: DataFrame, stop: bool = False) -> DataFrame:
    """Tokens and distinct tokens of every text, without a shuffle. A null text has none."""
    words = tokens("text")
    words = without_stopwords(words) if stop else words
    return docs.select("doc_id", words.alias("w")).select(
        "doc_id",
        F.coalesce(F.size("w"), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce(F.size(F.array_distinct("w")), F.lit(0)).cast("bigint").alias("n_distinct"),
    )


def merge_postings(*runs: DataFrame) -> DataFrame:
    """Union of runs, frequencies of equal (term, doc_id) summed."""
    union = runs[0].select("term", "doc_id", "tf")
    for run in runs[1:]:
        union = union.unionByName(run.select("term", "doc_id", "tf"))
    return union.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def term_stats(postings: DataFrame) -> DataFrame:
    """Documents, largest and total frequency of every term; combined map-side, so no hot key."""
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.sum("tf").alias("cf")
    )


def doc_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: documents, mean and least length (1 for an empty collection)."""
    return stats.where("dl > 0").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum("dl").cast("double"), F.count(F.lit(1)).cast("double")).alias("avdl"),
        F.coalesce(F.min("dl"), F.lit(1)).cast("bigint").alias("min_dl"),
    )


def vocabulary(postings: DataFrame) -> DataFrame:
    """Dense term ids from 0 in term order.

    Terms are range-partitioned and numbered inside each partition; the offsets of the partitions are
    a frame of as many rows as partitions. No single task sees all terms. The ranges are drawn from a sample, so
    the partitioned terms are written once, and both readings see the same ranges.
    """
    terms = postings.select("term").distinct().repartitionByRange("term").withColumn("p", F.spark_partition_id())
    ranged = durable(terms, "vocabulary")
    local = ranged.withColumn("i", F.row_number().over(W.partitionBy("p").orderBy("term")) - 1)
    # one row per partition: bounded by the number of shuffle partitions
    sizes = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("size"))
    start = F.sum("size").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("p", F.coalesce(start, F.lit(0)).alias("start"))
    return local.join(F.broadcast(offsets), "p").select("term", (F.col("start") + F.col("i")).alias("term_id"))


def lookup(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given ``terms(term)``; unknown terms have none."""
    return postings.join(terms.select("term").distinct(), "term", "left_semi")


def positioned(postings: DataFrame) -> DataFrame:
    """``(term, doc_id, tf, gap, at, total)``: every posting's place in its term's list, from 1, and the gap before it.

    The gap is the difference to the term's previous document id, the first id itself. Lists are walked in
    ranges of ids, so a term of every document is as many pieces as there are ranges of documents; only the
    numbers of postings and the last ids of the ranges are carried over. ``postings`` is read twice.
    """
    ranged = postings.select("term", "doc_id", "tf", F.shiftright("doc_id", RANGE_BITS).alias("range"))
    pieces = ranged.groupBy("term", "range").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    across = W.partitionBy("term").orderBy("range")
    borders = pieces.select(
        "term",
        "range",
        F.coalesce(F.sum("n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lag("last", 1, 0).over(across).alias("previous"),
        F.sum("n").over(W.partitionBy("term")).alias("total"),
    )
    inside = W.partitionBy("term", "range").orderBy("doc_id")
    local = ranged.withColumn("i", F.row_number().over(inside)).withColumn("prior", F.lag("doc_id").over(inside))
    return local.join(borders, ["term", "range"]).select(
        "term",
        "doc_id",
        "tf",
        (F.col("doc_id") - F.coalesce("prior", "previous")).alias("gap"),
        (F.col("before") + F.col("i")).alias("at"),
        "total",
    )


def posting_gaps(postings: DataFrame) -> DataFrame:
    return positioned(postings).select("term", "doc_id", "tf", "gap", "at")


def posting_parts(postings: DataFrame) -> DataFrame:
    """``(term, part, total, doc_ids, tfs, gaps)``: every term's list, ids ascending, in parts of up to ``PART`` postings.

    Parts hold whole blocks of the codecs, and all but a term's last are full.
    """
    rows = positioned(postings).withColumn("part", F.expr(f"cast((at - 1) div {PART} as int)"))
    packed = F.sort_array(F.collect_list(F.struct("at", "doc_id", "tf", "gap"))).alias("l")  # at most PART
    return rows.groupBy("term", "part").agg(packed, F.max("total").alias("total")).select(
        "term", "part", "total", F.col("l.doc_id").alias("doc_ids"), F.col("l.tf").alias("tfs"), F.col("l.gap").alias("gaps")
    )


def posting_lists(postings: DataFrame) -> DataFrame:
    """One row per term with ids ascending and their frequencies: whole lists as one value, for those who want that."""
    parts = F.sort_array(F.collect_list(F.struct("part", "doc_ids", "tfs"))).alias("l")
    whole = posting_parts(postings).groupBy("term").agg(parts)
    return whole.select("term", F.flatten("l.doc_ids").alias("doc_ids"), F.flatten("l.tfs").alias("tfs"))


ENCODED = "term string, part int, total bigint, base bigint, codec string, postings binary, tfs binary"


def encode_parts(parts: DataFrame, codec: str) -> DataFrame:
    """Parts of lists as bytes; those of a term one after the other are the bytes of its list. ``base`` is the id before a part."""
    if codec not in C.CODECS:
        raise ValueError(f"unknown codec {codec!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ids, tfs, gaps = (_flat(batch.column(i)) for i in (3, 4, 5))
            part, total = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            heads = np.where(part == 0, total, -1)
            begins = ids[1][:-1]
            base = ids[0][begins] - gaps[0][begins] if n else np.empty(0, dtype=np.int64)
            out = [_blobs(*C.encode_batch(v, o, codec, heads)) for v, o in (ids if codec == "standard" else gaps, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(base), pa.array([codec] * n, pa.string()), *out],
                names=["term", "part", "total", "base", "codec", "postings", "tfs"],
            )

    return parts.select("term", "part", "total", "doc_ids", "tfs", "gaps").mapInArrow(run, ENCODED)


def decode_parts(encoded: DataFrame) -> DataFrame:
    """``(term, doc_id, tf)`` of encoded parts, each of which names its codec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, part, base, codec = (batch.column(i) for i in (0, 1, 2, 3))
            ids, tfs, sizes = [], [], []
            for p, b, c, x, y in zip(part.to_pylist(), base.to_pylist(), codec.to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                values = C.decode_one(x, c, p == 0)
                ids.append(values if c == "standard" else b + np.cumsum(values))
                tfs.append(C.decode_one(y, c, p == 0))
                sizes.append(len(values))
            if sizes:
                again = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [terms.take(again), pa.array(np.concatenate(ids)), pa.array(np.concatenate(tfs))], names=["term", "doc_id", "tf"]
                )

    return encoded.select("term", "part", "base", "codec", "postings", "tfs").mapInArrow(run, "term string, doc_id bigint, tf bigint")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lists of a column, and where each list begins."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blobs(data: bytes, starts: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def size_standard(postings: DataFrame) -> DataFrame:
    eight = (F.count(F.lit(1)) * 8).alias
    return postings.groupBy("term").agg(eight("postings_bytes"), eight("tfs_bytes"))


def size_vbe(postings: DataFrame) -> DataFrame:
    """Bytes per term in the variable-byte codec, computed without encoding."""
    return posting_gaps(postings).groupBy("term").agg(
        F.sum(C.vb_size(F.col("gap"))).alias("postings_bytes"), F.sum(C.vb_size(F.col("tf"))).alias("tfs_bytes")
    )


def _pfor_total(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``4 + sum over blocks of (4 + 3 + slots + exceptions)`` for one stream."""
    w = W.partitionBy("term", "block")
    ranked = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn(
        "r", F.row_number().over(w.orderBy(F.col(value))) - 1
    )
    at_90 = F.max(F.when(F.col("r") == F.expr("(9 * (n - 1)) div 10"), C.bit_width(F.col(value)))).over(w)
    wide = C.bit_width(F.col(value)) > F.col("b")
    return (
        ranked.withColumn("b", at_90)
        .groupBy("term", "block")
        .agg(
            F.ceil(F.max("n") * F.max("b") / 8.0).alias("slots"),
            F.sum(F.when(wide, C.vb_size(F.col(value)) + 1).otherwise(0)).alias("patches"),
        )
        .groupBy("term")
        .agg((F.sum(7 + F.col("slots") + F.col("patches")) + 4).cast("bigint").alias(out))
    )


def size_pfor(postings: DataFrame) -> DataFrame:
    """Bytes per term in the patched frame-of-reference codec, computed without encoding."""
    rows = posting_gaps(postings).withColumn("block", F.expr("(at - 1) div 128"))
    return _pfor_total(rows, "gap", "postings_bytes").join(_pfor_total(rows, "tf", "tfs_bytes"), "term")


def with_statistics(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """Postings with the statistics ``(term, df, ...)`` of their term, heavy terms spread over tasks.

    A heavy term has more than one in ``SHARE * tasks`` of the postings, so there are fewer than that many, which is
    the bound that makes them fit for a broadcast. Its postings get a salt by document, its statistics are
    repeated for every salt.
    """
    most = SHARE * shuffle_width(postings.sparkSession)
    whole = stats.agg(F.sum("df").alias("all"))  # one row
    heavy = stats.crossJoin(F.broadcast(whole)).where(F.col("df") * most > F.col("all"))
    heavy = F.broadcast(heavy.select("term", F.ceil(F.col("df") * most / F.col("all")).cast("int").alias("salts")))
    spread = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int")
    left = postings.join(heavy, "term", "left").withColumn("salt", spread).drop("salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    right = stats.join(heavy, "term", "left").withColumn("salt", copies).drop("salts")
    return left.join(right, ["term", "salt"]).drop("salt")
