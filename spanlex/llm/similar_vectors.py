"""Most similar vectors for every vector, by cross-polytope hashing.

Input is ``vectors(doc_id, vec, built_at)``. Defined results:

* vectors that are null, not ``size`` long, all zero or hold a null, NaN or infinite value are left out, and
  so are rows without a doc_id; of the remaining rows of a document the latest ``built_at`` counts (a null
  one is the earliest, of equal ones the greatest vector);
* similarity is the cosine; equal ones are ordered by the smaller doc_id; no document is its own neighbour;
* fewer neighbours come out if there are fewer other documents; an empty table gives an empty result.

A hash is the signed axis nearest to a vector after a pseudo-random rotation, which is three rounds of
random signs and a fast Hadamard transform. A table joins several hashes into a bucket number. Each vector is
stored in one bucket per table and asks in that one and in the next likely ones (multiprobe). Candidates
are compared by short codes first; what may reach the wanted similarity is reranked with the exact
vectors. For lists the codes have eight bits and carry their error, and all that may be among the nearest
within that error is reranked.

Copies, documents with the very same vector, are represented by one of them, so a group of copies of any
size is one row in every bucket; they return at the end, at most ``k + 1`` of each group per neighbour list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlex.llm import buckets
from spanlex.operators.vectors import nearest as exact_nearest

SIZE = 64
#: Vectors that a list is chosen from in every table, at least, as far as there are so many.
SEEN = 400
#: Vectors sent to the tasks at once where lists are compared with the exact ones.
CHUNK = 50_000
SEED = 20240101


def usable(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, vec)``: the vector that counts of every document."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("vec", lambda x: x != 0)
    rows = vectors.where(F.col("doc_id").isNotNull() & F.col("vec").isNotNull()).where(F.size("vec") == size)
    rows = rows.where(~bad & ~zero)
    best = rows.groupBy("doc_id").agg(F.max(F.struct("built_at", F.col("vec").cast("array<double>").alias("vec"))).alias("m"))
    return best.select("doc_id", F.col("m.vec").alias("vec"))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalized fast Hadamard transform of every row; the length is a power of two."""
    n, size = rows.shape
    half = 1
    while half < size:
        pair = rows.reshape(n, size // (2 * half), 2, half)
        rows = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return rows / np.float32(math.sqrt(size))


def signs(tables: int, hashes: int, size: int, seed: int = SEED) -> np.ndarray:
    """The random signs of all rotations, the same wherever they are drawn."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.float32), size=(tables, hashes, 3, size))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaling by the largest value first keeps squares in range."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def probes(rows: np.ndarray, rotations: np.ndarray, number: int) -> np.ndarray:
    """Bucket numbers of one table: the nearest, then the next likely ones by loss of projection over all hashes."""
    n, size = rows.shape
    depth = min(max(number, 1), size)
    place, loss = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1), dtype=np.float32)
    for rounds in rotations:
        turned = rows
        for flip in rounds:
            turned = hadamard(turned * flip)
        large = np.abs(turned)
        top = np.argpartition(-large, depth - 1, axis=1)[:, :depth]
        height = np.take_along_axis(large, top, axis=1)
        order = np.argsort(-height, axis=1, kind="stable")
        top, height = np.take_along_axis(top, order, axis=1), np.take_along_axis(height, order, axis=1)
        axis = top.astype(np.int64) * 2 + (np.take_along_axis(turned, top, axis=1) > 0)
        # both sides are in order, so place i of one and j of the other has (i + 1)(j + 1) - 1 no worse before it
        i, j = np.nonzero(np.outer(np.arange(1, loss.shape[1] + 1), np.arange(1, depth + 1)) <= max(number, 1))
        both = loss[:, i] + (height[:, :1] - height)[:, j]
        best = np.argsort(both, axis=1, kind="stable")[:, : max(number, 1)]
        loss = np.take_along_axis(both, best, axis=1)
        place = np.take_along_axis(place[:, i] * (2 * size) + axis[:, j], best, axis=1)
    return place


def four_bits(rows: np.ndarray) -> np.ndarray:
    """Two coordinates a byte, each as -7..7 times the row's largest value."""
    scaled = np.rint(rows / np.abs(rows).max(axis=1, keepdims=True) * 7).astype(np.int8) + 8
    return (scaled[:, 0::2] << 4 | scaled[:, 1::2]).astype(np.uint8)


def _restored(code: np.ndarray) -> np.ndarray:
    out = np.empty((len(code), code.shape[1] * 2), dtype=np.float32)
    out[:, 0::2], out[:, 1::2] = code >> 4, code & 15
    out -= 8
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def eight_bits(rows: np.ndarray) -> np.ndarray:
    """A byte a coordinate, as -127..127 times the row's largest value, then the length of the error in four bytes."""
    scaled = np.rint(rows / np.abs(rows).max(axis=1, keepdims=True) * 127).astype(np.int8)
    # what 32-bit arithmetic may add is far below 1e-5
    error = np.sqrt(((rows - _restored_eight(scaled)) ** 2).sum(axis=1)) + np.float32(1e-5)
    return np.concatenate([scaled.view(np.uint8), error.astype("<f4")[:, None].view(np.uint8)], axis=1)


def _restored_eight(scaled: np.ndarray) -> np.ndarray:
    out = scaled.astype(np.float32)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _parts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and error lengths of eight-bit codes."""
    return _restored_eight(np.ascontiguousarray(code[:, :-4]).view(np.int8)), np.ascontiguousarray(code[:, -4:]).view("<f4")[:, 0]


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of all pairs of eight-bit codes, and how far the exact ones may be from them."""
    (x, e), (y, f) = _parts(a), _parts(b)
    return x @ y.T, e[:, None] + f[None, :]


def bounds_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (x, e), (y, f) = _parts(a), _parts(b)
    return np.einsum("ij,ij->i", x, y), e + f


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _restored(a) @ _restored(b).T


def likeness_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", _restored(a), _restored(b))


def bucket_rows(
    reps: DataFrame, tables: int, hashes: int, number: int, asks: str | None = None, encode: Callable[[np.ndarray], np.ndarray] = four_bits
) -> DataFrame:
    """Bucket rows of ``reps(doc_id, vec[, asks])``; only rows whose ``asks`` holds send further probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            ids = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy().reshape(n, -1)
            asking = batch.column(2).to_numpy(zero_copy_only=False)
            rows = unit(flat).astype(np.float32)
            size = rows.shape[1]
            code = encode(rows)
            turns = signs(tables, hashes, size)
            asks_at, silent = np.flatnonzero(asking), np.flatnonzero(~asking)
            for t in range(tables):
                reach = probes(rows[asks_at], turns[t], number)
                home = np.empty(n, dtype=np.int64)
                home[asks_at], home[silent] = reach[:, 0], probes(rows[silent], turns[t], 1)[:, 0]
                index = np.concatenate([np.arange(n), np.repeat(asks_at, reach.shape[1] - 1)])
                bucket = np.concatenate([home, reach[:, 1:].reshape(-1)]) * tables + t
                kind = np.ones(len(index), dtype=np.int32)
                kind[:n] = np.where(asking, 0, 2)
                data = pa.py_buffer(np.ascontiguousarray(code[index]).tobytes())
                ends = pa.py_buffer((np.arange(len(index) + 1) * code.shape[1]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(kind), pa.array(ids[index]), pa.BinaryArray.from_buffers(pa.binary(), len(index), [None, ends, data])],
                    names=["bucket", "kind", "id", "code"],
                )

    rows = reps.select("doc_id", "vec", F.expr(asks).alias("asks") if asks else F.lit(True).alias("asks"))
    return rows.mapInArrow(run, buckets.SCHEMA)


def hashes_for(n: int, size: int = SIZE, fill: int = 200, most: int = 8) -> int:
    """Hashes per table, so that buckets hold about ``fill`` vectors of a spread-out collection or fewer, as far as ``most`` hashes allow."""
    return min(most, max(1, math.ceil(math.log(max(1, n / fill)) / math.log(2 * size))))


def neighbours(
    vectors: DataFrame,
    k: int = 10,
    least: float | None = None,
    asks: str | None = None,
    tables: int = 4,
    number: int = 3,
    hashes: int | None = None,
    size: int = SIZE,
    more: int = 1,
) -> DataFrame:
    """``(doc_id, neighbour, rank, similarity)``: the k most similar others of every document.

    ``least`` leaves out neighbours below a similarity and makes the search cheaper: candidates below it by
    more than the codes can be wrong are dropped early. ``asks`` restricts the documents that get a list, not
    those searched. Accuracy is set by ``tables`` and ``number`` (buckets asked per table); each hash beyond the
    first asks ``more`` times as many, as neighbours that are not very similar seldom share several hashes.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    vecs = usable(vectors, size)
    keyed = vecs.select("doc_id", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("g"))
    groups = keyed.groupBy("h", "g").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    copies = groups.where("members > 1")
    # (rep, doc_id) of all documents in groups of copies
    members = buckets.written(buckets.copies_of_groups(keyed, copies, ["h", "g"]), "copies")
    others = members.where("doc_id <> rep").select("doc_id")
    reps = vecs.join(others, "doc_id", "left_anti")
    if asks:
        wanted = members.where(asks).select(F.col("rep").alias("doc_id")).distinct().withColumn("by_copy", F.lit(True))
        reps = reps.join(wanted, "doc_id", "left")
        reps = reps.withColumn("asks", F.coalesce("by_copy", F.lit(False)) | F.expr(asks)).drop("by_copy")
    # further probes of a third hash would be many more rows than larger buckets are
    count = vectors.count()
    n = hashes or hashes_for(count, size, most=2 if more > 1 else 8)
    if least is None and n == 1:  # buckets of a small collection hold little, so more of them are asked
        number = max(number, min(size, -(-SEEN * 2 * size // max(1, count))))
    encode = eight_bits if least is None else four_bits
    rows = bucket_rows(reps, tables, n, number * more ** (n - 1), "asks" if asks else None, encode)
    rows = buckets.written(rows, "vector-buckets")
    if least is None:
        pairs = buckets.nearest(rows, bounds, bounds_rows, k + 1)
    else:
        pairs = buckets.candidates(rows, likeness, likeness_rows, least - 0.1)
    exact = rerank(pairs, reps, least)
    both = exact.select(F.col("a").alias("rep"), F.col("b").alias("other"), "similarity").unionByName(
        exact.select(F.col("b").alias("rep"), F.col("a").alias("other"), "similarity")
    )
    first = W.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    both = both.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    # the first k + 1 documents of each group stand for it in the lists of others
    few = W.partitionBy("rep").orderBy("doc_id")
    shown = members.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).drop("r")
    spread = both.join(shown.select(F.col("rep").alias("other"), F.col("doc_id").alias("member")), "other", "left")
    lists = spread.select("rep", F.coalesce("member", "other").alias("neighbour"), "similarity").unionByName(
        shown.select("rep", F.col("doc_id").alias("neighbour"), F.lit(1.0).alias("similarity"))
    )
    order = [F.desc("similarity"), F.asc("neighbour")]
    lists = lists.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(*order))).where(F.col("r") <= k + 1)
    # every member of a group gets the group's list; a large group is divided over tasks
    lists = buckets.written(lists.select("rep", "neighbour", "similarity"), "lists")
    each = buckets.every_member(lists, "rep", *buckets.in_parts(members)).withColumnRenamed("rep", "doc_id").where("doc_id <> neighbour")
    if asks:
        each = each.where(asks)
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("doc_id", "neighbour", "rank", "similarity")


def rerank(pairs: DataFrame, vecs: DataFrame, least: float | None) -> DataFrame:
    """Exact cosines ``(a, b, similarity)`` of candidate pairs."""
    a = vecs.select(F.col("doc_id").alias("a"), F.col("vec").alias("va"))
    b = vecs.select(F.col("doc_id").alias("b"), F.col("vec").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x, y = (unit(batch.column(i).flatten().to_numpy().reshape(n, -1)) for i in (2, 3))
            cosine = np.clip((x * y).sum(axis=1), -1.0, 1.0)
            good = np.arange(n) if least is None else np.flatnonzero(cosine >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(cosine[good])],
                names=["a", "b", "similarity"],
            )

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb")
    return joined.mapInArrow(run, "a bigint, b bigint, similarity double")


def similar_pairs(vectors: DataFrame, k: int = 10, least: float = 0.9) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, a < b: one is among the k most similar of the other, at ``least`` or more."""
    near = neighbours(vectors, k, least)
    return near.select(
        F.least("doc_id", "neighbour").alias("doc_id_a"), F.greatest("doc_id", "neighbour").alias("doc_id_b")
    ).distinct()


def recall(vectors: DataFrame, asks: str, k: int = 10, size: int = SIZE, **how) -> DataFrame:
    """``(asked, recall)``, one row: the lists of ``neighbours`` against all vectors, exactly, for the documents asked for.

    A list's entry counts if it is as similar as the exact k-th; a list is as long as there are other documents. The
    vectors asked for go to the tasks ``CHUNK`` at a time, which scan all vectors for each chunk.
    """
    vecs = buckets.written(usable(vectors, size), "usable")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    docs = vecs.select("doc_id", F.col("doc_id").cast("string").alias("doc_name"), F.transform("vec", lambda x: x / norm).alias("vec"))
    found = buckets.written(neighbours(vectors, k, asks=asks, size=size, **how), "found")
    wanted = docs.where(asks)
    parts = max(1, -(-wanted.count() // CHUNK))
    out = None
    for part in range(parts):
        some = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part).select("doc_name", "vec").toArrow()  # about CHUNK
        matrix = np.array(some.column(1).to_pylist()).reshape(-1, size)
        rows = exact_nearest(docs, some.column(0).to_pylist(), matrix, k + 1).where("qid <> doc_name")
        out = rows if out is None else out.unionByName(rows)
    near = out.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("r") <= k)
    least = near.groupBy(F.col("qid").cast("bigint").alias("doc_id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("length"))
    hits = found.join(least, "doc_id").where("similarity >= least - 1e-8").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
    each = least.join(hits, "doc_id", "left").select(F.least(F.coalesce("hits", F.lit(0)) / F.col("length"), F.lit(1.0)).alias("share"))
    return each.agg(F.count(F.lit(1)).alias("asked"), F.avg("share").alias("recall"))
