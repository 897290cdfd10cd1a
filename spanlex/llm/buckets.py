"""Candidate pairs out of hash buckets, for any bucket size.

Rows are ``(bucket, kind, id, code)``. A row of kind 0 is stored in its bucket and asks in it, one of kind
1 only asks (a further probe). All pairs of an asking and a stored row of a bucket are compared by their
short codes; those that pass are candidates.

A bucket that stores more than ``limit`` rows is split: stored rows are divided over blocks by hash, asking
rows visit every block. No pair is lost, no task holds more than one block, and the work of a hot bucket is
spread. Rows that ask stream past the block in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlex.session import durable, shuffle_width

LIMIT = 4096
#: Groups up to this many rows are compared row against row with growing distance, all groups at once.
SMALL = 24
#: Oversized buckets up to this number are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
#: Members of a group of copies in one task.
MEMBERS = 2048
#: Pairs a task holds before they are cut to the nearest.
HELD = 1_000_000
#: Cells in which rows are counted before buckets are.
CELLS = 1 << 18
SCHEMA = "bucket bigint, kind int, id bigint, code binary"

#: Similarities of all rows of one matrix of codes with all of another.
Compare = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Similarities of codes row by row.
CompareRows = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: The same with how far each similarity may be wrong.
Bounds = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
BoundsRows = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def codes(column: pa.Array) -> np.ndarray:
    """Binary values of equal length as a matrix of bytes."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(n, -1)


def split_large(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows with their ``block``: 0 in ordinary buckets. Kind 2 is a row that only stores."""
    stored = rows.where("kind <> 1").select("bucket", F.pmod(F.xxhash64("bucket"), F.lit(CELLS)).alias("cell"))
    # a bucket is in one cell: where no cell holds more than the limit no bucket does
    full = stored.groupBy("cell").count().where(F.col("count") > limit).select("cell")
    if full.isEmpty():
        return rows.withColumn("block", F.lit(0))
    some = stored.join(F.broadcast(full), "cell", "left_semi")  # at most CELLS numbers
    large = some.groupBy("bucket").count().where(F.col("count") > limit)
    number = large.count()
    if number == 0:
        return rows.withColumn("block", F.lit(0))
    large = large.select("bucket", F.ceil(F.col("count") / limit).cast("int").alias("blocks"))
    joined = rows.join(F.broadcast(large) if number <= BROADCAST else large, "bucket", "left")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    ordinary = joined.where("blocks is null").select("bucket", "kind", "id", "code", F.lit(0).alias("block"))
    hot = joined.where("blocks is not null")
    stored = hot.where("kind <> 1").select("bucket", F.lit(2).alias("kind"), "id", "code", own.alias("block"))
    asking = hot.where("kind <> 2").select(
        "bucket", F.lit(1).alias("kind"), "id", "code", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    return ordinary.unionByName(stored).unionByName(asking)


def candidates(rows: DataFrame, compare: Compare, compare_rows: CompareRows, floor: float, limit: int = LIMIT) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of pairs at or above ``floor``. ``rows`` is read twice and should be a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, limit):
            yield from _compare(table, compare, compare_rows, floor)

    return _ready(rows, limit).mapInArrow(run, "a bigint, b bigint").distinct()


def nearest(rows: DataFrame, bounds: Bounds, bounds_rows: BoundsRows, keep: int, limit: int = LIMIT) -> DataFrame:
    """Distinct ``(a, b)``, a < b: for every row that asks all stored ones that may be among its ``keep`` most similar.

    A partner is dropped only if ``keep`` others are more similar even at the far ends of their errors; that is
    decided in a block, again over a task and at last over all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        number = 0

        def rest() -> tuple[np.ndarray, ...]:
            return _cut(*(np.concatenate(x) for x in zip(*held)), keep)

        def batch(pairs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b", "high", "low"])

        for table in _groups(batches, limit):
            for part in _directed(table, bounds, bounds_rows, keep):
                held.append(part)
                number += len(part[0])
                if number > HELD:
                    held = [rest()]
                    number = len(held[0][0])
                    if number > HELD // 2:  # cutting again would gain little
                        yield batch(held[0])
                        held, number = [], 0
        if number:
            yield batch(rest())

    near = _ready(rows, limit).mapInArrow(run, "a bigint, b bigint, high float, low float")
    near = near.groupBy("a", "b").agg(F.max("high").alias("high"), F.max("low").alias("low"))
    near = near.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("low"))))
    least = F.min(F.when(F.col("r") == keep, F.col("low"))).over(W.partitionBy("a"))
    near = near.withColumn("least", least).where("least is null or high >= least")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ready(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with blocks, whole blocks in a task; stored rows come before those that only ask."""
    order = F.when(F.col("kind") == 1, 1).otherwise(0)
    return (
        split_large(rows, limit)
        .repartition(shuffle_width(rows.sparkSession), "bucket", "block")
        .withColumn("o", order)
        .sortWithinPartitions("bucket", "block", "o")
        .select("bucket", "block", "kind", "id", "code")
    )


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of whole blocks. Of a hot block several come, each with all that is stored."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        part = pa.Table.from_batches([batch])
        table = part if held is None else pa.concat_tables([held, part])
        bucket, block = table.column(0).to_numpy(), table.column(1).to_numpy()
        # the last group may go on
        change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
        if held.num_rows > 4 * limit:  # a hot block: what asks goes by, what is stored stays
            yield held
            kind = held.column(2).to_numpy()
            held = held.filter(pa.array(kind != 1))
            held = held.set_column(2, "kind", pa.array(np.full(held.num_rows, 2, dtype=np.int32)))
    if held is not None and held.num_rows:
        yield held


def _opened(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Kinds, ids and codes of a table of whole groups, and the start and size of each group."""
    table = table.combine_chunks()
    bucket, block, kind, ids = (table.column(i).to_numpy() for i in range(4))
    code = codes(table.column(4).chunk(0))
    start = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])))
    return kind, ids, code, start, np.diff(np.append(start, len(bucket)))


def _small(kind: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that may be compared in groups of up to ``SMALL`` rows."""
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    for distance in range(1, int(size[small].max(initial=1))):
        groups = small[size[small] > distance]
        # rows of a group that have a partner at this distance
        first = np.repeat(start[groups], size[groups] - distance)
        within = np.arange(len(first)) - np.repeat(np.cumsum(size[groups] - distance) - (size[groups] - distance), size[groups] - distance)
        i = first + within
        j = i + distance
        fits = _may(kind[i], kind[j]) & (ids[i] != ids[j])
        yield i[fits], j[fits]


def _large(kind: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows that ask, some at a time, with all that are stored in their group."""
    for g in np.flatnonzero(size > SMALL):
        rows = slice(start[g], start[g] + size[g])
        stores = np.flatnonzero(kind[rows] != 1) + start[g]
        asks = np.flatnonzero(kind[rows] != 2) + start[g]
        for at in range(0, len(asks), 1024):
            yield asks[at : at + 1024], stores


def _compare(table: pa.Table, compare: Compare, compare_rows: CompareRows, floor: float) -> Iterator[pa.RecordBatch]:
    """Pairs of all groups of a table of whole groups. Kind 0 stores and asks, 1 asks, 2 stores."""
    kind, ids, code, start, size = _opened(table)
    left, right = [], []
    for i, j in _small(kind, ids, start, size):
        good = compare_rows(code[i], code[j]) >= floor
        left.append(ids[i[good]])
        right.append(ids[j[good]])
    for some, stores in _large(kind, start, size):
        likeness = compare(code[some], code[stores])
        likeness[ids[some][:, None] == ids[stores][None, :]] = -np.inf
        i, j = np.nonzero(likeness >= floor)
        left.append(ids[some[i]])
        right.append(ids[stores[j]])
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _directed(table: pa.Table, bounds: Bounds, bounds_rows: BoundsRows, keep: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(asking, stored, high, low)`` of the pairs of a table of whole groups; large groups are cut to what may be near."""
    kind, ids, code, start, size = _opened(table)
    for i, j in _small(kind, ids, start, size):
        value, error = bounds_rows(code[i], code[j])
        for x, y in ((i, j), (j, i)):
            fits = (kind[x] != 2) & (kind[y] != 1)
            yield ids[x[fits]], ids[y[fits]], (value + error)[fits], (value - error)[fits]
    for some, stores in _large(kind, start, size):
        value, error = bounds(code[some], code[stores])
        value[ids[some][:, None] == ids[stores][None, :]] = -np.inf
        high, low = value + error, value - error
        good = high > -np.inf
        if low.shape[1] > keep:
            good &= high >= np.partition(low, -keep, axis=1)[:, -keep][:, None]
        i, j = np.nonzero(good)
        yield ids[some[i]], ids[stores[j]], high[good], low[good]


def _cut(a: np.ndarray, b: np.ndarray, high: np.ndarray, low: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """What may be among the ``keep`` most similar of each a; a pair counts once."""
    order = np.lexsort((b, a))
    a, b, high, low = a[order], b[order], high[order], low[order]
    one = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    a, b, high, low = a[one], b[one], high[one], low[one]
    order = np.lexsort((-low, a))
    a, b, high, low = a[order], b[order], high[order], low[order]
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    size = np.diff(np.append(start, len(a)))
    least = np.where(size >= keep, low[np.minimum(start + keep - 1, len(a) - 1)], -np.inf)
    good = high >= np.repeat(least, size)
    return a[good], b[good], high[good], low[good]


def _may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one of two rows asks and the other stores."""
    return ((a != 2) & (b != 1)) | ((b != 2) & (a != 1))


def copies_of_groups(keyed: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """``(rep, doc_id)`` of all documents of ``keyed(doc_id, *key)`` in ``groups(*key, rep)``.

    A group may hold any share of the documents, so the groups are sent to them as long as they are few; many
    groups are joined by a shuffle, in which no group can be much more than the others' sum.
    """
    groups = written(groups.select(*key, "rep"), "groups")
    sent = F.broadcast(groups) if groups.count() <= BROADCAST else groups
    return keyed.join(sent, key).select("rep", "doc_id")


def in_parts(members: DataFrame, size: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """``(rep, part, doc_id)`` of groups divided over parts of about ``size`` members, and ``(rep, parts)``."""
    parts = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part")
    number = parts.where("parts > 1").count()
    large = parts.where("parts > 1")
    divided = members.join(F.broadcast(large) if number <= BROADCAST else large, "rep", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return divided.select("rep", own, "doc_id"), parts


def every_member(rows: DataFrame, key: str, divided: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (of a written table) with each representative in ``key`` replaced by all members of its group, in turn."""
    known = rows.join(parts.withColumnRenamed("rep", key), key, "left")
    grouped = known.where("parts is not null").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    all_of = grouped.join(divided.withColumnRenamed("rep", key), [key, "part"]).drop(key, "part", "parts").withColumnRenamed("doc_id", key)
    return all_of.unionByName(known.where("parts is null").drop("parts"))


def written(rows: DataFrame, what: str) -> DataFrame:
    """Bucket rows as a written table: they are read for the sizes of buckets and again for the pairs."""
    return durable(rows, what)
