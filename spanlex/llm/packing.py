"""Filling fixed-capacity containers with items, planned on the histogram of sizes.

Input is ``(id, size)``. Defined results: items of null, zero or negative size need no room and are left
out; an item longer than the capacity is split into full pieces and a rest, no other item is split; equal
sizes are told apart by id, repeated ids are separate items; an empty table needs no container.

Plan, on the driver, from the number of items of every size (at most ``capacity`` numbers):

1. Sizes are grouped into classes. Shallow combinations of classes whose sum falls into the window just
   below the capacity are enumerated.
2. Non-negative least squares finds how often to repeat each combination so that together they use up the
   histogram of classes; the counts are rounded down.
3. Each repeated combination is made concrete: the largest sizes left in its classes, for the last place the
   size that fills the container best, topped up as long as something fits. A concrete pattern is repeated
   until one of its sizes runs out, so their number follows the number of sizes, not of items.
4. What is left is packed greedily, the largest size first, each time followed by the largest that fits.

Items then find their places without meeting in one task: an item's rank among those of its size comes
from counts per (size, salt) and a numbering inside each, and the plan says which container that rank has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlex.session import durable, shuffle_width

CAPACITY = 2048
CLASSES = 32
DEPTH = 6
#: Subdivisions of the items of a size: as many as tasks, between these bounds.
SALTS, MOST_SALTS = 64, 256


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with x >= 0 by an active set: columns enter by gradient and leave when they turn negative."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(6 * a.shape[0]):
        gradient = np.where(used, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        used[best] = True
        while True:
            trial = np.zeros(n)
            trial[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (trial <= 0)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            used &= x > 1e-12
            x[~used] = 0.0
            if not used.any():
                break
    return x


def combinations(present: list[int], total: int, window: int, depth: int) -> list[tuple[int, ...]]:
    """Descending combinations of at most ``depth`` classes with a sum in ``[total - window, total]``."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, at: int, chosen: tuple[int, ...]) -> None:
        if chosen and left <= window:
            out.append(chosen)
        if len(chosen) == depth:
            return
        for i in range(at, len(present)):
            if present[i] <= left:
                grow(left - present[i], i, (*chosen, present[i]))

    grow(total, 0, ())
    return out


class Pattern(NamedTuple):
    sizes: tuple[int, ...]
    times: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> list[Pattern]:
    """Patterns that use up the histogram exactly, none larger than the capacity."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, count in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} does not fit")
        left[size] += count
    width = -(-capacity // classes)
    # the class of a size is its middle, counted in widths: sums of middles come out near sums of sizes
    cls = np.maximum(1, (np.arange(capacity + 1) + width // 2) // width)
    load = np.bincount(cls, weights=left, minlength=classes + 2)
    present = [int(c) for c in range(len(load) - 1, 0, -1) if load[c] > 0]
    out: list[Pattern] = []

    def largest(limit: int, group: int | None = None) -> int:
        """The largest size still there up to a limit, of one class or of any."""
        if group is None:
            found = np.flatnonzero(left[1 : limit + 1])
        else:
            lo = max(1, group * width - width // 2) if group > 1 else 1
            hi = min(limit, capacity, (group + 1) * width - width // 2 - 1)
            found = np.flatnonzero(left[lo : hi + 1]) + lo - 1 if hi >= lo else ()
        return int(found[-1]) + 1 if len(found) else 0

    def fill(chosen: list[int], room: int) -> list[int]:
        while room > 0:
            size = next_fit(chosen, room)
            if not size:
                break
            chosen.append(size)
            room -= size
        return chosen

    def next_fit(chosen: list[int], room: int, group: int | None = None) -> int:
        """As ``largest``, with the sizes already chosen taken off."""
        for c in chosen:
            left[c] -= 1
        size = largest(room, group)
        for c in chosen:
            left[c] += 1
        return size

    def use(chosen: list[int], most: int) -> int:
        values, each = np.unique(chosen, return_counts=True)
        times = int(min(most, (left[values] // each).min()))
        left[values] -= times * each
        out.append(Pattern(tuple(chosen), times))
        return times

    if present:
        columns = combinations(present, classes, 1, depth)
        matrix = np.zeros((len(load), max(1, len(columns))))
        for j, combination in enumerate(columns):
            for c in combination:
                matrix[c, j] += 1
        repeats = np.floor(nnls(matrix, load) + 1e-6).astype(np.int64) if columns else np.zeros(0, dtype=np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            again = int(repeats[j])
            while again > 0:
                chosen, room = [], capacity
                for c in columns[j]:
                    size = next_fit(chosen, room, c)
                    if not size:
                        break
                    chosen.append(size)
                    room -= size
                if len(chosen) < len(columns[j]):
                    break
                again -= use(fill(chosen, room), again)
    while left.any():
        use(fill([], capacity), int(left.sum()))
    return out


class Places(NamedTuple):
    """By size: the rank at which each stretch of the plan starts, its first container, items per container."""

    start: dict[int, np.ndarray]
    container: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    containers: int


def places(patterns: list[Pattern]) -> Places:
    seen: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for sizes, times in patterns:
        values, each = np.unique(sizes, return_counts=True)
        for size, n in zip(values.tolist(), each.tolist()):
            at = seen.get(size, 0)
            rows.setdefault(size, []).append((at, first, n))
            seen[size] = at + n * times
        first += times
    arrays = {size: np.array(r, dtype=np.int64) for size, r in rows.items()}
    return Places(
        {s: a[:, 0] for s, a in arrays.items()}, {s: a[:, 1] for s, a in arrays.items()}, {s: a[:, 2] for s, a in arrays.items()}, first
    )


def pieces(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(id, piece, start, n)``: what has to be placed, items over the capacity in pieces."""
    last = F.expr(f"cast((size - 1) div {capacity} as int)")
    rows = items.where("size > 0").select("id", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return rows.select("id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("size") - start).alias("n"))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(id, piece, start, n, container)`` for ``items(id, size)``.

    The driver receives one count per (size, salt): at most ``capacity * MOST_SALTS`` rows, however many items.
    """
    salts = min(MOST_SALTS, max(SALTS, shuffle_width(items.sparkSession)))
    rows = durable(
        pieces(items, capacity).withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int")), "sizes"
    )
    counts = rows.groupBy("n", "salt").count().collect()  # bounded: capacity * MOST_SALTS
    histogram: dict[int, int] = {}
    offsets: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["n"], r["salt"])):
        offsets[r["n"], r["salt"]] = histogram.get(r["n"], 0)
        histogram[r["n"]] = histogram.get(r["n"], 0) + r["count"]
    where = places(plan(histogram, capacity))
    base = np.zeros((capacity + 1, salts), dtype=np.int64)
    for (n, salt), offset in offsets.items():
        base[n, salt] = offset

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, salt, rank = (batch.column(i).to_numpy() for i in (3, 4, 5))
            rank = rank + base[n, salt]
            container = np.zeros(len(n), dtype=np.int64)
            for size in np.unique(n).tolist():
                of = np.flatnonzero(n == size)
                at = np.searchsorted(where.start[size], rank[of], side="right") - 1
                container[of] = where.container[size][at] + (rank[of] - where.start[size][at]) // where.each[size][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(container)], names=["id", "piece", "start", "n", "container"]
            )

    number = F.row_number().over(W.partitionBy("n", "salt").orderBy("id", "piece")) - 1
    ranked = rows.select("id", "piece", "start", "n", "salt", number.cast("bigint").alias("rank"))
    return ranked.mapInArrow(assign, "id bigint, piece int, start bigint, n bigint, container bigint")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row on containers ``(id, piece, start, n, container)``: their number, the items and sizes in them, the largest load, and the share of room used."""
    loads = packed.groupBy("container").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("pieces"))
    return loads.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("load"), F.lit(0)).alias("used"),
        F.max("load").alias("largest"),
        F.try_divide(F.sum("load").cast("double"), (F.count(F.lit(1)) * capacity).cast("double")).alias("fill"),
    )
