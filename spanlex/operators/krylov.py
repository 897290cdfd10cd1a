"""Truncated singular value decomposition of a sparse matrix of any size, by block Lanczos iterations with restarts.

Rows are ``(doc_id, t, w)``: the columns and values of a row, sorted or not, and perhaps ``d``: the sum of squares of what else
the row has in columns of its own, which no other row has a value in. Wanted are the k largest singular values of the
matrix X and the left singular vectors, a vector of k numbers for every row. A column of one row adds its square to one
place of the diagonal of X X' and nothing else, so those columns need no numbers: X X' is X_c X_c' + D with the
columns X_c that several rows have.

A block of vectors is multiplied by X X' again and again; each product is made orthogonal, twice, to all blocks before
it. The best vectors inside the space that the blocks span are found from small matrices (Rayleigh and Ritz), which also tell
their residuals. When the space has grown to ``LARGEST`` times k, it is cut to its best vectors and grown again (thick restart),
so that the numbers held per row are bounded. At the end the iteration is begun anew from random vectors orthogonal to what was
found: singular values that occur more often than a block is wide would else be missed.

Rows are held in parts, files in the shared folder; a step is a few queries whose tasks read and write parts. X'Y has a row
per column of X_c; it is summed up by the tasks in ranges of columns of bounded size, so neither the driver nor a task holds
anything as long as a side of the matrix. What a step has read is removed with it.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlex.session import discard, durable, fresh_path

#: Numbers of a range of X'Y.
CELLS = 8_000_000
#: Rows of a part, and parts of a task at most.
PART, HELD = 4096, 64
#: Vectors of a block as a share of k, and vectors of the space as a multiple of k at most.
BLOCK, LARGEST = 1 / 3, 2.5
#: Residuals relative to the largest eigenvalue, and singular values below a share of the largest count as zero.
TOLERANCE, NOTHING = 3e-7, 1e-6
#: Directions of a product whose square is below this share of the largest are rounding.
LOST = 1e-13
#: Blocks after new random vectors until it counts as certain that nothing was missed, and steps at most; what has not converged by then is as good as it got.
CERTAIN, STEPS = 2, 200


def _start(ids: np.ndarray, size: int, draw: int = 0) -> np.ndarray:
    """Start vectors of signs, fixed by the row's id."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1 + draw, draw + size + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return 1.0 - 2.0 * ((x ^ (x >> np.uint64(31))) & np.uint64(1)).astype(float)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * width).astype(np.int32)), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def save(path: str, **arrays: np.ndarray) -> None:
    files, name = fs.FileSystem.from_uri(path)
    files.create_dir(name.rsplit("/", 1)[0])
    held, own = io.BytesIO(), f"{name}-{uuid.uuid4().hex}"
    np.savez(held, **arrays)
    with files.open_output_stream(own) as out:
        out.write(held.getbuffer())
    files.move(own, name)  # of two attempts of a task each writes a whole file


def load(path: str) -> dict[str, np.ndarray]:
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_stream(name) as file, np.load(io.BytesIO(file.read())) as held:
        return {k: held[k] for k in held.files}


def uri_of(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def _sorted(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Starts of the rows, columns in order and values; a column that comes twice in a row is summed up."""
    t, w = (batch.column(c).flatten().to_numpy() for c in (1, 2))
    row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
    order = np.lexsort((t, row))
    row, t, w = row[order], t[order], w[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (t[1:] != t[:-1]))) if len(t) else np.empty(0, dtype=np.int64)
    w = np.add.reduceat(w, first) if len(first) else w
    return {"start": np.searchsorted(row[first], np.arange(batch.num_rows + 1)), "t": t[first], "w": w}


class Parts:
    """Rows in parts below a folder: part ``p`` has a file in ``rows`` and one in the folder of every block."""

    def __init__(self, rows: DataFrame):
        self.spark, self.folder = rows.sparkSession, uri_of(fresh_path(rows.sparkSession, "ranges-parts"))
        folder = f"{self.folder}/rows"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, PART):
                    some, name = batch.slice(at, PART), uuid.uuid4().hex  # what a failed attempt wrote is not named to the driver
                    save(f"{folder}/{name}.npz", ids=some.column(0).to_numpy(), d=some.column(3).to_numpy(), **_sorted(some))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([some.num_rows])], names=["name", "n"])

        d = F.col("d").cast("double") if "d" in rows.columns else F.lit(0.0)
        cast = rows.select("doc_id", F.col("t").cast("array<int>").alias("t"), F.col("w").cast("array<double>").alias("w"), d.alias("d"))
        made = sorted(tuple(r) for r in cast.mapInArrow(run, "name string, n bigint").collect())  # a row per part
        self.names, self.number = [name for name, _ in made], sum(n for _, n in made)
        self.tasks = max(1, min(len(made), self.spark.sparkContext.defaultParallelism), math.ceil(len(made) / HELD))

    def each(self, run: Callable[[list[str], int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Of every task what ``run`` yields for its parts and its number."""
        names, tasks = self.names, self.tasks

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    yield from run(names[i::tasks], i)

        return self.spark.range(0, tasks, 1, tasks).mapInArrow(task, schema)

    def summed(self, run: Callable[[list[str], int], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of the small matrices of all tasks."""
        found = self.each(lambda names, i: iter([pa.RecordBatch.from_arrays([pa.array([run(names, i).tobytes()], pa.binary())], names=["m"])]), "m binary")
        total = np.zeros(shape)
        for r in found.toLocalIterator() if self.tasks * total.nbytes > 1 << 27 else found.collect():
            total += np.frombuffer(bytes(r["m"])).reshape(shape)
        return total

    def discard(self, *blocks: str) -> None:
        for block in blocks:
            discard(self.spark, f"{self.folder}/{block}")


@dataclass
class Growth:
    """How a block follows from a product: what of the blocks before it is taken off, and what makes it orthonormal."""

    c: np.ndarray
    inverse: np.ndarray
    r: np.ndarray

    def __call__(self, blocks: np.ndarray, product: np.ndarray) -> np.ndarray:
        return (product - blocks @ self.c) @ self.inverse


def _growth(whole: np.ndarray, total: int, least: float) -> Growth:
    """From the inner products of all blocks and of the product with the product. Directions it hardly has are dropped."""
    c, q = whole[:total], whole[total:]
    rest = q - c.T @ c
    values, vectors = np.linalg.eigh((rest + rest.T) / 2)
    good = values > max(LOST * max(float(np.linalg.eigvalsh(q)[-1]), 1e-300), least)
    root = np.sqrt(values[good])
    return Growth(c, vectors[:, good] / root, (vectors[:, good] * root).T)


def _blocks(folder: str, blocks: list[str], name: str, rows: int) -> np.ndarray:
    return np.hstack([np.empty((rows, 0)), *(load(f"{folder}/{b}/{name}.npz")["x"] for b in blocks)])


def _products(parts: Parts, blocks: list[str], total: int, last: str, width: int) -> np.ndarray:
    """Inner products of all blocks, and of the last one, with the last one."""
    folder = parts.folder

    def run(names: list[str], i: int) -> np.ndarray:
        out = np.zeros((total + width, width))
        for name in names:
            x = load(f"{folder}/{last}/{name}.npz")["x"]
            out[:total] += _blocks(folder, blocks, name, len(x)).T @ x
            out[total:] += x.T @ x
        return out

    return parts.summed(run, (total + width, width))


def _begin(parts: Parts, blocks: list[str], total: int, width: int, draw: int, block: str) -> np.ndarray:
    """A block of random vectors, with its inner products."""
    folder = parts.folder

    def run(names: list[str], i: int) -> np.ndarray:
        out = np.zeros((total + width, width))
        for name in names:
            x = _start(load(f"{folder}/rows/{name}.npz")["ids"], width, draw)
            save(f"{folder}/{block}/{name}.npz", x=x)
            out[:total] += _blocks(folder, blocks, name, len(x)).T @ x
            out[total:] += x.T @ x
        return out

    return parts.summed(run, (total + width, width))


def _orthogonal(parts: Parts, blocks: list[str], grow: Growth, last: str, block: str) -> np.ndarray:
    """The block that ``grow`` makes of the last one, with its inner products."""
    folder, (total, width) = parts.folder, (len(grow.c), grow.inverse.shape[1])

    def run(names: list[str], i: int) -> np.ndarray:
        out = np.zeros((total + width, width))
        for name in names:
            x = load(f"{folder}/{last}/{name}.npz")["x"]
            before = _blocks(folder, blocks, name, len(x))
            x = grow(before, x)
            save(f"{folder}/{block}/{name}.npz", x=x)
            out[:total] += before.T @ x
            out[total:] += x.T @ x
        return out

    return parts.summed(run, (total + width, width))


def _settle(parts: Parts, blocks: list[str], grow: Growth, last: str, block: str, cut: np.ndarray | None, kept: str, columns: int, most: int) -> None:
    """The last block made orthogonal again, the blocks before it cut to the vectors of ``cut``, and the tasks' shares of X'Y in ranges of ``most`` columns."""
    folder, width = parts.folder, grow.inverse.shape[1]

    def run(names: list[str], i: int) -> Iterator[pa.RecordBatch]:
        for name in names:
            x = load(f"{folder}/{last}/{name}.npz")["x"]
            before = _blocks(folder, blocks, name, len(x))
            save(f"{folder}/{block}/{name}.npz", x=grow(before, x))
            if cut is not None:
                save(f"{folder}/{kept}/{name}.npz", x=before @ cut)
        for first in range(0, columns, most):
            total = np.zeros((min(most, columns - first), width))
            for name in names:
                rows, y = load(f"{folder}/rows/{name}.npz"), load(f"{folder}/{block}/{name}.npz")["x"]
                start, t, w = _inside(rows, first, len(total))
                for j in range(len(y)):
                    some = slice(start[j], start[j + 1])
                    total[t[some]] += w[some, None] * y[j]  # a column is once in a row
            there = np.flatnonzero(total.any(axis=1))
            save(f"{folder}/shares/{first}-{i}.npz", t=there, x=total[there])
        yield pa.RecordBatch.from_arrays([pa.array([i])], names=["i"])

    parts.each(run, "i bigint").collect()


def _inside(rows: dict[str, np.ndarray], first: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, columns and values of the rows in a range of columns."""
    start, t, w = rows["start"], rows["t"], rows["w"]
    inside = (t >= first) & (t < first + number)
    if inside.all():
        return start, t - first, w
    return np.append(0, np.cumsum(inside))[start], t[inside] - first, w[inside]


def _sum(parts: Parts, columns: int, most: int) -> None:
    """The tasks' shares of X'Y summed up, a file per range."""
    folder, tasks = parts.folder, parts.tasks
    firsts = list(range(0, columns, most))

    def run(names: list[str], i: int) -> Iterator[pa.RecordBatch]:
        for first in firsts[i::tasks]:
            shares = (load(f"{folder}/shares/{first}-{k}.npz") for k in range(tasks))
            total = None
            for share in shares:
                if total is None:
                    total = np.zeros((min(most, columns - first), share["x"].shape[1]))
                total[share["t"]] += share["x"]
            save(f"{folder}/sums/{first}.npz", x=total)
        yield pa.RecordBatch.from_arrays([pa.array([i])], names=["i"])

    parts.each(run, "i bigint").collect()


def _advance(parts: Parts, blocks: list[str], total: int, width: int, block: str, columns: int, most: int) -> np.ndarray:
    """The product X X'Y of the last of the blocks, with its inner products."""
    folder, last = parts.folder, blocks[-1]

    def run(names: list[str], i: int) -> np.ndarray:
        held = [load(f"{folder}/rows/{name}.npz")["d"][:, None] * load(f"{folder}/{last}/{name}.npz")["x"] for name in names]
        for first in range(0, columns, most):
            sums = load(f"{folder}/sums/{first}.npz")["x"]
            for name, x in zip(names, held):
                start, t, w = _inside(load(f"{folder}/rows/{name}.npz"), first, len(sums))
                for j in np.flatnonzero(start[1:] > start[:-1]):
                    some = slice(start[j], start[j + 1])
                    x[j] += w[some] @ sums[t[some]]
        out = np.zeros((total + width, width))
        for name, x in zip(names, held):
            save(f"{folder}/{block}/{name}.npz", x=x)
            out[:total] += _blocks(folder, blocks, name, len(x)).T @ x
            out[total:] += x.T @ x
        return out

    return parts.summed(run, (total + width, width))


def _vectors(parts: Parts, blocks: list[str], found: np.ndarray) -> DataFrame:
    folder = parts.folder

    def run(names: list[str], i: int) -> Iterator[pa.RecordBatch]:
        for name in names:
            ids = load(f"{folder}/rows/{name}.npz")["ids"]
            yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(_blocks(folder, blocks, name, len(ids)) @ found)], names=["doc_id", "v"])

    return durable(parts.each(run, "doc_id bigint, v array<double>"), "singular-vectors")


@dataclass
class Decomposition:
    """``vectors(doc_id, v)`` are the rows of the left singular vectors, ``sigma`` the singular values, descending."""

    vectors: DataFrame
    sigma: list[float]
    residual: float


def decompose(rows: DataFrame, columns: int, k: int) -> Decomposition:
    """The k largest singular values and vectors of ``rows(doc_id, t, w)``, or with ``d``, with column numbers below ``columns``."""
    parts = Parts(rows)
    number = parts.number
    if not number:
        return Decomposition(rows.sparkSession.createDataFrame([], "doc_id bigint, v array<double>"), [], 0.0)
    k = min(k, number)
    width = min(number, max(8, math.ceil(BLOCK * k)))
    keep = k + width // 2
    largest = max(math.ceil(LARGEST * k), keep + 2 * width)
    blocks: list[str] = []
    total = step = dropped = 0
    fresh, before = -1, np.zeros(k)
    image, theta, z, off = np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), 0.0
    whole, cut = _begin(parts, blocks, 0, width, 0, "x0"), None
    while True:
        # the product is made orthogonal to what is kept of the blocks: x = K c + y r with a second time y = K c' + z r'
        into = np.eye(total) if cut is None else cut
        least = (1e-12 * theta.max(initial=0.0)) ** 2
        first = _growth(np.vstack([into.T @ whole[:total], whole[total:]]), into.shape[1], least)
        second = first
        if first.inverse.shape[1]:
            again = _orthogonal(parts, blocks, Growth(into @ first.c, first.inverse, first.r), f"x{step}", f"y{step}")
            second = _growth(np.vstack([into.T @ again[:total], again[total:]]), into.shape[1], 0.0)
        size = second.inverse.shape[1] if first.inverse.shape[1] else 0
        c, r = (first.c + second.c @ first.r, second.r @ first.r) if size else (first.c, np.zeros((0, whole.shape[1])))
        if cut is None:
            image = np.vstack([image, np.zeros((size, image.shape[1]))])
            if total:  # X X' times the last block is known now
                image = np.hstack([image, np.vstack([c, r])])
            small = image[:total]
            theta, z = np.linalg.eigh((small + small.T) / 2) if total else (np.zeros(0), np.zeros((0, 0)))
            theta, z = theta[::-1], z[:, ::-1]
            highest = max(float(theta.max(initial=0.0)), 1e-300)
            off = np.linalg.norm(image[total:] @ z[:, :k], axis=0).max(initial=0.0) / highest
            ended = step >= STEPS or total >= number or (total > 0 and size == 0)
            if ended or (total >= k and off <= TOLERANCE):
                now = np.append(theta[:k], np.zeros(max(0, k - total)))
                same = fresh >= 0 and np.abs(now - before).max(initial=0.0) <= TOLERANCE * highest
                if step >= STEPS or total >= number or (same and (size == 0 or fresh >= CERTAIN)):
                    break
                if size == 0 or fresh < 0 or not same and fresh >= CERTAIN:  # once more from random vectors
                    fresh, before, dropped = 0, now, max(dropped, off)
                    cut = z[:, : keep if size == 0 else k]
                    parts.discard(f"x{step}", f"y{step}")
                    step += 1
                    whole = _begin(parts, blocks, total, min(width, number - cut.shape[1]), step * width, f"x{step}")
                    continue
            if total + size > largest:
                cut = z[:, :keep]
                image = np.vstack([np.diag(theta[:keep]), image[total:] @ cut])
        else:
            if size == 0:
                break
            image = np.vstack([np.diag(theta[: cut.shape[1]]), np.zeros((size, cut.shape[1]))])
        after, kept = f"b{step}", f"k{step}"
        most = max(1, CELLS // size)
        _settle(parts, blocks, Growth(into @ second.c, second.inverse, second.r), f"y{step}", after, cut, kept, columns, most)
        parts.discard(f"x{step}", f"y{step}")
        if cut is not None:
            parts.discard(*blocks)
            blocks, total, cut = [kept], cut.shape[1], None
        blocks.append(after)
        total += size
        _sum(parts, columns, most)
        step, fresh = step + 1, fresh + 1 if fresh >= 0 else fresh
        whole = _advance(parts, blocks, total, size, f"x{step}", columns, most)
        parts.discard("shares", "sums")
    sigma = np.sqrt(np.maximum(theta[:k], 0.0))
    # eigenvalues are exact to about 1e-12 of the largest, singular values to the root of it
    good = sigma > NOTHING * max(float(sigma.max(initial=0.0)), 1e-300)
    vectors = _vectors(parts, blocks, z[:, :k][:, good])
    discard(parts.spark, parts.folder)
    return Decomposition(vectors, [float(s) for s in sigma[good]], float(max(off, dropped)))
