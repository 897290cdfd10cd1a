"""Posting codecs: bytes for storage, and their sizes as plain column expressions.

``standard``     eight little-endian bytes per number, no gaps
``vbe``          gaps of the ids in seven-bit groups, most significant first, last byte flagged
``optpfordelta`` gaps in blocks of 128 with a 90th-percentile bit width and patched exceptions

An empty list encodes to the empty list's form in every codec and decodes back.

All lists of a batch are encoded together, as one array of numbers and the places where its lists begin. A long
list may come in parts of whole blocks: the bytes of its parts, one after the other, are the bytes of the list.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS = ("standard", "vbe", "optpfordelta")
BLOCK = 128


def gaps(ids: Sequence[int]) -> np.ndarray:
    """First id, then differences. Unsorted or repeated ids are refused."""
    a = np.asarray(ids, dtype=np.int64)
    d = np.diff(a, prepend=0)
    if len(a) and (a[0] < 0 or (d[1:] <= 0).any()):
        raise ValueError("document ids must be non-negative and strictly ascending")
    return d


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... inside each of consecutive runs."""
    return np.arange(int(sizes.sum())) - np.repeat(_starts(sizes)[:-1], sizes)


# --- variable bytes ---------------------------------------------------------------------------------


def vb_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each number."""
    out = np.ones(len(values), dtype=np.int64)
    for group in range(1, 9):
        out += values >= (1 << (7 * group))
    return out


def vb_write(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers as bytes, and where the bytes of each begin."""
    sizes = vb_sizes(values)
    starts = _starts(sizes)
    out = np.zeros(starts[-1], dtype=np.uint8)
    for group in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > group)
        out[starts[some + 1] - 1 - group] = (values[some] >> (7 * group)) & 127
    out[starts[1:] - 1] |= 128
    return out, starts


def vb_read(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data & 128)
    if not len(ends):
        return np.empty(0, dtype=np.int64)
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends + 1 - starts
    shift = np.repeat(sizes, sizes) - 1 - _within(sizes)
    return np.add.reduceat((data[: ends[-1] + 1] & 127).astype(np.int64) << (7 * shift), starts)


# --- patched frames of reference -------------------------------------------------------------------


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.int64)
    for bit in range(63):
        out += values >= (1 << bit)
    return out


def pfor_write(values: np.ndarray, offsets: np.ndarray, totals: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """Lists as blocks: three header bytes, fixed-width slots, then exception values and their places.

    ``totals`` gives the number in front of each list; a negative one leaves it out, for a further part of a list.
    """
    lengths = np.diff(offsets)
    totals = lengths if totals is None else totals
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    sizes = np.minimum(BLOCK, lengths[owner] - BLOCK * _within(blocks))
    place = (np.repeat(np.arange(len(sizes)), sizes), _within(sizes))
    matrix = np.full((len(sizes), BLOCK), np.iinfo(np.int64).max, dtype=np.int64)
    matrix[place] = values
    at = np.sort(matrix, axis=1)[np.arange(len(sizes)), 9 * (sizes - 1) // 10] if len(sizes) else np.empty(0, dtype=np.int64)
    widths = _bit_lengths(at)
    wide = np.zeros(matrix.shape, dtype=bool)
    wide[place] = values >> widths[place[0]] > 0
    exceptions = wide.sum(axis=1)
    # values of a block's exceptions, then their places
    row, column = np.nonzero(wide)
    order = np.argsort(np.concatenate([2 * row, 2 * row + 1]), kind="stable")
    patches, starts = vb_write(np.concatenate([matrix[row, column], column])[order])
    cuts = starts[2 * _starts(exceptions)]
    slots: list[bytes] = [b""] * len(sizes)
    matrix[wide] = 0
    for width in np.unique(widths):
        some = np.flatnonzero(widths == width)
        inside = np.where(np.arange(BLOCK) < sizes[some, None], matrix[some], 0)
        bits = (inside[:, :, None] >> np.arange(width - 1, -1, -1)) & 1
        packed = np.packbits(bits.reshape(len(some), -1).astype(np.uint8), axis=1)
        for i, line in zip(some, packed):
            slots[i] = line[: (sizes[i] * width + 7) // 8].tobytes()
    raw = patches.tobytes()
    body = [
        (3 + len(slot) + b - a).to_bytes(4, "big") + bytes((w, n, e)) + slot + raw[a:b]
        for slot, a, b, w, n, e in zip(slots, cuts[:-1].tolist(), cuts[1:].tolist(), widths.tolist(), sizes.tolist(), exceptions.tolist())
    ]
    first = _starts(blocks)
    out = [(b"" if t < 0 else int(t).to_bytes(4, "big")) + b"".join(body[a:b]) for t, a, b in zip(totals, first[:-1], first[1:])]
    return b"".join(out), _starts(np.array([len(x) for x in out], dtype=np.int64))


def pfor_read(data: bytes, whole: bool = True) -> np.ndarray:
    """Numbers of a list, or of a further part of one, which has no number in front."""
    at, out = 4 if whole else 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        width, n, exceptions = data[at + 4 : at + 7]
        end = at + 4 + size
        slots = at + 7 + (n * width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, slots - at - 7, at + 7))[: n * width].reshape(n, width)
        values = bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        if exceptions:
            tail = vb_read(np.frombuffer(data, np.uint8, end - slots, slots))
            values[tail[exceptions:]] = tail[:exceptions]
        out.append(values)
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


# --- lists ------------------------------------------------------------------------------------------


def encode_batch(values: np.ndarray, offsets: np.ndarray, codec: str, totals: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """Bytes of many lists of numbers or gaps, and where each list begins in them."""
    if codec == "standard":
        return values.astype("<u8").tobytes(), 8 * np.asarray(offsets, dtype=np.int64)
    if codec == "vbe":
        data, starts = vb_write(values)
        return data.tobytes(), starts[offsets]
    if codec == "optpfordelta":
        return pfor_write(values, np.asarray(offsets), totals)
    raise ValueError(f"unknown codec {codec!r}")


def decode_one(data: bytes, codec: str, whole: bool = True) -> np.ndarray:
    """Numbers or gaps of one list or part."""
    if codec == "standard":
        return np.frombuffer(data, dtype="<u8").astype(np.int64)
    if codec == "vbe":
        return vb_read(np.frombuffer(data, dtype=np.uint8))
    if codec == "optpfordelta":
        return pfor_read(data, whole)
    raise ValueError(f"unknown codec {codec!r}")


def encode(numbers: Sequence[int], codec: str, ids: bool) -> bytes:
    """Bytes of a list; ``ids`` says whether it holds ascending document ids (gaps) or frequencies."""
    values = gaps(numbers) if ids and codec != "standard" else np.asarray(numbers, dtype=np.int64)
    return encode_batch(values, np.array([0, len(values)]), codec)[0]


def decode(data: bytes, codec: str, ids: bool) -> list[int]:
    values = decode_one(data, codec)
    return (np.cumsum(values) if ids and codec != "standard" else values).tolist()


def vb_size(n: Column) -> Column:
    """Bytes of one number in the variable-byte code."""
    size = F.lit(1)
    for group in range(1, 9):
        size = size + (n >= F.lit(1 << (7 * group))).cast("int")
    return size


def bit_width(n: Column) -> Column:
    """Bits of a non-negative number, 0 for 0."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.length(F.bin(n)))
