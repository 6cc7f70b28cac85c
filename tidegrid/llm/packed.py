"""Whole numbers as compressed byte planes, and sums by 64-bit key that go back to every block that asked.

A block is a bounded run of rows handled by one task.  It sends each of its distinct keys once, with its own value, in
packed rows of one key range (bucket); a bucket adds the values of all blocks and sends each block the totals of its
keys, in the order in which they came.  Keys are spread by their upper bits and a block holds a key once, so no key
makes a bucket large, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "block bigint, kind int, bucket int, keys binary, sums binary"
TOTALS = "block bigint, kind int, bucket int, known bigint, amount bigint, totals binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers: their count, then the byte planes in use, zstandard."""
    import zstandard

    values = np.ascontiguousarray(values, np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(values).to_bytes(8, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:]), np.uint8).reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending numbers by their steps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_signed(values: np.ndarray) -> bytes:
    """Signed numbers of up to 62 bits: the sign goes to the lowest bit."""
    v = values.astype(np.int64)
    return pack(((v << 1) ^ (v >> 63)).view(np.uint64))


def unpack_signed(data: bytes) -> np.ndarray:
    v = unpack(data)
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes in order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def send(block: int, kind: int, keys: np.ndarray, values: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows of ``ROWS`` for ascending distinct keys; a bucket is the upper ``bits`` of a key."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        yield block, kind, int(bucket[a]), pack_sorted(keys[a:b]), pack_signed(values[a:b])


def add_up(table: pa.Table) -> pa.Table:
    """One bucket: totals of each row's keys; the first row also has the number of distinct keys with a
    positive total and the sum of all values."""
    rows = table.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sums = np.add.reduceat(np.concatenate([unpack_signed(r["sums"]) for r in rows])[order], first)
    totals = np.empty(len(flat), np.int64)
    totals[order] = np.repeat(sums, np.diff(np.append(first, len(flat))))
    ends = np.cumsum([len(k) for k in keys])[:-1]
    once = lambda value: pa.array([int(value)] + [0] * (len(rows) - 1), pa.int64())
    return pa.table(
        {
            "block": pa.array([r["block"] for r in rows], pa.int64()),
            "kind": pa.array([r["kind"] for r in rows], pa.int32()),
            "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "known": once((sums > 0).sum()),
            "amount": once(sums.sum()),
            "totals": pa.array([pack_signed(t) for t in np.split(totals, ends)], pa.binary()),
        }
    )


def totals(sent: DataFrame) -> DataFrame:
    """Totals of all keys sent (``ROWS``), a row of ``TOTALS`` for each row sent."""
    return sent.groupBy("kind", "bucket").applyInArrow(add_up, TOTALS)


def per_block(back: DataFrame, name: str) -> DataFrame:
    """``block, name``: what came back to a block, as an array in order of kind and bucket."""
    parts = F.array_sort(F.collect_list(F.struct("kind", "bucket", "totals")))
    return back.groupBy("block").agg(parts.alias(name))


def of_kind(parts: list[dict] | None, kind: int) -> np.ndarray:
    """The totals of one kind, in ascending order of their keys."""
    found = [unpack_signed(p["totals"]) for p in parts or () if p["kind"] == kind]
    return np.concatenate(found) if found else np.zeros(0, np.int64)
