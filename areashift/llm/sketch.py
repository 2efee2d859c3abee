"""Count-min sketches of fixed width, built per partition and merged by blocks.

A sketch never counts too little. Its width is a parameter that does not follow the data:
on more data it says "maybe repeated" more often, which costs work in the exact step
after it and loses nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from areashift.llm.storage import no_shuffle_left, stored

#: Cells of a row of the sketch as a power of two, rows, and cells of a block likewise.
WIDTH_BITS = 25
DEPTH = 2
BLOCK_BITS = 19
#: Partial sketches that are merged at most.
PARTIALS = 2048
#: Bits of a fingerprint, those of them within a block, and fingerprints packed at once.
PRINT_BITS = 40
PRINT_BLOCK = 30
PRINTS = 1 << 20

SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def cells(keys: np.ndarray, row: int, bits: int = WIDTH_BITS) -> np.ndarray:
    return (mixed(keys ^ np.uint64(SEEDS[row])) >> np.uint64(64 - bits)).astype(np.int64)


def count(table: np.ndarray, keys: np.ndarray) -> None:
    """Add keys to a table of (rows, cells) of counts that stop at 255."""
    for row in range(len(table)):
        found, times = np.unique(cells(keys, row, table.shape[1].bit_length() - 1), return_counts=True)
        table[row, found] = np.minimum(255, table[row, found] + times)


def merged_sketch(
    rows: DataFrame,
    keys_of: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]],
    finish: Callable[[np.ndarray], np.ndarray],
    bits: int = WIDTH_BITS,
    depth: int = DEPTH,
) -> np.ndarray:
    """The sketch of all keys that ``keys_of`` makes of the rows' batches.

    ``finish`` turns the merged counts of a block into what the driver gets of it: (depth,
    cells or fewer) bytes in all, whatever the data holds.
    """
    block = min(bits, BLOCK_BITS)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((depth, 1 << bits), dtype=np.uint8)
        for keys in keys_of(batches):
            count(table, keys)
        for row in range(depth):
            for at in range(0, 1 << bits, 1 << block):
                part = table[row, at : at + (1 << block)]
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([(row << bits) + at], pa.int64()),
                            pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()),
                        ],
                        ["block", "counts"],
                    )

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, current = None, None
        for batch in batches:
            for at, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if at != current:
                    if total is not None:
                        yield ready(current, total)
                    total, current = np.zeros(1 << block, dtype=np.uint16), at
                total += np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
                np.minimum(total, 255, out=total)
        if total is not None:
            yield ready(current, total)

    def ready(at: int, total: np.ndarray) -> pa.RecordBatch:
        blob = zlib.compress(finish(total.astype(np.uint8)).tobytes(), 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([blob], pa.binary())], ["block", "counts"]
        )

    with no_shuffle_left(rows.sparkSession):
        parts = rows.coalesce(PARTIALS).mapInArrow(partial, "block long, counts binary")
        whole = parts.repartition("block").sortWithinPartitions("block").mapInArrow(
            merge, "block long, counts binary"
        )
        blocks = whole.collect()  # one row per block of the fixed width
    empty = finish(np.zeros(1 << block, dtype=np.uint8))
    out = np.tile(empty, depth << (bits - block))
    while blocks:
        at, blob = blocks.pop()
        place = (at >> block) * len(empty)
        out[place : place + len(empty)] = np.frombuffer(zlib.decompress(blob), dtype=empty.dtype)
    return out.reshape(depth, -1)


def repeated_flags(counts: np.ndarray) -> np.ndarray:
    """A bit per cell: counted more than once."""
    return np.packbits(counts > 1)


def present_flags(counts: np.ndarray) -> np.ndarray:
    """A bit per cell: counted at all."""
    return np.packbits(counts > 0)


def flagged(flags: np.ndarray, keys: np.ndarray, bits: int = WIDTH_BITS) -> np.ndarray:
    """Whether each key may be among those flagged, by flags of a merged sketch."""
    out = np.ones(len(keys), dtype=bool)
    for row in range(len(flags)):
        at = cells(keys, row, bits)
        out &= (flags[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """Numbers of ``PRINT_BITS`` bits that stand for keys."""
    return mixed(keys ^ np.uint64(SEEDS[0])) >> np.uint64(64 - PRINT_BITS)


def packed(prints: np.ndarray) -> bytes:
    """Sorted numbers below 2^32 as steps, byte by byte, compressed."""
    steps = np.diff(prints, prepend=np.uint64(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.uint64)


def several_flags(
    rows: DataFrame, keys_of: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]]
) -> np.ndarray:
    """Flags of the fingerprints of all keys that ``keys_of`` makes more than once.

    A sketch that counts every key fills up with keys that occur once. Here all fingerprints
    meet, block by block and packed to about three bytes each, and only those that several
    keys have go into the filter of fixed size.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for keys in keys_of(batches):
            held.append(fingerprints(keys))
            size += len(keys)
            if size >= PRINTS:
                yield blocks_of(np.concatenate(held))
                held, size = [], 0
        if size:
            yield blocks_of(np.concatenate(held))

    def blocks_of(prints: np.ndarray) -> pa.RecordBatch:
        prints.sort()
        twice = np.ones(len(prints), dtype=bool)  # a third one tells nothing more
        twice[2:] = prints[2:] != prints[:-2]
        prints = prints[twice]
        inside = prints & np.uint64((1 << PRINT_BLOCK) - 1)
        block, first = np.unique(prints >> np.uint64(PRINT_BLOCK), return_index=True)
        blobs = [packed(part) for part in np.split(inside, first[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(block.astype(np.int64)), pa.array(blobs, pa.binary())], ["block", "prints"]
        )

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for at, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if at != current and held:
                    yield several(current, held)
                    held = []
                current = at
                held.append(unpacked(blob))
        if held:
            yield several(current, held)

    def several(at: int, held: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.sort(np.concatenate(held))
        found = np.unique(prints[1:][prints[1:] == prints[:-1]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found + (at << PRINT_BLOCK))], ["print"])

    parts = rows.mapInArrow(partial, "block long, prints binary")
    found = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "print long")
    return key_flags(stored(found, "several"), "print", depth=3)


def key_flags(rows: DataFrame, column: str, depth: int = 1) -> np.ndarray:
    """Flags of the keys (64-bit numbers) in a column: a filter of fixed size that lets all of
    them through, and of others the more the more keys there are."""

    def keys_of(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column(0).to_numpy().view(np.uint64)

    return merged_sketch(rows.select(column), keys_of, present_flags, depth=depth)
