"""A counting sketch of fixed size for 64-bit codes: an upper bound of how often each code occurs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counters of a sketch: its size does not depend on the data.
BITS = 20
SLICE = 1 << 14
N_SLICES = (1 << BITS) // SLICE


def places(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - BITS)).astype(np.int64)


def add(sketch: np.ndarray, code: np.ndarray) -> None:
    sketch += np.bincount(places(code), minlength=len(sketch)).astype(sketch.dtype)


def empty() -> np.ndarray:
    return np.zeros(1 << BITS, np.int32)


def as_slices(sketch: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Number and counters of each slice of a task's sketch."""
    return (pa.array(np.arange(N_SLICES, dtype=np.int32)),
            pa.array([x.tobytes() for x in sketch.reshape(N_SLICES, SLICE)], pa.binary()))


def total(slices: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches (slice, counts); the executors add them slice by slice."""
    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                own = sums.setdefault(s, np.zeros(SLICE, np.int64))
                own += np.frombuffer(counts.as_py(), np.int32)
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros((N_SLICES, SLICE), np.int64)
    for row in slices.select("slice", "counts").repartition("slice").mapInArrow(summed, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


#: Bits of a membership bitmap, 8 MB whatever it holds.
MEMBER_BITS = 26
MEMBER_SLICE = 1 << 16


def members(codes: DataFrame, column: str) -> np.ndarray:
    """Packed bits of the places of all codes (long): a code whose bit is not set is not among them."""
    def run(batches):
        bits = np.zeros(1 << (MEMBER_BITS - 3), np.uint8)
        for batch in batches:
            place = batch.column(column).to_numpy().view(np.uint64) >> np.uint64(64 - MEMBER_BITS)
            np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        slices = bits.reshape(-1, MEMBER_SLICE)
        used = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(used, pa.int32()), "bits": pa.array([slices[i].tobytes() for i in used], pa.binary())})

    def together(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, bits in zip(batch.column("slice").to_pylist(), batch.column("bits")):
                own = sums.setdefault(s, np.zeros(MEMBER_SLICE, np.uint8))
                own |= np.frombuffer(bits.as_py(), np.uint8)
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(list(sums), pa.int32()), "bits": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros((1 << (MEMBER_BITS - 3)) // MEMBER_SLICE * MEMBER_SLICE, np.uint8).reshape(-1, MEMBER_SLICE)
    parts = codes.select(column).mapInArrow(run, "slice int, bits binary").repartition("slice").mapInArrow(together, "slice int, bits binary")
    for row in parts.toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def may_hold(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    place = code.view(np.uint64) >> np.uint64(64 - MEMBER_BITS)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
