"""Counts by 64-bit code that one task gathers over its texts, with the bytes behind each code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from forecast_duel.llm.words import mixed


def name_codes(names: pa.Array) -> tuple[np.ndarray, list]:
    """Number of each row's name among the batch's different ones, and those names; null is a name."""
    coded = names.dictionary_encode()
    index = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    return index, [*coded.dictionary.to_pylist(), None]


def salt_of(*names: str) -> np.uint64:
    """A 64-bit number for texts that belong together."""
    return np.uint64(xxhash.xxh64_intdigest("\x00".join(names).encode()))


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the pieces one after another, and where each begins (one entry more than pieces)."""
    to = np.r_[0, np.cumsum(size)]
    where = np.arange(to[-1]) + np.repeat(start - to[:-1], size)
    return data[where], to


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns that are sorted together."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Tally:
    """Sums of counters by (group, code); ``groups`` are small numbers of the caller, the bytes are those of the first occurrence."""

    def __init__(self, n_counters: int):
        self.n_counters = n_counters
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, group: np.ndarray, code: np.ndarray, counters: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> None:
        if len(code):
            self.parts.append((group, code, counters, data, offsets))
            self.rows += len(code)

    def merge(self) -> None:
        """One part with every (group, code) once."""
        if len(self.parts) < 2:
            return
        group = np.concatenate([p[0] for p in self.parts])
        code = np.concatenate([p[1] for p in self.parts])
        data = np.concatenate([p[3] for p in self.parts])
        bases = np.cumsum([0, *(len(p[3]) for p in self.parts)])
        start = np.concatenate([p[4][:-1] + base for p, base in zip(self.parts, bases)])
        size = np.concatenate([np.diff(p[4]) for p in self.parts])
        order = np.lexsort((group, code))
        first = run_starts(code[order], group[order])
        counters = [np.add.reduceat(np.concatenate([p[2][i] for p in self.parts])[order], first) for i in range(self.n_counters)]
        chosen = order[first]
        data, offsets = gather(data, start[chosen], size[chosen])
        self.parts = [(group[chosen], code[chosen], counters, data, offsets)]
        self.rows = len(chosen)

    def take_part(self) -> tuple | None:
        """(group, code, counters, bytes, offsets) of all that was added; the tally is empty afterwards."""
        self.merge()
        part = self.parts[0] if self.parts else None
        self.parts, self.rows = [], 0
        return part

    def take(self) -> tuple[np.ndarray, list[np.ndarray], pa.Array] | None:
        """(group, counters, texts) of all that was added, once for each (group, code); the tally is empty afterwards."""
        part = self.take_part()
        if part is None:
            return None
        group, _, counters, data, offsets = part
        texts = pa.LargeStringArray.from_buffers(len(group), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        return group, counters, texts.cast(pa.string())


def salted(code: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Codes that differ between groups."""
    return mixed(code ^ salt)
