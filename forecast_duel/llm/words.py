"""Words of UTF-8 buffers as 64-bit numbers, found and hashed without a Python step for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
PLACE_VALUE = mixed(BYTE_VALUE[None, :] + np.arange(64, dtype=np.uint64)[:, None] * _STEP)
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words between white space: all but space and tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of letters and digits; a byte from 128 on belongs to a character outside ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[128:] = True
ALPHANUMERIC[ord("0") : ord("9") + 1] = True
ALPHANUMERIC[ord("a") : ord("z") + 1] = True


def _parted() -> np.ndarray:
    """Borders between ASCII letters, digits and other signs; an apostrophe stays with the letters after it."""
    kind = np.zeros(256, np.uint8)  # 0: outside ASCII, never parted from what stands beside it
    kind[33:127] = 3
    kind[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
    kind[list(b"0123456789")] = 2
    a, b = kind[:, None], kind[None, :]
    cut = (a > 0) & (b > 0) & (a != b)
    cut[ord("'"), kind == 1] = False
    return cut.ravel()


PARTED = _parted()


@dataclass(frozen=True)
class Words:
    """Words of several texts one after another; text i has the words ``first[i]`` to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True, part: np.ndarray | None = None) -> Words:
    """The maximal runs of ``inside`` bytes of each text with a 64-bit code of their (lower-cased) bytes.

    ``part`` marks pairs of bytes, the first times 256 plus the second, between which a run is parted.
    """
    if lower:
        data = LOWER[data]
    is_in = inside[data]
    begins = is_in.copy()
    begins[1:] &= ~is_in[:-1]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:]
    if part is not None:
        cut = part[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        begins[1:] |= cut & is_in[1:]
        ends[:-1] |= cut & is_in[:-1]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] |= is_in[borders]
    ends[borders - 1] |= is_in[borders - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    # A word's code is a sum of one number for each byte and place in the word; bytes outside of words count 0.
    size = end - start
    starts = np.repeat(np.r_[np.int32(0), start.astype(np.int32)], np.diff(np.r_[0, start, len(data)]))
    place = np.arange(len(data), dtype=np.int32) - starts
    numbers = np.where(inside[None, :], PLACE_VALUE, np.uint64(0)).ravel()
    value = numbers[((place & 63) << 8) | data]
    if size.max() > 64:
        value *= (2 * (place >> 6) + 1).astype(np.uint64)
    total = np.add.reduceat(value, start)
    code = mixed(total + size.astype(np.uint64) * _M1)
    return Words(start, end, code, np.searchsorted(start, offsets))
