"""Vectorised primitives over Arrow string columns, shared by the text operators.

Everything here works on the raw UTF-8 buffer of a column with numpy, so no
Python object is made per word.  Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a Python worker (one longer text is handled alone).
SLICE_BYTES = 1 << 19

#: Odd multipliers of the polynomial hashes; two independent ones give 128-bit identities.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def byte_class(keep: str) -> np.ndarray:
    """Membership table of 256 entries for a named set of bytes.

    ``visible``: all bytes but ASCII white space; ``alnum``: digits, ASCII letters
    and every byte of a non-ASCII character.
    """
    table = np.zeros(256, dtype=bool)
    if keep == "visible":
        table[:] = True
        table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    elif keep == "alnum":
        table[0x30:0x3A] = True
        table[0x41:0x5B] = True
        table[0x61:0x7B] = True
        table[0x80:] = True
    else:
        raise ValueError(f"unknown byte class {keep!r}")
    return table


#: Maps A-Z to a-z and leaves all other bytes alone.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32

VISIBLE = byte_class("visible")
ALNUM = byte_class("alnum")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; offsets has one more entry than rows."""
    if pa.types.is_null(column.type):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    if not len(column) or raw_offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(raw_offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers, and executors' memory is shared with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``most`` bytes of text, whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    release()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2**64, at least ``size`` of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < size:
        size = max(size, SLICE_BYTES + 2)
        base = _MULTIPLIERS[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = (out[0], out[1])
        if size <= 4 * SLICE_BYTES:
            _powers[which] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(which: int, lower: bool) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(0x1000 * (which + 1)))
    return values[ASCII_LOWER] if lower else values


_BYTE_VALUES = {(w, lo): _byte_values(w, lo) for w in (0, 1) for lo in (False, True)}


class RollingHash:
    """Hashes of any sub-array in constant time, equal for equal content wherever it stands."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.power, self.inverse = _power_tables(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.power[: len(values)], out=self.sums[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray, which: int = 0, lower: bool = False) -> RollingHash:
        return cls(_BYTE_VALUES[which, lower][data], which)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of ``width`` values, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + np.uint64(width))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of flagged bytes, cut at the borders of texts."""
    n = len(inside)
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        begin, stop = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
        opens[begin] = inside[begin]
        closes[stop] = inside[stop]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


class Words:
    """The words (maximal runs of a byte class) of each text in a buffer; never across texts.

    starts, ends: byte places; row: the text of each word; first: index of each
    text's first word, with one more entry than texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        rows = len(offsets) - 1
        self.data, self.offsets = data, offsets
        self.starts, self.ends = runs(table[data], offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        return RollingHash.of_bytes(self.data, which, lower).spans(self.starts, self.ends)

    def windows(self, word_hashes: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each window of ``width`` consecutive words of one text."""
        if len(self) < width:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        whole = RollingHash(word_hashes, which).windows(width)
        at = np.arange(len(whole))
        ok = at + width <= self.first[1:][self.row[: len(whole)]]
        return at[ok], whole[ok]


def covered(places: np.ndarray, lengths: np.ndarray | int, size: int) -> np.ndarray:
    """Which of ``size`` cells lie in an interval [place, place + length)."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def per_row_sum(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of flags in each slice [first[i], first[i+1])."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
