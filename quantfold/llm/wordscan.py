"""Words of Arrow text columns as numpy arrays of byte ranges and 64-bit hashes.

A word is a run of bytes that are not separators (all separators are ASCII, so runs
of UTF-8 bytes and runs of characters are the same). A-Z are lowered. Hashes add a
number per (byte, place in the word) and are mixed, so they do not depend on the
process; two different words or sequences share a hash with a chance near 2**-64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but digits and letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Spaces, words (digits, letters, beyond ASCII) and runs of other characters.
PIECES = np.where(SPACES, 0, np.where(NOT_ALNUM, 2, 1)).astype(np.uint8)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    start = np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start) | np.uint64(1)


_BYTE = numbers(256, 1)
_STEP = numbers(64, 3)
_PLACE = numbers(256, 2)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = numbers(2 * n, 2)
    return _PLACE


@dataclass
class Words:
    data: np.ndarray  # bytes of all rows, lowered
    start: np.ndarray  # byte range of each word
    end: np.ndarray
    first: np.ndarray  # row r has the words first[r] to first[r + 1]
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def of(self, row: int) -> slice:
        return slice(self.first[row], self.first[row + 1])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes (a longer text is a range of its own)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def scan(texts: pa.Array, separators: np.ndarray = SPACES, fold: bool = True, kinds: np.ndarray | None = None) -> Words:
    """``kinds``: instead of ``separators``, a number for each byte; words are runs of one kind, 0 separates."""
    raw, at = _bytes_of(texts)
    data = (_FOLD if fold else _SAME)[raw]
    kind = ~separators[data] if kinds is None else kinds[data]
    inside = kind if kinds is None else kind > 0
    change = kind[1:] != kind[:-1]
    full = at[:-1] < at[1:]
    opens = inside.copy()
    opens[1:] &= change
    head = at[:-1][full]
    opens[head] = inside[head]
    closes = inside.copy()
    closes[:-1] &= change
    tail = at[1:][full] - 1
    closes[tail] = inside[tail]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, at)
    if not len(start):
        return Words(data, start, end, first, np.zeros(0, np.uint64))
    length = end - start
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    value = _BYTE[data[inside]] * _places(int(length.max()))[place]
    return Words(data, start, end, first, mix(np.add.reduceat(value, begin) + length.astype(np.uint64)))


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` words, row by row, and their offsets; a row of fewer words, but not none, is one window."""
    n = np.diff(words.first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    offset = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(int(offset[-1]), np.uint64)
    h = words.hash
    if len(h) >= width:
        total = h[: len(h) - width + 1] * _STEP[0]
        for k in range(1, width):
            total += h[k : len(h) - width + 1 + k] * _STEP[k]
        total = mix(total + np.uint64(width))
        whole = n >= width
        lengths = np.where(whole, count, 0)
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        source = np.arange(int(lengths.sum())) + np.repeat(words.first[:-1] - begins, lengths)
        target = np.arange(int(lengths.sum())) + np.repeat(offset[:-1] - begins, lengths)
        out[target] = total[source]
    for r in np.flatnonzero((n > 0) & (n < width)):
        part = h[words.of(r)]
        out[offset[r]] = mix((part * _STEP[: len(part)]).sum(keepdims=True) + np.uint64(len(part)))[0]
    return out, offset


def least_in_windows(words: Words, width: int, values: np.ndarray) -> np.ndarray:
    """The least of the words' ``values`` in each window of ``windows``, in the same order."""
    n = np.diff(words.first)
    whole = n >= width
    count = np.where(whole, n - width + 1, (n > 0).astype(n.dtype))
    offset = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(int(offset[-1]), values.dtype)
    if len(values) >= width:
        least = values[: len(values) - width + 1].copy()
        for k in range(1, width):
            np.minimum(least, values[k : len(values) - width + 1 + k], out=least)
        lengths = np.where(whole, count, 0)
        begins = np.cumsum(lengths) - lengths
        step = np.arange(int(lengths.sum()))
        out[step + np.repeat(offset[:-1] - begins, lengths)] = least[step + np.repeat(words.first[:-1] - begins, lengths)]
    for r in np.flatnonzero((n > 0) & ~whole):
        out[offset[r]] = values[words.of(r)].min()
    return out


def pack(array: np.ndarray, parts: int) -> pa.RecordBatch:
    """An array as ``parts`` rows (part, values), to be joined by ``merged``."""
    pieces = np.array_split(array, parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(parts), pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(p).tobytes(), 1) for p in pieces], pa.binary())],
        names=["part", "values"],
    )


PACKED = "part int, values binary"


def merged(partials, dtype, parts: int, join=np.add) -> np.ndarray:
    """Packed arrays added up (or joined by another ufunc); empty if there are none.

    Each task streams its parts, and the driver gets one array of the fixed size.
    """

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, values in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.frombuffer(zlib.decompress(values.as_py()), dtype=dtype)
                totals[part] = join(totals[part], got) if part in totals else got
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in totals.values()], pa.binary())], names=["part", "values"]
            )

    rows = partials.repartition(parts, "part").mapInArrow(add, PACKED).collect()
    found = {r["part"]: np.frombuffer(zlib.decompress(r["values"]), dtype=dtype) for r in rows}
    return np.concatenate([found[p] for p in range(parts)]) if len(found) == parts else np.zeros(0, dtype)
