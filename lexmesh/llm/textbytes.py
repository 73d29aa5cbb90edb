"""Words, lines and hashes of Arrow batches of texts, in whole-batch numpy steps.

Texts are handled as UTF-8 bytes. A word is a run of bytes other than the six ASCII
blanks, so words never split a character. Any stretch of bytes gets a 64-bit polynomial
hash from prefix sums (modulo 2**64, over random byte values), then a finishing mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes (a longer text is one slice), and so many rows at most.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 60_000
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n + n // 8, SLICE_BYTES // 4)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finishing mix of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """The bytes of some texts: ``data`` and the ``offsets`` of each text in it."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(column)
        self._sums: dict[bool, np.ndarray] = {}

    def opens(self) -> np.ndarray:
        """Marks the first byte of each text that has one."""
        flags = np.zeros(len(self.data) + 1, bool)
        flags[self.offsets] = True
        return flags

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of each word."""
        inside = ~BLANK[self.data]
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3
        opens = self.opens()
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | opens[1:-1]
        last[:-1] &= ~inside[1:] | opens[1:-1]
        starts = np.flatnonzero(first)
        return self.text_of(starts), starts, np.flatnonzero(last) + 1

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hashes of stretches of bytes; ``lower`` takes A-Z as a-z."""
        power, inverse = powers(len(self.data) + 1)
        if lower not in self._sums:
            values = _VALUES[_LOWER] if lower else _VALUES
            sums = np.zeros(len(self.data) + 1, np.uint64)
            terms = values[self.data]
            terms *= power[: len(self.data)]
            np.cumsum(terms, out=sums[1:])
            self._sums[lower] = sums
        sums = self._sums[lower]
        return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each text has."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def slice(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def runs(hashes: np.ndarray, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of k words within one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total, power, _ = np.zeros(n, np.uint64), *powers(k)
    for i in range(k):
        total += hashes[i : i + n] * power[i]
    first = np.flatnonzero(texts[:n] == texts[k - 1 : k - 1 + n])
    return mixed(total[first]), first


def shingles(texts: Texts, k: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its lower-cased k-word shingles.

    Fewer words than k count as one shingle; a text without words has none.
    """
    text, starts, ends = texts.words()
    words = texts.hashes(starts, ends, True)
    found, first = runs(words, text, k)
    bounds = np.searchsorted(text[first], np.arange(texts.n + 1))
    edges = np.searchsorted(text, np.arange(texts.n + 1))
    out = []
    for i in range(texts.n):
        if bounds[i] < bounds[i + 1]:
            out.append(np.unique(found[bounds[i] : bounds[i + 1]]))
        elif edges[i] < edges[i + 1]:
            few = words[edges[i] : edges[i + 1]]
            out.append(mixed(np.array([np.sum(few * powers(k)[0][: len(few)])], np.uint64) + np.uint64(len(few))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of the batches with about ``size`` bytes of text and SLICE_ROWS rows at most, and their texts.

    Memory that Arrow keeps of a batch goes back before the next one, as workers live on through other stages.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, min(begin + SLICE_ROWS, int(np.searchsorted(sizes, done + size, "right"))))
            part = batch.slice(begin, end - begin)
            yield part, Texts(part.column(at))
            begin = end
        pa.default_memory_pool().release_unused()
