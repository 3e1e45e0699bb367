"""Words and word windows of many texts at once, on Arrow buffers with numpy.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``.  Words get 64-bit
hashes and windows of consecutive words get one or two, all by prefix sums of
polynomials modulo 2**64, so the cost is a few nanoseconds a byte and no Python
object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are handled in slices of about so many bytes; one longer text is a slice.
SLICE_BYTES = 1 << 19
#: Longer words get XXH64, as there are pairs of long words that polynomials modulo 2**64 cannot tell apart.
LONG_WORD = 256

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd bases that are 3 modulo 8, with their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B, 0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: ``offsets[i]:offsets[i + 1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def windows(self, size: int, base: int = BASES[1]) -> np.ndarray:
        """A hash for the window that begins at each word, also past a text's end."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * _powers(base, n), out=sums[1:])
        raw = (sums[size:] - sums[:-size]) * _powers(_inverse(base), n)[: n - size + 1]
        return mix(raw)

    def inside(self, size: int) -> np.ndarray:
        """For each window of ``windows(size)``, whether it lies in one text."""
        n = max(0, len(self.hashes) - size + 1)
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))[:n]
        return np.arange(n) + size <= ends


def split_words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]``."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64))
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _powers(BASES[0], n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers(_inverse(BASES[0]), n)[starts]
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = data[starts[k] : ends[k]].tobytes()
        raw[k] = xxhash.xxh64_intdigest(word.lower() if lower else word, 7)
    return Words(data, starts, ends, mix(raw), np.searchsorted(starts, bounds))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the bounds of its texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, where, body = texts.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that a slice holds about ``most`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = buffers(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row), data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
            row = end


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def shared_windows(words: Words, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, key, place) of every window of ``size`` words that lies in one text.

    A window's key is the hash of a part of it, ``size - width + 1`` words long: of
    its ``width`` parts the one with the least hash, its minimiser.  The choice
    depends on the window's words alone, so equal windows have equal keys.
    """
    full = words.windows(size, BASES[2])
    keys = sliding_min(words.windows(size - width + 1), width)[: len(full)]
    place = np.flatnonzero(words.inside(size))
    return full[place], keys[place], place
