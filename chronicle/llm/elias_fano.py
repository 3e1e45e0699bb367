"""Elias-Fano codes of sorted integers, with select.

Of n values up to u each keeps its lowest log2(u / n) bits as they are; the rest, which
rises slowly, is one bit for each value in a row of about 2 n bits: value i with upper
part h sets bit h + i.  So a value costs log2(u / n) + 2 bits or fewer.  ``select`` finds
bit i by a 32-bit count of the set bits before each 512 bits, a sixteenth of a bit more
for each bit of the row, and then inside those 512.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of the upper row that one count stands for; values that are coded or looked up in one step.
BLOCK, STEP = 64, 1 << 14


@dataclass
class EliasFano:
    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """The code of sorted unsigned 64-bit integers."""
        values = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(values)
        if n >= 1 << 31:
            raise ValueError("too many values for counts of 32 bits")
        most = int(values[-1]) if n else 0
        width = max(0, (most // n).bit_length() - 1) if n else 0
        # In steps of whole bytes, as a bit is a byte for a moment.
        bits = lambda x: ((x[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        low = np.concatenate([np.zeros(0, np.uint8), *[np.packbits(bits(values[k : k + STEP]), bitorder="little") for k in range(0, n if width else 0, STEP)]])
        row = np.zeros(-(-((most >> width) + n + 1) // (8 * BLOCK)) * 8 * BLOCK, dtype=bool)
        row[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = True
        set_ = np.add.reduceat(row, np.arange(0, len(row), 8 * BLOCK), dtype=np.uint32)
        before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(set_, dtype=np.uint32)[:-1]])
        return cls(n, width, low, np.packbits(row, bitorder="little"), before)

    def select(self, which: np.ndarray) -> np.ndarray:
        """The values of the given numbers, as unsigned 64-bit integers."""
        which = np.asarray(which, dtype=np.int64)
        if len(which) and not (0 <= which.min() and which.max() < self.n):
            raise IndexError("there is no such value")
        return np.concatenate([np.zeros(0, np.uint64), *[self._select(which[k : k + STEP]) for k in range(0, len(which), STEP)]])

    def _select(self, which: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, which, side="right") - 1
        rest = which - self.before[block]
        bits = np.unpackbits(self.high.reshape(-1, BLOCK)[block], axis=1, bitorder="little")
        place = block * (8 * BLOCK) + np.argmax(np.cumsum(bits, axis=1, dtype=np.int32) > rest[:, None], axis=1)
        upper = (place - which).astype(np.uint64) << np.uint64(self.width)
        return upper | self._low(which)

    def _low(self, which: np.ndarray) -> np.ndarray:
        """Lower parts, from the nine bytes that one can lie in."""
        if not self.width:
            return np.zeros(len(which), dtype=np.uint64)
        first = which * self.width
        padded = np.append(self.low, np.zeros(9, np.uint8))
        near = padded[(first >> 3)[:, None] + np.arange(9)]
        shift = (first & 7).astype(np.uint64)
        body = np.ascontiguousarray(near[:, :8]).view("<u8").ravel() >> shift
        # A shift by 64 is none at all in numpy, so the ninth byte is moved twice.
        body |= (near[:, 8].astype(np.uint64) << np.uint64(32)) << (np.uint64(32) - shift)
        return body & np.uint64((1 << self.width) - 1)

    def parts(self) -> list[bytes]:
        """The three arrays as little-endian bytes; with n and width all that ``load`` needs."""
        return [self.low.tobytes(), self.high.tobytes(), self.before.astype("<u4").tobytes()]

    @classmethod
    def load(cls, n: int, width: int, parts: list[bytes]) -> EliasFano:
        low, high, before = parts
        return cls(n, width, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(before, "<u4"))
