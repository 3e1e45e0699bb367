"""Runs of bytes of many texts at once as Arrow strings: words by any table of bytes, and their counts.

No Python object is made for a run; equal runs of a slice get one number by Arrow's own
dictionary, which compares whole strings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(low: bytes) -> np.ndarray:
    """Which bytes belong to a run: those of ``low`` and all beyond ASCII, so that no character is cut."""
    out = np.zeros(256, dtype=bool)
    out[list(low)] = True
    out[128:] = True
    return out


@dataclass
class Runs:
    """``offsets[i]:offsets[i + 1]`` are the runs of text i; a run is a row of ``strings``."""

    strings: pa.Array
    offsets: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def numbered(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct strings, and the number of each run's."""
        coded = self.strings.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, cut: np.ndarray | None = None) -> Runs:
    """The longest runs of bytes ``inside`` in the texts ``data[bounds[i]:bounds[i + 1]]``.

    ``cut`` marks bytes, one more than ``data`` has, before which a run ends although it could go on.
    """
    n = len(data)
    if n == 0:
        return Runs(pa.array([], pa.string()), np.zeros(len(bounds), dtype=np.int64))
    solid = inside[data]
    edge = np.zeros(n + 1, dtype=bool) if cut is None else cut.copy()
    edge[bounds] = True
    begins = solid.copy()
    begins[1:] &= edge[1:-1] | ~solid[:-1]
    starts, kept = np.flatnonzero(begins), data[solid]
    # Runs cover the solid bytes in their order, so a run begins at the number of solid bytes before it.
    place = np.flatnonzero(begins[solid])
    where = np.append(place, len(kept)).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(place), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(kept)))
    return Runs(strings, np.searchsorted(starts, bounds))


def counted(text: np.ndarray, number: np.ndarray, numbers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, count) of each pair that occurs, ordered by text and number."""
    pairs, times = np.unique(text.astype(np.int64) * max(1, numbers) + number, return_counts=True)
    return pairs // max(1, numbers), pairs % max(1, numbers), times
