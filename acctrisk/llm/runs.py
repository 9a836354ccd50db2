"""Runs of word bytes in batches of texts, found and hashed with array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from acctrisk.llm.words import BASE, LOWER, mixed

#: Bytes of text that are looked at together, and bytes of a run that its hash is made of.
SLICE, HASHED = 1 << 20, 1 << 16
_WEIGHTS = np.multiply.accumulate(np.full(HASHED, BASE, np.uint64))
#: ASCII letters in lower case, all other bytes as they are.
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets of slices of about :data:`SLICE` bytes; a row is never cut."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are ``inside``; no run spans two rows."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(n + 1, bool)
    change[1:n] = inside[1:] != inside[:-1]
    change[offsets] = True
    return np.flatnonzero(inside & change[:-1]), np.flatnonzero(inside & change[1:]) + 1


def _flat(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes of some runs, one behind the other: places in the data, places in the run, first places."""
    firsts = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    return inside + np.repeat(starts, lengths), inside, firsts


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run, in lower case: of its length and its first :data:`HASHED` bytes.

    Equal runs have equal hashes. Different ones may share one, so a hash can only rule runs out.
    """
    lengths = np.minimum(ends - starts, HASHED)
    done = np.cumsum(lengths)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + SLICE, "right")))
        places, inside, firsts = _flat(starts[at:to], lengths[at:to])
        out[at:to] = np.add.reduceat(LOWER[data[places]] * _WEIGHTS[inside], firsts)
        at = to
    return mixed(out + (ends - starts).astype(np.uint64))


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs themselves, in lower case."""
    lengths = ends - starts
    if not len(lengths):
        return pa.array([], pa.large_string())
    places, _, _ = _flat(starts, lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(LOWERED[data[places]]))
