"""Hashes of words and shingles of whole batches of texts, with array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once. Longer texts are hashed in pieces, their words as wholes.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: ASCII space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unmixed(h: np.ndarray) -> np.ndarray:
    """The numbers that :func:`mixed` makes these of."""
    h = (h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = (h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


_numbers = mixed(np.arange(1, 1025, dtype=np.uint64) * np.uint64(BASE))
#: A number per byte, with ASCII letters in lower case and as they are; the weights of a shingle's words.
LOWER = _numbers[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
AS_IS = _numbers[:256].copy()
WEIGHTS = _numbers[256:] | np.uint64(1)
#: Classes of bytes: blanks 0; letters (all bytes of non-ASCII characters among them) 1; digits 2; others 3.
KINDS = np.array([0 if b in BLANKS else 1 if chr(b).isalpha() or b > 127 else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for one chunk."""
    return _powers(CHUNK + 1, BASE), _powers(CHUNK + 1, pow(BASE, -1, 1 << 64))


def _sums(data: np.ndarray, breaks: np.ndarray, tables: tuple, values: np.ndarray, by_kind: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and polynomial sums of the words in ``data``, of at most :data:`CHUNK` bytes."""
    n = len(data)
    kind = KINDS[data]
    word = kind != 0
    change = np.ones(n + 1, bool)
    change[1:n] = (kind[1:] != kind[:-1]) if by_kind else (word[1:] != word[:-1])
    change[breaks] = True
    starts = np.flatnonzero(word & change[:-1])
    ends = np.flatnonzero(word & change[1:]) + 1
    up, down = tables
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    return starts, (ends - starts).astype(np.uint64), (sums[ends] - sums[starts]) * down[starts]


def word_hashes(data: np.ndarray, breaks: np.ndarray, tables: tuple, values: np.ndarray, by_kind: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in ``data``, of at most :data:`CHUNK` bytes. No word spans a break.

    Words are runs of non-blanks or, ``by_kind``, runs of letters, digits or other signs.
    """
    starts, lengths, sums = _sums(data, breaks, tables, values, by_kind)
    return mixed(sums + lengths), starts


def _long(data: np.ndarray, tables: tuple, values: np.ndarray, by_kind: bool) -> np.ndarray:
    """The word hashes of one long text. The sum of a word that a chunk cuts is carried into the next one."""
    out, carried = [], None  # sum, length and kind of the last byte
    for at in range(0, len(data), CHUNK):
        piece = data[at:at + CHUNK]
        starts, lengths, sums = _sums(piece, np.zeros(1, np.int64), tables, values, by_kind)
        if carried is not None:
            total, length, kind = carried
            if len(starts) and starts[0] == 0 and (not by_kind or KINDS[piece[0]] == kind):
                moved = (int(sums[0]) * pow(BASE, length, 1 << 64) + total) % (1 << 64)
                sums[0], lengths[0] = np.uint64(moved), lengths[0] + np.uint64(length)
            else:
                out.append(mixed(np.array([(total + length) % (1 << 64)], np.uint64)))
            carried = None
        if len(starts) and at + CHUNK < len(data) and KINDS[piece[-1]]:
            carried = int(sums[-1]), int(lengths[-1]), KINDS[piece[-1]]
            sums, lengths = sums[:-1], lengths[:-1]
        out.append(mixed(sums + lengths))
    return np.concatenate(out)


def words_of(texts: pa.Array, tables: tuple, lower: bool = True, by_kind: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; a missing text has none."""
    values = LOWER if lower else AS_IS
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
        if j <= i:
            yield _long(data[offsets[i]:offsets[i + 1]], tables, values, by_kind)
            i += 1
            continue
        bounds = offsets[i:j + 1] - offsets[i]
        hashes, starts = word_hashes(data[offsets[i]:offsets[j]], bounds, tables, values, by_kind)
        at = np.searchsorted(starts, bounds)
        for k in range(j - i):
            yield hashes[at[k]:at[k + 1]]
        i = j


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, ascending. Fewer words are one shingle, none have none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    count, size = (n - width + 1, width) if n >= width else (1, n)
    sums = np.full(count, size, np.uint64)
    for j in range(size):
        sums += words[j:j + count] * WEIGHTS[j]
    return np.unique(mixed(sums))
