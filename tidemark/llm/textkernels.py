"""Vectorised word and shingle hashes of Arrow text batches, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at a time (a single longer text is hashed alone).
CHUNK_BYTES = 2 << 20
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LONG_WORD = 40

#: Bytes that separate words: the space and the controls from tab to carriage return.
WHITE_BYTES = np.zeros(256, bool)
WHITE_BYTES[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of some texts: byte positions in data, and the text (row) of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: int  # the first row of the chunk
    rows: int  # how many rows it has

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), ends


def chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of CHUNK_BYTES or less, or of one row."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK_BYTES, "right")) - 1)
        yield a, b
        a = b


def words(texts: pa.Array, separators: np.ndarray = WHITE_BYTES) -> Iterator[Words]:
    """Maximal runs of bytes that are no separators, a chunk of texts at a time."""
    data, ends = buffers(texts)
    for a, b in chunks(ends):
        base = ends[a]
        part = data[base : ends[b]]
        inside = ~separators[part]
        cuts = ends[a : b + 1] - base
        begins, stops = inside.copy(), inside.copy()
        if len(part):
            begins[1:] &= ~inside[:-1]
            stops[:-1] &= ~inside[1:]
            inner = cuts[(cuts > 0) & (cuts < len(part))]
            begins[inner] = inside[inner]
            stops[inner - 1] = inside[inner - 1]
        starts, finish = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        row = np.searchsorted(cuts, starts, "right") - 1
        yield Words(part, starts, finish, row, a, b - a)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; another seed gives an independent one."""
    lengths = ends - starts
    out = np.full(len(starts), 0x243F6A8885A308D3, np.uint64) + lengths.astype(np.uint64)
    base = _BASE if not seed else mix(np.array([seed], np.uint64))[0] | np.uint64(1)
    active = np.flatnonzero(lengths <= _LONG_WORD)
    k = 0
    while len(active):
        active = active[lengths[active] > k]
        out[active] = out[active] * base + data[starts[active] + k]
        k += 1
    for i in np.flatnonzero(lengths > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return mix(out)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; shorter input gives none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total, at, block, width, rest = None, 0, hashes, 1, k
        step = _STEP
        while rest:  # blocks of 1, 2, 4... values are joined by the bits of k
            if rest & 1:
                part = block[at : at + n]
                total = part.copy() if total is None else total * step + part
                at += width
            rest >>= 1
            if rest:
                block = block[: len(block) - width] * step + block[width:]
                step = step * step * np.uint64(3) | np.uint64(1)
                width *= 2
    return mix(total + np.uint64(k))


def shingles(own: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of all k-word windows that lie within one text.

    A text with fewer words, but not none, has one window of all its words.
    """
    hashed = span_hashes(own.data, own.starts, own.ends)
    every = windows(hashed, k)
    at = np.flatnonzero(own.row[: len(every)] == own.row[len(own.row) - len(every) :]) if len(every) else np.empty(0, int)
    counts = own.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    first = np.concatenate([[0], np.cumsum(counts)])
    few = np.array([windows(hashed[first[r] : first[r + 1]], int(counts[r]))[0] for r in short], np.uint64)
    return np.concatenate([every[at], few]), np.concatenate([own.row[at], short]), np.concatenate([at, first[short]])
