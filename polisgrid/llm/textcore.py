"""Vectorised views of the texts in an Arrow batch: bytes, words, pieces and their 64-bit hashes.

A word is a run of bytes other than 20 and 09-0D (hex), so UTF-8 needs no decoding. A word or piece is identified by
a 64-bit hash; with n distinct words two of them share a hash with a probability
of about n * n / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most so many bytes (one row at least): rows, their bytes, n + 1 offsets. Null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(texts.type):
        texts = pa.nulls(len(texts), pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        own = offsets[at : end + 1]
        yield batch.slice(at, end - at), raw[own[0] : own[-1]], own - own[0]
        at = end


_MASK8 = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 256


def _hash_long(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A BLAKE2b digest of 64 bits, for long runs. Sums over powers modulo 2**64 would be alike for long words of two letters
    in the order of the Thue-Morse sequence and in the opposite one."""
    raw = memoryview(np.ascontiguousarray(data))
    digests = b"".join(hashlib.blake2b(raw[s : s + n], digest_size=8).digest() for s, n in zip(starts.tolist(), lens.tolist(), strict=True))
    return np.frombuffer(digests, "<u8").astype(np.uint64)


def hash_runs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A hash of each data[start : start + len]: eight bytes are mixed in at a time. Every len is over 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    window = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    long = lens > _LONG
    rest = np.where(long, 0, lens)
    out = mix(window[starts] & _MASK8[np.minimum(lens, 8)]) ^ (lens.astype(np.uint64) << np.uint64(40))
    on, at = np.flatnonzero(rest > 8), 8
    while len(on):
        out[on] = mix(out[on] ^ mix(window[starts[on] + at] & _MASK8[np.minimum(lens[on] - at, 8)]) + np.uint64(at))
        at += 8
        on = on[lens[on] > at]
    if long.any():
        out[long] = _hash_long(data, starts[long], lens[long])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word, and the number of words before each document (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    dark = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1] | cut[1:-1]
    last[:-1] &= ~dark[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lowered), and the number of words before each document."""
    starts, lens, before = words(data, offsets)
    return hash_runs(LOWER[data] if lower else data, starts, lens), before


_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 other visible ASCII, 3 space, 4 line feed
_KIND[33:127] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[32], _KIND[10] = 3, 4


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where byte-level BPE certainly begins a new match of its splitting pattern, document starts included.

    Sure places: after a letter that no letter follows; before a space, and around a line feed, that stands alone
    between visible characters. Letters are those of ASCII and Latin-1, other characters are left uncut.
    """
    n = len(data)
    sure = np.zeros(n + 1, bool)
    if n:
        kind = _KIND[data]
        tail = np.zeros(n, bool)
        tail[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter_end = (kind == 1) | tail
        seen_end = letter_end | (kind == 2)
        seen_start = (kind == 1) | (kind == 2) | (data == 0xC3)
        alone = np.zeros(n, bool)
        alone[1:-1] = ((kind == 3) | (kind == 4))[1:-1] & seen_end[:-2] & seen_start[2:]
        sure[:-1] |= alone
        sure[1:] |= alone & (kind == 4)
        sure[1:n] |= letter_end[:-1] & (kind[1:] == 2)
        bad = np.zeros(n + 1, bool)  # what stands across two documents says nothing
        bad[offsets] = True
        bad[np.maximum(offsets - 1, 0)] = True
        sure &= ~bad
    sure[offsets] = True
    return np.flatnonzero(sure[:-1])


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[s : s + l] of each pair, one after another."""
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - lens), lens)]


def distinct_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, an index of each, and the number of each input's value among them."""
    order = np.argsort(hashes)
    held = hashes[order]
    new = np.append(np.ones(min(1, len(held)), bool), held[1:] != held[:-1])
    back = np.empty(len(held), np.int64)
    back[order] = np.cumsum(new) - 1
    return held[new], order[new], back


class Memo:
    """What was computed for a distinct hash: rows of an array of fixed width, or of varying length.

    Holds at most `most` hashes; beyond them it starts anew, so memory is bounded.
    """

    def __init__(self, dtype: np.dtype, width: int = 0, most: int = 1 << 20):
        self.dtype, self.width, self.most = dtype, width, most
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)
        self.pool = np.zeros((0, self.width) if self.width else 0, self.dtype)

    def look(self, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
        """The row of each hash. make(indices into hashes of one example of each unknown) gives (pool, lens)."""
        distinct, first, back = distinct_of(hashes)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            if len(self.hashes) + int((~known).sum()) > self.most and len(self.hashes):
                self.clear()
                known[:] = False
            pool, lens = make(first[~known])
            n = len(self.starts) if not self.width else len(self.pool)
            fresh = int((~known).sum())
            if not self.width:
                self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lens) - lens])
                self.lens = np.concatenate([self.lens, lens])
            self.pool = np.concatenate([self.pool, pool.astype(self.dtype, copy=False)])
            spot = np.searchsorted(self.hashes, distinct[~known])
            self.rows = np.insert(self.rows, spot, np.arange(n, n + fresh))
            self.hashes = np.insert(self.hashes, spot, distinct[~known])
            at = np.searchsorted(self.hashes, distinct)
        return self.rows[at][back]
