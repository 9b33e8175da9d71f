"""Operator 2: byte-level BPE by corpus-level merge replay, and decoding.

The distinct pieces of a block of documents form a small corpus. An inverted index from the token that a pair would
become to the places of such pairs is kept, and merges are applied in the order of their rank to all places at once;
only the pairs beside a merged place are looked up anew.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgrid.llm.textcore import Memo, hash_runs, piece_starts, ragged, text_slices

_NONE = np.int32(2**31 - 1)
BLOCK_BYTES = 24 << 20


class Ranks:
    """Merge ranks read from a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.single = np.array([tokens[bytes([k])] for k in range(256)], np.int32)
        pairs = []
        for token, rank in tokens.items():
            for k in range(1, len(token)):
                a, b = tokens.get(token[:k]), tokens.get(token[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank))
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.into = np.array([r for _, r in pairs] or [_NONE], np.int32)
        # Pairs are found in a table of two-way buckets on their hash: one gather, not a binary search.
        self.bits = max(8, int(len(self.keys) * 4).bit_length())
        order = np.argsort(self._slot(self.keys), kind="stable")
        slots = self._slot(self.keys)[order]
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        self.table_into = np.full(1 << self.bits, _NONE, np.int32)
        first = np.append(True, slots[1:] != slots[:-1])
        self.table_key[slots[first]] = self.keys[order][first]
        self.table_into[slots[first]] = self.into[order][first]
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[slots[~first]] = True
        n = max(tokens.values()) + 1
        by_id = [b""] * n
        for token, rank in tokens.items():
            by_id[rank] = token
        self.lens = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.memo = Memo(np.dtype(np.int32), most=3 << 19)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the pairs merge into, or _NONE."""
        keys = (a.astype(np.int64) << 32) | b
        slot = self._slot(keys)
        out = np.where(self.table_key[slot] == keys, self.table_into[slot], _NONE)
        again = np.flatnonzero((out == _NONE) & self.crowded[slot])
        if len(again):
            at = np.searchsorted(self.keys, keys[again])
            at[at == len(self.keys)] = 0
            out[again] = np.where(self.keys[at] == keys[again], self.into[at], _NONE)
        return out

    def replay(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces (their bytes one after another), and the number of each."""
        n = len(data)
        token = np.append(self.single[data], 0).astype(np.int32)
        ends = np.cumsum(lens)
        right = np.arange(1, n + 2)  # the next token's place; n where the piece ends
        right[ends - 1] = n
        left = np.arange(-1, n)
        left[ends - lens] = n
        into = np.full(n + 1, _NONE, np.int32)  # what the pair that begins here merges into
        inner = np.flatnonzero(right[:n] != n)
        into[inner] = self.rank(token[inner], token[right[inner]])
        index: dict[int, list[np.ndarray]] = {}

        def enter(ranks: np.ndarray, places: np.ndarray) -> list[int]:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            fresh = []
            begin = 0
            for end in [*cuts.tolist(), len(ranks)]:
                r = int(ranks[begin])
                if r in index:
                    index[r].append(places[begin:end])
                else:
                    index[r] = [places[begin:end]]
                    fresh.append(r)
                begin = end
            return fresh

        found = inner[into[inner] != _NONE]
        heap = enter(into[found], found) if len(found) else []
        heapq.heapify(heap)
        alive = np.ones(n, bool)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            at = at[into[at] == r]
            if len(at) > 1:
                if len(lists) > 1:
                    at = at[np.append(True, at[1:] != at[:-1])]
                if (right[at[:-1]] == at[1:]).any():  # pairs that share a token: the left one goes first
                    keep, last = [], -1
                    for p in at.tolist():
                        if p != last:
                            keep.append(p)
                            last = int(right[p])
                    rest = np.setdiff1d(at, keep, assume_unique=True)
                    at = np.array(keep)
                    if len(rest):
                        index[r] = [rest]
                        heapq.heappush(heap, r)
            if not len(at):
                continue
            gone = right[at]
            after = right[gone]
            token[at] = r
            right[at] = after
            left[after] = at
            alive[gone] = False
            into[gone] = _NONE
            before = left[at]
            first = np.concatenate([at, before])
            second = np.concatenate([after, at])
            real = (first != n) & (second != n)
            made = np.full(len(first), _NONE, np.int32)
            made[real] = self.rank(token[first[real]], token[second[real]])
            into[first] = made
            into[n] = _NONE
            some = made != _NONE
            if some.any():
                for x in enter(made[some], first[some]):
                    heapq.heappush(heap, x)
        total = np.append(0, np.cumsum(alive))
        return token[:n][alive], np.diff(total[np.append(0, ends)])

    def learn(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of data[start : start + len]: each match of the pattern is a piece of the small corpus."""
        raw = data.tobytes()
        parts = [self.find(raw[s : s + n].decode()) for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = [y.encode() for x in parts for y in x]
        tokens, counts = self.replay(np.frombuffer(b"".join(flat), np.uint8), np.fromiter(map(len, flat), np.int64, len(flat)))
        total = np.append(0, np.cumsum(counts))
        return tokens, np.diff(total[np.append(0, np.cumsum(per))])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all documents, their places in the pieces and the number of ids of each document."""
        starts = piece_starts(data, offsets)
        lens = np.diff(np.append(starts, len(data)))
        rows = self.memo.look(hash_runs(data, starts, lens), lambda at: self.learn(data, starts[at], lens[at]))
        n = self.memo.lens[rows]
        total = np.append(0, np.cumsum(n))
        return ragged(self.memo.pool, self.memo.starts[rows], n), np.diff(total[np.searchsorted(starts, offsets)])

    def prepare(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """Learns the unknown pieces of a whole block in one replay."""
        cut, hashes, where, size = 0, [], [], []
        while cut < len(offsets) - 1:
            end = max(cut + 1, int(np.searchsorted(offsets, offsets[cut] + (2 << 20), "right")) - 1)
            part = data[offsets[cut] : offsets[end]]
            starts = piece_starts(part, offsets[cut : end + 1] - offsets[cut])
            lens = np.diff(np.append(starts, len(part)))
            h, first = np.unique(hash_runs(part, starts, lens), return_index=True)
            hashes.append(h)
            where.append(starts[first] + offsets[cut])
            size.append(lens[first])
            cut = end
        if hashes:
            where, size = np.concatenate(where), np.concatenate(size)
            self.memo.look(np.concatenate(hashes), lambda at: self.learn(data, where[at], size[at]))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, one after another, and how many each id has."""
        n = self.lens[ids]
        return ragged(self.bytes, self.starts[ids], n), n


@functools.cache
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def bpe(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, after the columns named in keep.

    with_ids adds ids, the token ids as little-endian unsigned 32-bit integers. Null texts count as empty: no token.
    Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    fields = [f for f in docs.schema.fields if f.name in keep and f.name not in ("doc_id", "text")]
    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids binary"] * with_ids])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks(path, pattern)
        for batch in batches:
            for _, block, whole in text_slices(batch, "text", BLOCK_BYTES):
                own.prepare(block, whole)
            for rows, data, offsets in text_slices(batch, "text"):
                ids, counts = own.encode(data, offsets)
                back, n = own.decode(ids)
                ends = np.cumsum(counts)
                places = np.append(0, np.cumsum(n))[np.append(0, ends)].tolist()
                raw, plain = ids.astype("<u4").tobytes(), back.tobytes()
                cuts = (4 * np.append(0, ends)).tolist()
                parts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                out = {"doc_id": rows.column(0)} | {k: rows.column(rows.schema.get_field_index(k)) for k in names}
                out |= {
                    "n_tokens": pa.array(counts.astype(np.int64)),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(places, places[1:], strict=False)], pa.string()),
                }
                if with_ids:
                    out["ids"] = pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{k}`") for k in names), F.col("text").cast("string").alias("text")]
    return docs.select(*cols).mapInArrow(run, schema)
