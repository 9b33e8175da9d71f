"""Operator 1: token ids as length-delimited binary records with a separate offset index.

A shard is a sequence of frames: length (unsigned 64 bits), masked CRC-32C of the length, payload, masked CRC-32C of
the payload, all little-endian. A payload is the document's id (signed 64 bits), its flags (unsigned 16 bits: bytes
per token id, plus 256 for a null id) and the token ids. Beside each shard lies an index of fixed-size entries, so a
reader can visit records in any order.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgrid.llm import shared
from polisgrid.llm.textcore import Memo, hash_runs, piece_starts, ragged, text_slices

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("start", "<u8"), ("n_tokens", "<u4"), ("null_id", "<u4")])
_HEAD = 10
#: Fixed values of the checksum: Castagnoli's polynomial (reflected) and the constant of the mask.
_POLY, _MASK = 0x82F63B78, 0xA282EAD8
_LANE = 256
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True


def _register(crc: np.ndarray, bits: int) -> np.ndarray:
    for _ in range(bits):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(_POLY) * (crc & np.uint32(1)))
    return crc


_T16 = _register(np.arange(1 << 16, dtype=np.uint32), 16)


@functools.cache
def _shift(n_words: int) -> np.ndarray:
    """Four tables of 256: the register after n_words zero words, byte by byte of the register before."""
    unit = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(n_words):
        unit = _T16[unit & np.uint32(0xFFFF)] ^ (unit >> np.uint32(16))
    return unit.reshape(4, 256)


def _moved(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def masked_crc32c(units: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The masked CRC-32C of consecutive runs of 16-bit units; each run has two units or more.

    Runs are cut into lanes of equal length, padded with zeros in front, that are advanced together.
    """
    lanes = -(-counts // _LANE)
    padded = np.zeros(int(lanes.sum()) * _LANE, np.uint16)
    ends = np.cumsum(lanes) * _LANE
    at = np.arange(len(units)) + np.repeat(ends - np.cumsum(counts), counts)
    padded[at] = units
    first = ends - counts
    padded[first] ^= np.uint16(0xFFFF)
    padded[first + 1] ^= np.uint16(0xFFFF)
    table = np.ascontiguousarray(padded.reshape(-1, _LANE).T)
    crc = np.zeros(table.shape[1], np.uint32)
    for row in table:
        crc = _T16[(crc ^ row) & np.uint32(0xFFFF)] ^ (crc >> np.uint32(16))
    out = np.zeros(len(counts), np.uint32)
    begin, tables = np.cumsum(lanes) - lanes, _shift(_LANE)
    for k in range(int(lanes.max()) if len(lanes) else 0):
        on = np.flatnonzero(lanes > k)
        out[on] = _moved(out[on], tables) ^ crc[begin[on] + k]
    out = ~out
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(_MASK)


def frames(ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of consecutive frames, and the length of each payload."""
    n, per = len(counts), width // 2
    sizes = _HEAD // 2 + counts * per  # in units of 16 bits
    head = np.zeros((n, _HEAD // 2), np.uint16)
    head[:, :4] = doc_ids.astype("<i8").view("<u2").reshape(n, 4)
    head[:, 4] = width + 256 * null
    ends = np.cumsum(sizes)
    units = np.zeros(int(ends[-1]) if n else 0, np.uint16)
    units[((ends - sizes)[:, None] + np.arange(_HEAD // 2)).ravel()] = head.ravel()
    body = ids.astype(f"<u{width}").view("<u2")
    units[np.arange(len(body)) + np.repeat(ends - np.cumsum(counts * per), counts * per)] = body
    lengths = (2 * sizes).astype("<u8")
    size_units = lengths.view("<u2")
    size_crc = masked_crc32c(size_units, np.full(n, 4))
    crc = masked_crc32c(units, sizes)
    out = np.zeros(len(units) + 8 * n, np.uint16)
    to = ends - sizes + 8 * np.arange(n)
    out[(to[:, None] + np.arange(4)).ravel()] = size_units
    out[(to[:, None] + np.array([4, 5])).ravel()] = size_crc.astype("<u4").view("<u2")
    out[np.arange(len(units)) + np.repeat(6 + 8 * np.arange(n), sizes)] = units
    out[((to + 6 + sizes)[:, None] + np.arange(2)).ravel()] = crc.astype("<u4").view("<u2")
    return out.view(np.uint8), lengths.astype(np.int64)


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    vocab = found.get_vocab(True)
    spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
    spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
    return found, len(spaced), spaced, Memo(np.dtype(np.int32), most=3 << 19)


@functools.cache
def _whole(path: str):
    """The tokenizer as it is, and the byte strings of its added tokens."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return found, [t.content.encode() for t in found.get_added_tokens_decoder().values() if t.content]


def _holding(data: np.ndarray, offsets: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """The documents that hold one of the byte strings."""
    raw, out = data.tobytes(), set()
    for mark in marks:
        at = raw.find(mark)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            inside = at + len(mark) <= offsets[d + 1]
            if inside:
                out.add(d)
            at = raw.find(mark, int(offsets[d + 1]) if inside else at + 1)
    return np.array(sorted(out), np.int64)


def encode(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all documents, one after another, and the number of each, as the library's encode gives them with
    add_special_tokens=False. Documents that hold an added token are given to the library whole; of the others each
    distinct piece is encoded once."""
    library, marks = _whole(path)
    held = _holding(data, offsets, marks)
    if not len(held):
        return _by_pieces(data, offsets, path)
    keep = np.ones(len(offsets) - 1, bool)
    keep[held] = False
    sizes = np.diff(offsets)
    rest, rest_counts = _by_pieces(data[np.repeat(keep, sizes)], np.append(0, np.cumsum(sizes[keep])), path)
    counts = np.zeros(len(sizes), np.int64)
    counts[keep] = rest_counts
    own = []
    for d in held.tolist():
        text = data[offsets[d] : offsets[d + 1]].tobytes().decode()
        own.append(np.array(library.encode(text, add_special_tokens=False).ids, np.int32))
        counts[d] = len(own[-1])
    out = np.empty(int(counts.sum()), np.int32)
    mask = np.repeat(keep, counts)
    out[mask], out[~mask] = rest, np.concatenate(own)
    return out, counts


def _by_pieces(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    tokenizer, _, spaced, memo = _tokenizer(path)
    starts = piece_starts(data, offsets)
    lens = np.diff(np.append(starts, len(data)))

    def make(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Pieces that begin with their only space and end in a visible byte can be encoded as one text: a token that
        # begins with a space begins a piece.
        begin, size = starts[at], lens[at]
        spaces = np.append(0, np.cumsum(data == 32))
        plain = (data[begin] == 32) & (size > 1) & (spaces[begin + size] - spaces[begin] == 1)
        plain &= _VISIBLE[data[np.minimum(begin + 1, len(data) - 1)]] & _VISIBLE[data[begin + size - 1]]
        raw = data.tobytes()
        joined = ragged(data, begin[plain], size[plain]).tobytes().decode()
        many = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        texts = [raw[s : s + n].decode() for s, n in zip(begin[~plain].tolist(), size[~plain].tolist(), strict=True)]
        other = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        first = np.flatnonzero(spaced[many])
        assert len(first) == int(plain.sum())
        counts = np.zeros(len(at), np.int64)
        counts[plain] = np.diff(np.append(first, len(many)))
        counts[~plain] = np.fromiter(map(len, other), np.int64, len(other))
        pool = np.zeros(int(counts.sum()), np.int32)
        mask = np.repeat(plain, counts)
        pool[mask] = many
        pool[~mask] = np.fromiter((y for x in other for y in x), np.int32)
        return pool, counts

    rows = memo.look(hash_runs(data, starts, lens), make)
    n = memo.lens[rows]
    total = np.append(0, np.cumsum(n))
    counts = np.diff(total[np.searchsorted(starts, offsets)])
    return ragged(memo.pool, memo.starts[rows], n), counts


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str, path: str, end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        system, root = _filesystem(folder)
        _, vocab, _, _ = _tokenizer(path)
        width = 2 if max(vocab, end_id + 1) <= 1 << 16 else 4
        system.create_dir(root, recursive=True)
        mine = f"{root}/_{uuid.uuid4().hex}"
        at = tokens = docs = 0
        with system.open_output_stream(f"{mine}.rec") as out, system.open_output_stream(f"{mine}.idx") as index:
            for batch in batches:
                for rows, data, offsets in text_slices(batch, "text"):
                    ids, counts = encode(data, offsets, path)
                    ends = np.cumsum(counts)
                    ids = np.insert(ids, ends, end_id)
                    counts = counts + 1
                    key = rows.column(0)
                    doc_ids = key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    null = key.is_null().to_numpy(zero_copy_only=False).astype(np.uint16)
                    raw, lengths = frames(ids, counts, doc_ids, null, width)
                    entry = np.zeros(len(counts), INDEX)
                    entry["doc_id"], entry["null_id"], entry["length"], entry["n_tokens"] = doc_ids, null, lengths, counts
                    step = lengths + 16
                    entry["offset"] = at + np.cumsum(step) - step
                    entry["start"] = tokens + np.cumsum(counts) - counts
                    out.write(raw.tobytes())
                    index.write(entry.tobytes())
                    at, tokens, docs = at + int(step.sum()), tokens + int(counts.sum()), docs + len(counts)
        for kind in ("rec", "idx"):  # the same rows give the same bytes, so a second attempt may replace the first
            system.move(f"{mine}.{kind}", f"{root}/shard-{shard:06d}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return write


def read_shard(folder: str, shard: int, order: np.ndarray | None = None, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Index entries and their token ids, checksums verified; in file order, or in the order of the given entry numbers."""
    system, root = _filesystem(folder)
    with system.open_input_stream(f"{root}/shard-{shard:06d}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    runs = []
    if order is None:
        at, ends = 0, (index["offset"] + index["length"] + np.uint64(16)).astype(np.int64)
        while at < len(index):
            end = max(at + 1, int(np.searchsorted(ends, int(index["offset"][at]) + most, "right")))
            runs.append(index[at:end])
            at = end
    else:
        runs = [index[k : k + 1] for k in order]
    with system.open_input_file(f"{root}/shard-{shard:06d}.rec") as f:
        for run in runs:
            begin = int(run["offset"][0])
            raw = np.frombuffer(f.read_at(int(run["offset"][-1] + run["length"][-1]) + 16 - begin, begin), "<u2")
            at = (run["offset"].astype(np.int64) - begin) // 2
            sizes = run["length"].astype(np.int64) // 2
            field = lambda to, n: raw[(to[:, None] + np.arange(n)).ravel()]
            length_units = field(at, 4)
            good = (length_units.view("<u8") == run["length"]) & (field(at + 4, 2).view("<u4") == masked_crc32c(length_units, np.full(len(run), 4)))
            good &= field(at + 6 + sizes, 2).view("<u4") == masked_crc32c(ragged(raw, at + 6, sizes), sizes)
            if not good.all():
                raise ValueError(f"shard {shard}: checksum fails at record {int(np.flatnonzero(~good)[0])} of a run at byte {begin}")
            flags = raw[at + 10]
            yield run, [raw[s + 11 : s + 6 + n].view(f"<u{int(w) & 255}") for s, n, w in zip(at.tolist(), sizes.tolist(), flags, strict=True)]


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> list[tuple[int, int, int, int]]:
    """Encodes doc_id and text into shards under folder, in ascending doc_id order (null first, equal ids by text).

    Null and empty texts give the end id alone. Returns one tuple (shard, n_docs, n_tokens, ids before it) per shard.
    Only these sums, one row a shard, come to the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    sums = dealt.mapInArrow(_writer(folder, tokenizer_path, end_id), "shard long, n_docs long, n_tokens long").collect()
    out, before = [], 0
    for shard, n_docs, n_tokens in sorted(map(tuple, sums)):
        if n_docs:
            out.append((shard, n_docs, n_tokens, before))
        before += n_tokens
    return out


def read_records(spark, folder: str, shards: list[tuple[int, int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the files, one task a shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run, ids in read_shard(folder, shard):
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(run["doc_id"].astype(np.int64), mask=run["null_id"] > 0),
                            "start": pa.array(run["start"].astype(np.int64) + before),
                            "n_tokens": pa.array(np.array([len(x) for x in ids], np.int64)),
                            "ids_crc32": pa.array(np.array(crc, np.int64)),
                            "shard": pa.array(np.full(len(ids), shard, np.int64)),
                        }
                    )

    listed = spark.createDataFrame([(s, b) for s, _, _, b in shards], "shard long, before long")
    if shards:
        listed = listed.repartitionByRange(len(shards), "shard")
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes documents as records and reads them back: doc_id, start, n_tokens, ids_crc32, shard.

    Empty table: no shard, no row. Repeated rows are repeated records. Other columns are ignored.
    """
    folder = folder or shared.new_path(docs.sparkSession, "records")
    return read_records(docs.sparkSession, folder, write_records(docs, folder, tokenizer_path, end_id))
