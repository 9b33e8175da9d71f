"""Operator 12: WARC archives of one gzip stream a file made into archives of one member a record, with an index.

A monolithic archive can be read from its beginning only. The normaliser inflates its stream once, in pieces, writes
every record again as a gzip member of its own and beside the archive an index of offsets, by which any record is read
alone. While it rewrites, responses whose payload another record holds become revisits without a payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisgrid.llm.shared import Table, new_path, remove

#: Fixed values of the format.
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
#: An archive ends once it has so many bytes of payload or records, so that a task's work has a bound.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 128 << 20, 100_000
_PIECE = 1 << 20
#: Tasks at most; beyond that many archives a task takes several.
TASKS = 50_000
#: Entries of the offset index beside an archive.
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("page_id", "<i8"), ("null_id", "u1"), ("revisit", "u1"), ("digest", "S32")])


class Record(NamedTuple):
    """Header fields by lower-case name, in file order, and the block."""

    fields: dict[str, str]
    block: bytes


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for each attempt to write a page, so that a revisit can name its response."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def header(fields: dict[str, str], size: int) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return _VERSION + lines.encode() + b"Content-Length: %d\r\n\r\n" % size


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    """A whole response record: its block is an HTTP head and the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": _DATE,
        "WARC-Target-URI": None if url is None else "".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": None if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
    }
    return header(fields, len(head) + len(payload)) + head + payload + b"\r\n\r\n"


def rewritten(record: Record, refers_to: int | None = None) -> bytes:
    """The bytes of a record as it is, or as a revisit of a page: it keeps the HTTP head only, which tells the payload's size."""
    names = {"warc-type": "WARC-Type", "warc-record-id": "WARC-Record-ID", "warc-date": "WARC-Date", "warc-target-uri": "WARC-Target-URI", "warc-payload-digest": "WARC-Payload-Digest", "x-page-id": "X-Page-ID", "x-refers-to-page-id": "X-Refers-To-Page-ID", "warc-profile": "WARC-Profile", "warc-refers-to": "WARC-Refers-To", "content-type": "Content-Type"}
    fields = {names.get(k, k): v for k, v in record.fields.items() if k != "content-length"}
    block = record.block
    if refers_to is not None:
        digest = record.fields["warc-payload-digest"].removeprefix("sha1:")
        fields |= {"WARC-Type": "revisit", "WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
        block = block[: block.index(b"\r\n\r\n") + 4]
    return header(fields, len(block)) + block + b"\r\n\r\n"


def inflated(stream, piece: int = _PIECE) -> Iterator[bytes]:
    """The content of a gzip file piece by piece, of one member or several. A file that ends inside a member raises."""
    inside, engine = False, zlib.decompressobj(31)
    while raw := stream.read(piece):
        while raw:
            inside = True
            yield engine.decompress(raw, piece)
            raw = engine.unconsumed_tail
            if engine.eof:
                raw, inside, engine = engine.unused_data, False, zlib.decompressobj(31)
    if inside:
        yield engine.flush()
    if inside and not engine.eof:
        raise ValueError("the archive ends inside a gzip member")


def parsed(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Records of the inflated bytes. At most one record and one piece are held."""
    held, done = bytearray(), False

    def more() -> bool:
        nonlocal done
        got = next(pieces, None)
        done = got is None
        if got:
            held.extend(got)
        return not done

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends inside a record's header")
            return
        first, *lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        fields: dict[str, str] = {}
        last = ""
        for line in lines:
            if line[:1] in " \t" and last:  # a folded line goes on with the field before
                fields[last] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        size, begin = int(fields["content-length"]), end + 4
        while len(held) < begin + size + 4 and more():
            pass
        if bytes(held[begin + size : begin + size + 4]) != b"\r\n\r\n":
            raise ValueError("a record's block is cut or doesn't end in two empty lines")
        yield Record(fields, bytes(held[begin : begin + size]))
        del held[: begin + size + 4]


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _deflated(raw: bytes, level: int = 6) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


_WRITTEN = "archive string, seq long, page_id long, digest string, size long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url and html as monolithic archives under folder, without a shuffle: archive, seq, page_id, digest
    and size of every record. Each attempt of a task writes files of its own, so store the result before it is used."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(folder)
        system.create_dir(root, recursive=True)
        out = engine = None
        name, seq, size = "", 0, 0

        def close() -> None:
            out.write(engine.flush())
            out.close()

        for batch in batches:
            ids, urls, bodies = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            rows: dict[str, list] = {"archive": [], "seq": [], "digest": [], "size": []}
            for k, page_id in enumerate(ids):
                if out is None or size >= ARCHIVE_BYTES or seq >= ARCHIVE_RECORDS:
                    if out is not None:
                        close()
                    name, seq, size = uuid.uuid4().hex, 0, 0
                    out, engine = system.open_output_stream(f"{root}/{name}.warc.gz", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = bodies[k].as_py() or b""
                digest = base32_sha1(payload)
                out.write(engine.compress(response(page_id, urls[k].as_py(), payload, digest)))
                for column, value in zip(rows.values(), (name, seq, digest, len(payload)), strict=True):
                    column.append(value)
                seq, size = seq + 1, size + len(payload)
            yield pa.RecordBatch.from_pydict({"archive": rows["archive"], "seq": pa.array(rows["seq"], pa.int64()), "page_id": batch.column(0).cast(pa.int64()), "digest": rows["digest"], "size": pa.array(rows["size"], pa.int64())})
        if out is not None:
            close()

    taken = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary"))
    return taken.mapInArrow(write, _WRITTEN)


def decisions(records: DataFrame, least: int = 0) -> DataFrame:
    """archive, seq, refers_to: of records with equal payloads of at least so many bytes, those with the largest
    page_id stay responses. Only digests and ids are shuffled; the join's large side can be split where many are equal."""
    latest = records.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("latest"), F.count("*").alias("copies"))
    repeated = latest.where("copies > 1 and latest is not null").select("digest", "size", "latest")
    both = records.join(repeated, ["digest", "size"], "left")
    return both.select("archive", "seq", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers_to"))


def normalise(plan: DataFrame, source: str, folder: str, tasks: int) -> DataFrame:
    """Rewrites the archives under source that the plan names (archive, seq, refers_to: a row for each record that is to
    become a revisit of that page, and a row for each archive at least) and returns archive, records and bytes of each.

    Each archive is one task's work, as its stream can be read from the beginning only; a record and a piece are held.
    The number of tasks is given, as the plan's few bytes say nothing of the work.
    """

    def rewrite(table: pa.Table) -> pa.Table:
        system, to = _system(folder)
        _, root = _system(source)
        system.create_dir(to, recursive=True)
        name = table.column("archive")[0].as_py()
        changed = {s: r for s, r in zip(table.column("seq").to_pylist(), table.column("refers_to").to_pylist(), strict=True) if r is not None}
        mine, at, entries = f"{to}/_{uuid.uuid4().hex}", 0, []
        with system.open_input_stream(f"{root}/{name}.warc.gz", compression=None) as stream, system.open_output_stream(f"{mine}.warc.gz", compression=None) as out:
            for seq, record in enumerate(parsed(inflated(stream))):
                member = _deflated(rewritten(record, changed.get(seq)))
                out.write(member)
                revisit = seq in changed or record.fields.get("warc-type") == "revisit"
                page = record.fields.get("x-page-id")
                entries.append((at, len(member), int(page or 0), page is None, revisit, record.fields.get("warc-payload-digest", "").removeprefix("sha1:").encode()))
                at += len(member)
        with system.open_output_stream(f"{mine}.idx", compression=None) as out:
            out.write(np.array(entries, INDEX).tobytes())
        for kind in ("warc.gz", "idx"):  # the same archive gives the same bytes, so a second attempt may replace the first
            system.move(f"{mine}.{kind}", f"{to}/{name}.{kind}")
        return pa.table({"archive": [name], "records": pa.array([len(entries)], pa.int64()), "bytes": pa.array([at], pa.int64())})

    return plan.select("archive", "seq", "refers_to").repartition(tasks, "archive").groupBy("archive").applyInArrow(rewrite, "archive string, records long, bytes long")


def read_index(folder: str, archive: str) -> np.ndarray:
    system, root = _system(folder)
    with system.open_input_stream(f"{root}/{archive}.idx", compression=None) as f:
        return np.frombuffer(f.read(), INDEX)


def read_record(folder: str, archive: str, offset: int, length: int) -> Record:
    """The record whose member lies at this place of an archive, without reading anything else."""
    system, root = _system(folder)
    with system.open_input_file(f"{root}/{archive}.warc.gz") as f:
        return next(parsed(iter([zlib.decompress(f.read_at(length, offset), 31)])))


def described(record: Record) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and refers_to as the record itself tells them; a payload must have its digest."""
    head, _, payload = record.block.partition(b"\r\n\r\n")
    size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest, kind = record.fields["warc-payload-digest"].removeprefix("sha1:"), record.fields["warc-type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {record.fields.get('warc-record-id')}: the payload is not the one of its digest")
    page, refers = record.fields.get("x-page-id"), record.fields.get("x-refers-to-page-id")
    return None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)


def read_archives(archives: DataFrame, folder: str, tasks: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset, length of every record, member by
    member as the indexes tell; archives are dealt to so many tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                index = read_index(folder, name)
                with system.open_input_stream(f"{root}/{name}.warc.gz", compression=None) as f:
                    for k in range(0, len(index), 1024):
                        part = index[k : k + 1024]
                        rows = []
                        for e in part:
                            raw = f.read(int(e["length"]))
                            rows.append(described(next(parsed(iter([zlib.decompress(raw, 31)])))))
                        page, size, digest, kind, refers = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "page_id": pa.array(page, pa.int64()), "payload_bytes": pa.array(size, pa.int64()), "payload_digest": pa.array(digest, pa.string()),
                                "record_type": pa.array(kind, pa.string()), "refers_to": pa.array(refers, pa.int64()), "archive": pa.array([name] * len(part), pa.string()),
                                "offset": pa.array(part["offset"].astype(np.int64)), "length": pa.array(part["length"].astype(np.int64)),
                            }
                        )

    return archives.select("archive").repartition(tasks).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long")


def warc(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes pages as monolithic archives, normalises these and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, and the archive, offset and length of each record.

    Null html is an empty payload, a null url leaves the target out, blanks in a url are left out of it. Rows that repeat
    a page_id are records each; those with the largest page_id of a payload are all responses. A null page_id is smaller
    than any other and no record refers to it: payloads that only such rows have are responses. An empty table gives no
    archive and no row. Other columns are ignored. A page's html is held whole in its task, more than that is not.

    The archives and their indexes stay in the folder (by default in spark.checkpoint.dir): they are the product, and the
    list of them (a row an archive) stays, too, as the result is read from it. The monolithic archives go.
    """
    spark: SparkSession = pages.sparkSession
    folder, source = folder or new_path(spark, "warc"), new_path(spark, "monoliths")
    written = Table(write_archives(pages, source), "written")
    n = written.df.select("archive").distinct().count()
    done = Table(normalise(decisions(written.df, least), source, folder, min(2 * n + 1, TASKS)), "archives")
    remove(spark, source)
    written.drop()
    return read_archives(done.df, folder, min(n + 1, TASKS))
