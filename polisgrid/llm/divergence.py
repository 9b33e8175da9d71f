"""Operator 11: how the sources of a language differ in their terms.

Terms are found with a table of bytes over whole buffers of texts, grouped by xxhash and then byte by byte, and counted
as sparse rows (documents by terms) whose runs are summed with reduceat. The divergences of a language are computed from
sparse rows (sources by terms), a block of terms at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polisgrid.llm.shared import Table
from polisgrid.llm.textcore import LOWER, distinct_of, ragged, text_slices

#: A term is kept in a language from so many of its documents on; ranks of terms in the result; smoothing; scale of shares.
LEAST_DOCUMENTS, MOST_TERMS, PRIOR, SCALE = 30, 50, 5, 10**9
#: Bytes that terms consist of: ASCII letters and all bytes of other characters.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
_SLICE = 4 << 20
#: Counts (source, term) in a block, unless the pairs of its sources are more than a quarter of that.
_BLOCK = 1 << 13

#: Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_MASK8 = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def xxh64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each slice: short ones all at once, those of 32 bytes or more by the library."""
    window = _windows(data)
    with np.errstate(over="ignore"):
        h = _P5 + lens.astype(np.uint64)
        short = np.flatnonzero(lens < 32)
        on, at = short[lens[short] >= 8], 0
        while len(on):
            h[on] = _rotated(h[on] ^ (_rotated(window[starts[on] + at] * _P2, 31) * _P1), 27) * _P1 + _P4
            at += 8
            on = on[lens[on] >= at + 8]
        place = lens & ~7
        on = short[(lens[short] & 4) > 0]
        h[on] = _rotated(h[on] ^ ((window[starts[on] + place[on]] & _MASK8[4]) * _P1), 23) * _P2 + _P3
        place = lens & ~3
        for k in range(3):
            on = short[(lens[short] & 3) > k]
            h[on] = _rotated(h[on] ^ (data[starts[on] + place[on] + k].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    for k in np.flatnonzero(lens >= 32):
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + lens[k]])
    return h


def _differing(window: np.ndarray, starts: np.ndarray, lens: np.ndarray, on: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Those of the slices `on` whose bytes aren't those of the slices `to`."""
    wrong = lens[on] != lens[to]
    at, rest = 0, np.flatnonzero(~wrong)
    while len(rest):
        a, b = on[rest], to[rest]
        mask = _MASK8[np.minimum(lens[a] - at, 8)]
        wrong[rest] = (window[starts[a] + at] ^ window[starts[b] + at]) & mask != 0
        at += 8
        rest = rest[(lens[a] > at) & ~wrong[rest]]
    return on[wrong]


def grouped(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: Callable = xxh64) -> tuple[np.ndarray, np.ndarray]:
    """An example of each distinct slice, and the number of each slice's distinct one. Slices of one hash are compared byte
    by byte; those that differ from their example form groups of their own."""
    _, first, back = distinct_of(hashes(data, starts, lens))
    window, on = _windows(data), np.arange(len(starts))
    while len(on := _differing(window, starts, lens, on, first[back[on]])):
        _, at, again = distinct_of(back[on].astype(np.uint64))
        back[on] = len(first) + again
        first = np.append(first, on[at])
    return first, back


def term_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each term of lowered data, and its document."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = TERM[data]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut + 1]]  # a term ends where its document does
    begins[cut] = ends[cut] = True
    starts = np.flatnonzero(begins[:-1])
    return starts, np.flatnonzero(ends) - starts, np.searchsorted(offsets, starts, "right") - 1


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))


def count_slice(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """group, term, occurrences and documents of each term of each group; groups has a number for each document."""
    data = LOWER[data]
    starts, lens, docs = term_slices(data, offsets)
    first, term = grouped(data, starts, lens)
    n = max(len(first), 1)
    # Rows of documents in the order of their groups: columns ascend inside a row, values count the occurrences.
    place = np.empty(len(groups), np.int64)
    place[order := np.argsort(groups, kind="stable")] = np.arange(len(groups))
    cells = np.sort(place[docs] * n + term)
    at = _runs(cells)
    row, column, value = cells[at] // n, cells[at] % n, np.diff(np.append(at, len(cells)))
    # The rows of a group are summed column by column.
    key = groups[order][row] * n + column
    by = np.argsort(key, kind="stable")
    at = _runs(key[by])
    total = np.add.reduceat(value[by], at) if len(at) else np.zeros(0, np.int64)
    with_it = np.diff(np.append(at, len(by)))
    group, column = key[by][at] // n, key[by][at] % n
    return group, _binary(data, starts[first][column], lens[first][column]), total, with_it


def _binary(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(lens)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ragged(data, starts, lens)))])


def _pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in pieces that end where no term is cut."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data):
            stop = np.flatnonzero(~TERM[data[end : end + most]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(end + most, len(data))
        yield data[at:end]
        at = end


_COUNTS = "lang string, source string, term binary, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        width = max(len(source.dictionary), 1)
        code = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()

        def out(group: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            names = [x.dictionary.take(pa.array(k)) for x, k in ((lang, group // width), (source, group % width))]  # noqa: B023
            return pa.RecordBatch.from_arrays([*names, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

        seen = np.unique(code)  # groups without terms count, too
        yield out(seen, pa.nulls(len(seen), pa.binary()), np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64))
        at = 0
        for rows, data, offsets in text_slices(batch, "text", _SLICE):
            groups = code[at : at + rows.num_rows]
            at += rows.num_rows
            if rows.num_rows > 1 or len(data) <= _SLICE:
                yield out(*count_slice(data, offsets, groups))
                continue
            held: set[bytes] = set()
            for piece in _pieces(data, _SLICE):
                group, term, n, _ = count_slice(piece, np.array([0, len(piece)]), groups)
                held.update(term.to_pylist())
                yield out(group, term, n, np.zeros(len(n), np.int64))
            own = pa.array(sorted(held), pa.binary())
            yield out(np.full(len(own), groups[0]), own, np.zeros(len(own), np.int64), np.ones(len(own), np.int64))


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, head of every kept term that a source has, and one row without term for each source that
    occurs; head marks one row of each term of a language."""
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, _COUNTS)
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = Window.partitionBy("lang", "term")  # at most one row a source
    found = summed.select("*", F.sum("docs").over(one).alias("all"), F.row_number().over(one.orderBy("source")).alias("k"))
    return found.where(F.col("term").isNull() | (F.col("all") >= least)).select("lang", "source", "term", "n", (F.col("term").isNotNull() & (F.col("k") == 1)).alias("head"))


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact: three digits at a time."""
    rest, of = count.astype(np.int64) + PRIOR, np.asarray(total, np.int64) + PRIOR * terms
    out = rest // of
    rest = rest % of
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // of, rest % of
    return out + 1


def pair_sums(p0: np.ndarray, indptr: np.ndarray, columns: np.ndarray, p: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of sparse rows: a, and for each row b > a the sum over all columns of abs(p[a] - p[b]); p0 are the rows' shares in
    columns that they lack."""
    full = np.flatnonzero(np.diff(indptr))
    for a in range(len(p0) - 1):
        own = np.full(width, p0[a])
        own[columns[indptr[a] : indptr[a + 1]]] = p[indptr[a] : indptr[a + 1]]
        ordered = np.sort(own)
        before = np.append(0, np.cumsum(ordered))
        k = np.searchsorted(ordered, p0)
        out = p0 * k - before[k] + before[-1] - before[k] - p0 * (width - k)  # as if each row lacked all columns
        begin = indptr[a + 1]
        rows = full[full > a]
        if len(rows):
            base = own[columns[begin:]]
            lacking = np.repeat(p0[a + 1 :], np.diff(indptr[a + 1 :]))
            out[rows] += np.add.reduceat(np.abs(p[begin:] - base) - np.abs(lacking - base), indptr[rows] - begin)
        yield a, out[a + 1 :]


_PARTS = "lang string, part string, source string, item binary, value long"
_PARTS_ARROW = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.binary()), ("value", pa.int64())])


def _diverge(key: tuple, counts: pa.Table, totals: pa.Table) -> pa.Table:
    """Sums over a block of terms for each pair of sources, and the block's first terms of each source."""
    return pa.Table.from_batches(list(_block_parts(key, counts, totals)), _PARTS_ARROW)


def _block_parts(key: tuple, counts: pa.Table, totals: pa.Table) -> Iterator[pa.RecordBatch]:
    lang = key[0].as_py()
    totals = totals.sort_by("source")
    names, total, terms = totals.column("source").combine_chunks(), totals.column("total").to_numpy(), totals.column("terms")[0].as_py()
    encoded = counts.column("term").combine_chunks().dictionary_encode()
    vocabulary = encoded.dictionary
    rank = np.empty(len(vocabulary), np.int64)
    rank[pc.sort_indices(vocabulary).to_numpy()] = np.arange(len(vocabulary))
    source = pc.index_in(counts.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    column, n = rank[encoded.indices.to_numpy()], counts.column("n").to_numpy()
    order = np.lexsort((column, source))
    source, column, n = source[order], column[order], n[order]
    indptr = np.searchsorted(source, np.arange(len(names) + 1))

    def out(part: str, who: np.ndarray, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array([part] * len(value), pa.string()), names.take(pa.array(who)), item, pa.array(value, pa.int64())], schema=_PARTS_ARROW)

    width = len(vocabulary)
    p0, p = np.zeros(len(names), np.int64), np.zeros(len(n), np.int64)
    if width:
        p0, p = share(np.zeros(len(names)), total, terms), share(n, total[source], terms)
        by_column = np.argsort(column, kind="stable")
        q = share(np.add.reduceat(n[by_column], _runs(column[by_column])), total.sum(), terms)
        over = p - q[column]
        at = np.lexsort((column, -over, source))
        place = np.arange(len(at)) - indptr[source[at]]
        at = at[(over[at] > 0) & (place < MOST_TERMS)]
        if len(at):
            yield out("term", source[at], vocabulary.take(pc.sort_indices(vocabulary).take(pa.array(column[at]))), over[at])
    for a, sums in pair_sums(p0, indptr, column, p, width):
        yield out("pair", np.full(len(sums), a), names.take(pa.array(np.arange(a + 1, len(names)))).cast(pa.binary()), sums)


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of a language by their difference (part pair), and the
    terms that a source has more often than its language (part term).

    Null text, lang and source are empty. Repeated rows count as documents each, ties go by the item's bytes, a language
    without kept terms has pairs of value 0, one with one source has none. An empty table gives no row. Long texts are
    counted in pieces that cut no term; a term of several MB is held whole. Other columns are ignored.

    What is shuffled are counts of distinct terms of each task, never texts. A language's terms are dealt in blocks, so
    that no task holds a language; of each block go on the sums of its pairs of sources and the first terms of each.
    The sums and first terms of the blocks stay in spark.checkpoint.dir, as the result is read from them.
    """
    kept = Table(kept_counts(docs, least), "terms")
    sums = kept.df.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("head").cast("long")).alias("heads"), (F.count("*") - 1).alias("rows"))
    sized = Table(sums, "sources")  # a row a source, read three times

    def langs() -> DataFrame:
        size = F.greatest(F.lit(_BLOCK), 4 * F.col("sources") * F.col("sources"))
        by_lang = sized.df.groupBy("lang").agg(F.sum("heads").alias("terms"), F.sum("rows").alias("rows"), F.count("*").alias("sources"))
        return by_lang.select("lang", "terms", F.greatest(F.lit(1), F.ceil(F.col("rows") / size)).cast("int").alias("blocks"))

    counts = kept.df.where("term is not null").join(langs(), "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    totals = sized.df.join(langs(), "lang").select("lang", "source", "total", "terms", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    parts = Table(counts.groupBy("lang", "block").cogroup(totals.groupBy("lang", "block")).applyInArrow(_diverge, _PARTS), "parts")
    kept.drop()
    sized.drop()
    found = parts.df
    item = F.col("item").cast("string")
    half = found.where("part = 'pair'").groupBy("lang", "source", item.alias("item")).agg(F.sum("value").alias("value"))
    pairs = half.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = found.where("part = 'term'").select("lang", "source", "part", item.alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", ranked).union(terms.select("*", ranked).where(F.col("rank") <= MOST_TERMS))
