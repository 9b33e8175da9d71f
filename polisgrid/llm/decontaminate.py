"""Operator 9: benchmark passages in documents by q-gram lemma filtering and banded alignment.

Texts are lower-cased (ASCII and Latin-1) and white space becomes one blank. The windows of an item are all its
stretches of W characters (bytes), from every place on; a shorter item is one window. A region within k edits of a window
shares at least W + 1 - q - k * q of its q-grams, on diagonals that differ by k at most; so in one of the overlapping
bands of 2 * (k + 1) diagonals that many q-grams match. Such windows are verified by a banded alignment. One with d > k
edits rules out those that begin fewer than d - k places from it, as a shift by one place changes d by 1 at most. So
nothing within the edit budget is lost.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgrid.llm.shared import Table
from polisgrid.llm.textcore import SPACE, text_slices
from polisgrid.llm.toxicity import lowered


@dataclasses.dataclass(frozen=True)
class Plan:
    q: int = 8
    window: int = 120
    rate: float = 0.1  # edits a character
    least: int = 16  # items of fewer characters would match by chance: they are held only as a line of their own
    shard: int = 8 << 20  # bytes of benchmark text that are held at once


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, runs of white space as one blank."""
    if not len(data):
        return data, offsets
    white = SPACE[data]
    keep = ~white
    keep[1:] |= ~white[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    low = lowered(data)
    low[white] = 32
    total = np.append(0, np.cumsum(keep))
    return low[keep], total[offsets]


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number (places near the end run into zeros)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, strides=(1,)).copy()


class Index:
    """Items of like length, each with all its windows."""

    def __init__(self, windows: list[tuple[int, np.ndarray]], plan: Plan):
        self.plan = plan
        if plan.q != 8:
            raise ValueError("q-grams are packed in eight bytes")
        self.windows = windows
        whole = np.array([len(w) for _, w in self.windows], np.int64)
        size = np.minimum(whole, plan.window)
        self.last = whole - size  # where the last window begins
        self.size = size
        self.edits = np.minimum((size * plan.rate).astype(np.int64), (size - plan.q) // plan.q) if len(size) else size
        self.need = size + 1 - plan.q - plan.q * self.edits
        self.span = int((size + 2 * self.edits).max(initial=0)) + 1
        keys, owner, place = [], [], []
        for k, (_, w) in enumerate(self.windows):
            g = grams(w)[: len(w) - 7]
            keys.append(g)
            owner.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.bounds = np.append(first, len(every))
        self.owner = np.concatenate(owner)[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if keys else np.zeros(0, np.int64)
        self.shift = np.uint64(64 - min(27, max(16, int(8 * len(self.keys)).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.slot(_spread(self.keys))] = True
        self.data = np.concatenate([w for _, w in self.windows]).astype(np.int16) if keys else np.zeros(0, np.int16)
        self.starts = np.cumsum(whole) - whole
        self.most = int(whole.max()) if len(whole) else 0
        self.items = np.array([i for i, _ in self.windows], np.int64)

    def slot(self, spread: np.ndarray) -> np.ndarray:
        return (spread >> self.shift).astype(np.int64)

    def halves(self, data: np.ndarray, offsets: np.ndarray, g: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The search in two parts: of the documents, or of one text, whose parts overlap by the longest match."""
        n = len(offsets) - 1
        if n > 1:
            m, at = n // 2, int(offsets[n // 2])
            cuts = ((0, at, offsets[: m + 1], 0), (at, len(data), offsets[m:] - at, m))
        else:
            at = len(data) // 2
            cuts = ((0, at + self.span, np.array([0, at + self.span]), 0), (at, len(data), np.array([0, len(data) - at]), 0))
        found = [(doc + shift, item) for a, b, own, shift in cuts for doc, item in [self.search(data[a:b], own, g[a:b], spread[a:b])]]
        return tuple(np.concatenate([x[k] for x in found]) for k in (0, 1))

    def search(self, data: np.ndarray, offsets: np.ndarray, g: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs that match, from normalised texts, their q-grams and the hashes of these; items by their
        number in self.windows. Pairs may repeat."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.windows) or not len(data):
            return nothing
        hit = self.seen[self.slot(spread)]
        # A matching region holds at least the least need of q-grams within the longest span: elsewhere hits are stray.
        span = self.span
        total = np.append(0, np.cumsum(hit, dtype=np.int32))
        n = len(data)
        ahead = total[np.minimum(np.arange(n) + span, n)] - total[:-1]
        begin = np.flatnonzero((ahead >= int(self.need.min())) & hit)
        if not len(begin):
            return nothing
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, begin, 1)
        np.add.at(cover, np.minimum(begin + span, n), -1)
        at = np.flatnonzero(hit & (np.cumsum(cover[:-1]) > 0))
        spot = np.searchsorted(self.keys, g[at])
        spot[spot == len(self.keys)] = 0
        real = self.keys[spot] == g[at]
        at, spot = at[real], spot[real]
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 8 <= offsets[doc + 1]
        at, spot, doc = at[inside], spot[inside], doc[inside]
        count = self.bounds[spot + 1] - self.bounds[spot]
        ends = np.cumsum(count)
        if not len(ends):
            return nothing
        if ends[-1] > _EXPANDED and (len(offsets) > 2 or len(data) > 8 * span):
            return self.halves(data, offsets, g, spread)
        own, doc = np.unique(doc, return_inverse=True)  # documents with a hit, numbered anew
        offsets = np.column_stack([offsets[own], offsets[own + 1]])
        flat = np.arange(ends[-1]) + np.repeat(self.bounds[spot] - (ends - count), count)
        window, doc = self.owner[flat], np.repeat(doc, count)
        diagonal = np.repeat(at, count) - self.place[flat] - offsets[doc, 0] + self.most
        key = ((doc * len(self.windows) + window) << 24) + diagonal // (self.edits[window] + 1)
        order = np.lexsort((self.place[flat], key))
        key, place = key[order], self.place[flat][order]
        cells, first = np.unique(key, return_index=True)
        bounds = np.append(first, len(key))
        number = np.diff(bounds)
        beside = np.zeros(len(cells), np.int64)  # a band is a cell with the next one
        beside[:-1] = np.where(cells[1:] == cells[:-1] + 1, number[1:], 0)
        item = (cells >> 24) % len(self.windows)
        on = np.flatnonzero(number + beside >= self.need[item])
        band, begins, shared = [], [], []
        for k in on.tolist():
            inside = place[bounds[k] : bounds[k + 1] + beside[k]]
            w = item[k]
            # Windows by where they begin, and the q-grams that lie within each.
            total = np.append(0, np.cumsum(np.bincount(inside, minlength=self.last[w] + self.size[w])))
            at = np.arange(self.last[w] + 1)
            count = total[at + self.size[w] - 7] - total[at]
            good = np.flatnonzero(count >= self.need[w])
            band.append(np.full(len(good), len(begins)))
            begins.append(good)
            shared.append(count[good])
        if not begins:
            return nothing
        rows = np.column_stack([cells[on] >> 24, item[on], cells[on] & 0xFFFFFF])
        rows[:, 0] //= len(self.windows)
        pair = np.unique(rows[:, :2], axis=0, return_inverse=True)
        found = self.rounds(data, offsets, rows, np.concatenate(band), np.concatenate(begins), np.concatenate(shared), pair[1].reshape(-1), len(pair[0]))
        return own[pair[0][found, 0]], pair[0][found, 1]

    def rounds(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, band: np.ndarray, begins: np.ndarray, shared: np.ndarray, pair: np.ndarray, pairs: int) -> np.ndarray:
        """Which pairs have a window within its budget; in each round one window of every band that is open is verified."""
        found = np.zeros(pairs, bool)
        order = np.lexsort((-shared, band))  # the likeliest first
        band, begins = band[order], begins[order]
        while len(band):
            pick = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            own = rows[band[pick]]
            edits = self.verify(data, offsets, own, begins[pick])
            over = edits - self.edits[own[:, 1]]
            found[pair[band[pick]][over <= 0]] = True
            number = np.diff(np.append(pick, len(band)))
            far = np.abs(begins - np.repeat(begins[pick], number)) >= np.repeat(over, number)
            left = far & ~found[pair[band]]
            band, begins = band[left], begins[left]
        return found

    def verify(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Edits of the window of each item that begins there, in the band of diagonals widened by the budget on both sides."""
        out = np.zeros(len(rows), np.int64)
        for at in range(0, len(rows), 2048):
            part = rows[at : at + 2048]
            window, k = part[:, 1], self.edits[part[:, 1]]
            begin = begins[at : at + 2048]
            low = offsets[part[:, 0], 0] - self.most + part[:, 2] * (k + 1) - k + begin  # the least diagonal
            width = 2 * (k + 1) + 2 * k
            most = int(width.max())
            column = np.arange(most)
            outside = column >= width[:, None]
            cost = np.where(outside, 10_000, 0).astype(np.int32)  # a match may begin on any diagonal
            size = self.size[window]
            best = np.full(len(part), 10_000)
            for i in range(int(size.max())):
                place = low[:, None] + column + i
                legal = (place >= offsets[part[:, 0], :1]) & (place < offsets[part[:, 0], 1:])
                letter = np.where(legal, data[np.clip(place, 0, len(data) - 1)], -1)
                same = letter == self.data[self.starts[window] + begin + np.minimum(i, size - 1)][:, None]
                step = cost + np.where(same, 0, 1)  # beyond the text this is a missing character, too
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # the window's character is missing
                step = np.minimum.accumulate(step - column, 1) + column  # characters too many in the text
                step[outside] = 10_000
                cost = np.where((i < size)[:, None], np.minimum(step, 10_000), cost)
                done = i == size - 1
                best[done] = cost[done].min(1)
            out[at : at + 2048] = best
        return out


def _spread(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return keys * np.uint64(0x9E3779B97F4A7C15)


_EXPANDED = 4 << 20  # q-gram matches that are held at once
_PIECE = 2 << 20  # bytes of a text that are searched at once


def trimmed(text: bytes) -> np.ndarray:
    """A normalised text without blanks at its ends."""
    raw = np.frombuffer(text, np.uint8)
    low, _ = normal(raw, np.array([0, len(raw)]))
    return np.frombuffer(low.tobytes().strip(b" "), np.uint8)


class Searcher:
    """Indexes of the items by length, so that a short item's few q-grams don't weaken the filter for the others."""

    def __init__(self, items: list[tuple[int, str]], plan: Plan):
        self.plan = plan
        groups: dict[int, list] = {}
        self.short: dict[bytes, list[int]] = {}  # by what a line must be
        for item, text in items:
            low = trimmed((text or "").encode())
            if len(low) >= plan.least:
                groups.setdefault(plan.window if len(low) >= plan.window else len(low).bit_length(), []).append((item, low))
            elif len(low):
                self.short.setdefault(low.tobytes(), []).append(item)
        self.indexes = [Index(own, plan) for own in groups.values()]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item id) pairs that match, each once, from texts as they are."""
        found = [self.lines(data, offsets)] if self.short else []
        low, at = normal(data, offsets)
        overlap = max((x.span for x in self.indexes), default=0)
        if len(offsets) == 2 and len(low) > _PIECE + overlap:
            for a in range(0, len(low), _PIECE):
                part = low[a : a + _PIECE + overlap]
                found += self.near(part, np.array([0, len(part)]))
        else:
            found += self.near(low, at)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.column_stack([np.concatenate([x[k] for x in found]) for k in (0, 1)]), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def near(self, low: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        g = grams(low)
        spread = _spread(g)
        out = []
        for index in self.indexes:
            doc, item = index.search(low, offsets, g, spread)
            out.append((doc, index.items[item]))
        return out

    def lines(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of too few characters for the search: held by documents that have them as a line of their own."""
        cut = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
        cut = cut[cut <= len(data)]
        dark = np.append(0, np.cumsum(~SPACE[data]))
        few = np.flatnonzero((dark[cut[1:]] > dark[cut[:-1]]) & (dark[cut[1:]] - dark[cut[:-1]] < self.plan.least))
        doc, item = [], []
        for k in few.tolist():
            for i in self.short.get(trimmed(data[cut[k] : cut[k + 1]].tobytes()).tobytes(), ()):
                doc.append(int(np.searchsorted(offsets, cut[k], "right")) - 1)
                item.append(i)
        return np.array(doc, np.int64), np.array(item, np.int64)


_MADE: dict = {}


def _searcher(items: tuple[tuple[int, str], ...], plan: Plan) -> Searcher:
    if (items, plan) not in _MADE:
        _MADE.clear()
        _MADE[items, plan] = Searcher(list(items), plan)
    return _MADE[items, plan]


def _passes(docs: DataFrame, benchmark: DataFrame, plan: Plan, judge, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs after judge(searcher, rows, data, offsets) of every part of the benchmark in turn; judge gives rows anew.

    A part has at most about plan.shard bytes of text; only then is it broadcast. With several parts the rows are stored
    between the passes, so one searcher is held at a time. The last pass leaves out the columns in drop.
    """
    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-2 * size // plan.shard)) if size > plan.shard // 2 else 1
    before = None
    for k in range(shards):
        part = own if shards == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        held = docs.sparkSession.sparkContext.broadcast(tuple(sorted({(r["item_id"], r["text"]) for r in part.collect()})))

        gone = drop if k == shards - 1 else ()

        def run(batches: Iterator[pa.RecordBatch], held=held, gone=gone) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(held.value, plan)
            for batch in batches:
                for rows, data, offsets in text_slices(batch, "text"):
                    yield judge(searcher, rows, data, offsets).drop_columns(list(gone))

        docs = docs.mapInArrow(run, T.StructType([f for f in docs.schema if f.name not in gone]))
        if k < shards - 1:
            now = Table(docs, "pass")
            if before is not None:
                before.drop()
            docs, before = now.df, now
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """doc_id, contaminated, n_items, item_ids (ascending) of every row of doc_id, text.

    benchmark has item_id and text; rows without one of them are left out. A document holds an item if some window of
    the item occurs in it within the edit budget, or, for items of fewer than plan.least characters, if one of its lines
    is the item. Null and empty texts hold none. Rows are judged one by one, at any size of the benchmark: repeated rows
    give repeated rows, and a null doc_id is as good as any. Texts of any length are searched whole, in overlapping
    pieces. Other columns are ignored. An empty benchmark finds nothing; an empty table gives no row. A benchmark over
    plan.shard / 2 bytes is searched in as many passes as needed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.array().cast("array<long>").alias("item_ids"))

    def judge(searcher: Searcher, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        doc, item = searcher.search(data, offsets)
        if not len(doc):
            return rows
        lists = rows.column(2).to_pylist()
        for d in np.unique(doc).tolist():
            lists[d] = sorted({*lists[d], *item[doc == d].tolist()})
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lists, rows.column(2).type)], schema=rows.schema)

    found = _passes(rows, benchmark, plan, judge, ("text",))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def clean(docs: DataFrame, benchmark: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """The rows whose text holds no benchmark item, with the same columns. Each row is judged by its own text, as in
    contamination, without a shuffle."""

    def judge(searcher: Searcher, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ok = np.ones(len(offsets) - 1, bool)
        ok[searcher.search(data, offsets)[0]] = False
        return rows.filter(pa.array(ok))

    return _passes(docs, benchmark, plan, judge)
