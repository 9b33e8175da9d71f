"""Operator 7: a support vector machine on a gap-weighted subsequence kernel with Nystrom landmarks.

The kernel of two words sums, over all common subsequences of three bytes, decay ** (the length they span in either
word), normalised to 1 for equal words; gaps and inserted characters only lower it. Landmarks are words that tell the
labels apart. A sentence is the sum of its words' Nystrom features; kernels under a threshold count as 0, so only the
few words near a landmark are computed with. The machine is trained on the sentences of labelled documents, then the
sentence margins of a document are calibrated to one score.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgrid.llm.minhash import shingles
from polisgrid.llm.shared import Table, fitting
from polisgrid.llm.textcore import LOWER, SPACE, Memo, hash_runs, mix, ragged, text_slices, words

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[48:58] = True
_LETTER[128:] = True
_WINDOW = 32


@dataclasses.dataclass(frozen=True)
class Plan:
    documents: int = 12_000  # labelled documents to learn from, at most: the smallest by hash
    bytes: int = 64 << 20  # of their texts, at most: what would exceed it is passed over
    held: int = 3  # toxic documents that hold a landmark, at least
    evidence: float = 2.6  # standard errors of its log odds
    cover: int = 4  # landmarks that a toxic document holds before further words are left out
    alike: float = 0.8  # kernel with an earlier landmark from which on a word is none of its own
    decay: float = 0.6
    near: float = 0.35  # kernels below count as 0
    folds: int = 4
    test_fold: int = 2
    threshold: float = 0.3
    rounds: int = 50  # of Newton's method, at most
    penalty: float = 1e-3


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    out = LOWER[data]
    if len(out) > 1:
        tail = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][tail] += 0x20
    return out


def units(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lens, document, sentence) of the words to compare, in order: words without what is no letter in
    them; windows of long words; runs of three or more single letters joined to one more word."""
    stops = np.cumsum(_STOP[low])  # a sentence ends at . ! ? or a line feed
    keep = _LETTER[low] | SPACE[low]
    total = np.append(0, np.cumsum(keep))
    low, offsets, stops = low[keep], total[offsets], stops[keep]
    starts, lens, before = words(low, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    sentence = stops[starts] if len(starts) else np.zeros(0, np.int64)
    data = low
    single = lens == 1
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
        joined, place, owner, size, said = [], [], [], [], []
        at = len(low)
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            for d in np.unique(doc[s:e]) if doc[s] != doc[e - 1] else [doc[s]]:
                own = np.arange(s, e)[doc[s:e] == d]
                if len(own) >= 3:
                    joined.append(low[starts[own]])
                    place.append(at)
                    owner.append(d)
                    size.append(len(own))
                    said.append(sentence[own[0]])
                    at += len(own)
        if joined:
            data = np.concatenate([low, *joined])
            starts, lens, doc, sentence = np.append(starts, place), np.append(lens, size), np.append(doc, owner), np.append(sentence, said)
    long = lens > _WINDOW
    if long.any():
        pieces = [(s + k, min(_WINDOW, n - k), d, x) for s, n, d, x in zip(starts[long].tolist(), lens[long].tolist(), doc[long].tolist(), sentence[long].tolist(), strict=True) for k in range(0, max(1, n - _WINDOW // 2), _WINDOW // 2)]
        more = np.array(pieces, np.int64).reshape(-1, 4)
        starts, lens, doc, sentence = (np.append(v[~long], more[:, k]) for k, v in enumerate((starts, lens, doc, sentence)))
    order = np.lexsort((starts, doc))
    return data, starts[order], lens[order], doc[order], sentence[order]


def _table(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int, pad: int) -> np.ndarray:
    out = np.full((len(starts), width), pad, np.int16)
    out[np.arange(width) < lens[:, None]] = ragged(data, starts, lens)
    return out


def kernel(s: np.ndarray, t: np.ndarray, decay: float) -> np.ndarray:
    """The kernel of order 3 of each row of s with the same row of t (int16, padded with -1 and -2)."""
    rows, n, m = len(s), s.shape[1], t.shape[1]
    same = (s[:, :, None] == t[:, None, :]).astype(np.float32)
    prior = np.ones((rows, n + 1, m + 1), np.float32)
    for order in range(3):
        if order == 2:
            return decay**2 * (same * prior[:, :-1, :-1]).sum((1, 2))
        fresh = np.zeros_like(prior)
        inner = np.zeros((rows, n + 1, m + 1), np.float32)
        hit = same * prior[:, :-1, :-1] * np.float32(decay**2)
        for j in range(m):
            inner[:, 1:, j + 1] = decay * inner[:, 1:, j] + hit[:, :, j]
        for i in range(n):
            fresh[:, i + 1] = decay * fresh[:, i] + inner[:, i + 1]
        prior = fresh
    raise AssertionError


def _own(table: np.ndarray, decay: float) -> np.ndarray:
    other = table.copy()
    other[other == -1] = -2
    return kernel(table, other, decay)


class Landmarks:
    def __init__(self, found: list[bytes], plan: Plan):
        self.plan, self.found = plan, found
        lens = np.array([len(x) for x in found])
        data = np.frombuffer(b"".join(found), np.uint8)
        starts = np.cumsum(lens) - lens
        self.tables = [_table(data, starts[k : k + 1], lens[k : k + 1], int(lens[k]), -2) for k in range(len(found))]
        self.own = np.array([float(kernel(np.where(t == -2, -1, t), t, plan.decay)[0]) for t in self.tables])
        self.masks = _masks(data, starts, lens, 1)
        self.need = (np.bitwise_count(self.masks).sum(1) + 1) // 2  # half of the adjacent pairs, at most two bytes apart
        self.memo = Memo(np.dtype(np.float32), most=1 << 20)
        full = np.zeros((len(found), len(found)))
        pool, counts = self.near(data, starts, lens)
        full[np.repeat(np.arange(len(found)), counts), pool.astype(int)] = (pool % 1) / 0.999
        values, vectors = np.linalg.eigh((full + full.T) / 2 + 1e-3 * np.eye(len(found)))
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T

    def near(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word the landmarks whose kernel reaches the threshold, as number + 0.999 * kernel, and their count."""
        plan = self.plan
        masks = _masks(data, starts, lens)
        picked, which, value = [], [], []
        norms = np.zeros(len(starts), np.float32)
        rows_of = [np.flatnonzero((np.bitwise_count(masks & self.masks[k]).sum(1) >= self.need[k]) & (lens >= 3)) for k in range(len(self.tables))]
        some = np.unique(np.concatenate(rows_of)) if rows_of else np.zeros(0, np.int64)
        for part, table in _batches(data, starts, lens, some):
            norms[part] = np.sqrt(_own(table, plan.decay))
        for k, other in enumerate(self.tables):
            for part, table in _batches(data, starts, lens, rows_of[k]):
                raw = kernel(table, np.broadcast_to(other, (len(part), other.shape[1])), plan.decay)
                got = raw / (np.sqrt(self.own[k]) * np.maximum(norms[part], 1e-9))
                ok = got >= plan.near
                picked.append(part[ok])
                which.append(np.full(int(ok.sum()), k))
                value.append(np.minimum(got[ok], 1))
        if not picked:
            return np.zeros(0, np.float32), np.zeros(len(starts), np.int64)
        picked, which, value = np.concatenate(picked), np.concatenate(which), np.concatenate(value)
        order = np.argsort(picked, kind="stable")
        return (which + 0.999 * value)[order].astype(np.float32), np.bincount(picked, minlength=len(starts))

    def sparse(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentence, landmark and kernel of each word near a landmark, the sentences' documents, and the number of words
        of every document."""
        data, starts, lens, doc, sentence = units(low, offsets)
        totals = np.bincount(doc, minlength=len(offsets) - 1)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64), totals
        rows = self.memo.look(hash_runs(data, starts, lens), lambda at: self.near(data, starts[at], lens[at]))
        counts = self.memo.lens[rows]
        hit = np.flatnonzero(counts)
        values = ragged(self.memo.pool, self.memo.starts[rows[hit]], counts[hit])
        key, back = np.unique(np.column_stack([doc[hit], sentence[hit]]), axis=0, return_inverse=True)
        return np.repeat(back.reshape(-1), counts[hit]).astype(np.int32), values.astype(np.int32), (values % 1) / np.float32(0.999), key[:, 0], totals

    def dense(self, row: np.ndarray, mark: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.found)))
        np.add.at(out, (row, mark), value)
        return out @ self.root

    def sentences(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the sentences that have any, their documents, and the number of words of every document."""
        row, mark, value, doc, totals = self.sparse(low, offsets)
        return self.dense(row, mark, value, len(doc)), doc, totals


_STOP = np.zeros(256, np.int64)
_STOP[[10, 33, 46, 63]] = 1


def _masks(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, reach: int = 3) -> np.ndarray:
    """256 bits of each word: the hashed pairs of bytes at most so far apart."""
    out = np.zeros((len(starts), 4), np.uint64)
    if not len(starts):
        return out
    flat = ragged(data, starts, lens).astype(np.int64)
    begin = np.cumsum(lens) - lens
    left = np.repeat(begin + lens, lens) - np.arange(len(flat))  # bytes to the word's end
    for gap in range(1, reach + 1):
        code = np.zeros(len(flat), np.int64)
        code[:-gap] = (flat[:-gap] * 37 + flat[gap:] * 11) & 255
        bit = np.where(left > gap, np.uint64(1) << (code & 63).astype(np.uint64), np.uint64(0))
        for k in range(4):
            out[:, k] |= np.bitwise_or.reduceat(np.where(code >> 6 == k, bit, np.uint64(0)), begin)
    return out


def _batches(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows in batches of like length, and their bytes padded with -1."""
    rows = rows[np.argsort(lens[rows], kind="stable")]
    for at in range(0, len(rows), 512):
        part = rows[at : at + 512]
        yield part, _table(data, starts[part], lens[part], int(lens[part].max()), -1)


def tally(low: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Per distinct word of four letters or more: its hash, the documents of label 0 that hold it, and an example's spelling;
    and pairs (word number, document) of those of label 1."""
    data, starts, lens, doc, _ = units(low, offsets)
    ok = lens >= 4
    starts, lens, doc = starts[ok], lens[ok], doc[ok]
    hashes = hash_runs(data, starts, lens)
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    new = np.append(np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
    h, d, first = h[new], d[new], order[new]
    own, at, back = np.unique(h, return_index=True, return_inverse=True)
    toxic = labels[d] == 1
    raw = data.tobytes()
    spelled = [raw[starts[k] : starts[k] + lens[k]] for k in first[at].tolist()]
    return own, np.bincount(back, ~toxic, len(own)).astype(np.int64), back[toxic], d[toxic], spelled


def kin(low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number of each document that near copies mostly share: of two least hashes of its shingles. A word that only one
    text and its copies hold is thus evidence once."""
    sets, counts = shingles(low, offsets)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        with np.errstate(over="ignore"):
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                out[full] = mix(out[full] * np.uint64(31) + np.minimum.reduceat(mix(sets ^ np.uint64(salt)), starts))
    return out.view(np.int64)


def pick(found: list[tuple[bytes, int, int, list[int]]], n1: int, n0: int, plan: Plan) -> list[bytes]:
    """Landmarks from (word, texts of label 1 and documents of label 0 with it, those of label 1 by number), best first, each
    unlike those before it.

    A word is taken if some toxic document that holds it has few landmarks yet, so that the words of a language with few
    documents are among them, while the many words that a group of like documents shares are not.
    """
    rated = sorted(((-float(evidence(p, n, n1, n0)), w, docs) for w, p, n, docs in found if p >= plan.held and p > n), key=lambda x: x[:2])
    depth: dict[int, int] = {}
    useful = []
    for gain, word, docs in rated:
        if -gain >= plan.evidence and any(depth.get(d, 0) < plan.cover for d in docs):
            for d in docs:
                depth[d] = depth.get(d, 0) + 1
            useful.append(word)
    return _unlike(useful, plan) or [b"----"]


def evidence(pos, neg, n1: int, n0: int):
    """Log odds of the labels in documents with a word, in standard errors."""
    return (np.log((pos + 0.5) / max(1, n1)) - np.log((neg + 0.5) / max(1, n0))) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def _unlike(words: list[bytes], plan: Plan) -> list[bytes]:
    """The words whose kernel with all words taken before them is below plan.alike."""
    out: list[bytes] = []
    table, norms = np.full((len(words), _WINDOW), -2, np.int16), np.zeros(len(words))
    for word in words:
        own = np.frombuffer(word[:_WINDOW], np.uint8).astype(np.int16)[None]
        mine, n = float(kernel(own, own, plan.decay)[0]), len(out)
        wide = int((table[:n] >= 0).sum(1).max(initial=0))
        if n and (kernel(np.broadcast_to(own, (n, own.shape[1])), table[:n, :wide], plan.decay) / np.sqrt(mine * norms[:n])).max() >= plan.alike:
            continue
        table[n, : own.shape[1]], norms[n] = own[0], mine
        out.append(word)
    return out


def _summary(margins: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Per document: largest margin, sum of positive ones, that sum by the root of its words, whether any."""
    n = len(totals)
    most, total = np.full(n, -1.0), np.zeros(n)
    np.maximum.at(most, doc, np.clip(margins, -1, 4))
    np.add.at(total, doc, np.maximum(margins, 0))
    return np.column_stack([most, np.log1p(total), total / np.sqrt(1 + totals), np.bincount(doc, minlength=n) > 0, np.ones(n)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(marks: Landmarks, parts: list[tuple], labels: np.ndarray, totals: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Sentence weights and document weights. parts: (sentence, landmark, kernel) of words near a landmark and the
    documents of the sentences, some documents at a time; dense features are made only for one part."""
    wide = len(marks.found) + 1
    weights = np.zeros(wide)
    doc = np.concatenate([p[3] for p in parts])
    n1 = int((labels[doc] == 1).sum())
    share = {1: 0.5 / max(1, n1), 0: 0.5 / max(1, len(doc) - n1)}
    ridge = np.diag(np.append(np.full(wide - 1, plan.penalty), 1e-9))
    for _ in range(plan.rounds if len(doc) else 0):  # of the squared hinge loss
        square, right = ridge.copy(), np.zeros(wide)
        for row, mark, value, own in parts:
            x = np.column_stack([marks.dense(row, mark, value, len(own)), np.ones(len(own))])
            side = labels[own]
            sign = np.where(side == 1, 1.0, -1.0)
            on = sign * (x @ weights) < 1
            x, each = x[on], np.where(side == 1, share[1], share[0])[on]
            square += (x * each[:, None]).T @ x
            right += x.T @ (each * sign[on])
        before, weights = weights, np.linalg.solve(square, right)
        if np.abs(weights - before).max() < 1e-7:
            break
    margins = np.concatenate([marks.dense(row, mark, value, len(own)) @ weights[:-1] for row, mark, value, own in parts]) + weights[-1]
    return weights, logistic(_summary(margins, doc, totals), labels.astype(float))


def learn(sample: DataFrame, plan: Plan) -> tuple[Landmarks, np.ndarray, np.ndarray] | float:
    """Landmarks, sentence weights and document weights from rows (n, kin, text, toxic), n being distinct; the share of label
    1 if there is only one label. Words are counted and compared in the tasks, each distinct word once; the driver gets
    the words of some evidence, and of each document the few words near a landmark."""
    sizes = {r[0]: (r[1], r[2]) for r in sample.groupBy("toxic").agg(F.count("*"), F.count_distinct("kin")).collect()}
    if len(sizes) < 2:
        return float(1 in sizes)
    n1, n0 = sizes[1][1], sizes[0][0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                hashes, neg, word, doc, spelled = tally(lowered(data), offsets, rows.column(2).to_numpy())
                order = np.argsort(word, kind="stable")
                docs = rows.column(0).to_numpy()[doc[order]]
                ends = np.append(0, np.cumsum(np.bincount(word, minlength=len(hashes))))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(docs))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(neg), lists, pa.array(spelled, pa.binary())], names=["h", "neg", "docs", "word"])

    words_ = sample.select("kin", "text", "toxic").mapInArrow(count, "h long, neg long, docs array<long>, word binary")
    words_ = words_.groupBy("h").agg(F.sum("neg").alias("neg"), F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"), F.max("word").alias("word"))
    words_ = words_.withColumn("pos", F.size("docs"))
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    gain = (F.log(p / n1) - F.log(q / n0)) / F.sqrt(1 / p + 1 / q)
    words_ = words_.where((F.col("pos") >= plan.held) & (F.col("pos") > F.col("neg")) & (gain >= plan.evidence - 1e-6))
    found = sorted((bytes(r["word"]), r["pos"], r["neg"], sorted(r["docs"])) for r in words_.collect())
    marks = Landmarks(pick(found, n1, n0, plan), plan)
    spelled = tuple(marks.found)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _landmarks(spelled, plan)
        for batch in batches:
            words_of = batch.column(1).to_pylist()
            if not words_of:
                continue
            lens = np.array([len(x) for x in words_of])
            pool, counts = own.near(np.frombuffer(b"".join(words_of), np.uint8), np.cumsum(lens) - lens, lens)
            on = np.flatnonzero(counts)
            ends = np.append(0, np.cumsum(counts))
            lists = [pool[ends[k] : ends[k + 1]].astype("<f4").tobytes() for k in on]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on)), pa.array(lists, pa.binary())], names=["h", "near"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch, "text"):
                flat, starts, lens, _, _ = units(lowered(data), offsets)
                h, first = np.unique(hash_runs(flat, starts, lens), return_index=True)
                raw = flat.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([raw[starts[k] : starts[k] + lens[k]] for k in first.tolist()], pa.binary())], names=["h", "word"])

    vocabulary = sample.select("text").mapInArrow(distinct, "h long, word binary").groupBy("h").agg(F.min("word").alias("word"))
    held = vocabulary.mapInArrow(near, "h long, near binary").collect()  # words of the bounded sample that are near a landmark
    hashes = np.array([r["h"] for r in held], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    lists = [np.frombuffer(held[k]["near"], "<f4") for k in order]
    known = sample.sparkSession.sparkContext.broadcast((hashes[order], np.concatenate([np.zeros(0, "<f4"), *lists]), np.array([len(x) for x in lists], np.int64)))
    del held, lists

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pool, counts = known.value
        starts_of = np.cumsum(counts) - counts
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                flat, starts, lens, doc, sentence = units(lowered(data), offsets)
                n = len(offsets) - 1
                h = hash_runs(flat, starts, lens)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = np.flatnonzero(keys[at] == h) if len(keys) else np.zeros(0, np.int64)
                spot = at[hit]
                own = ragged(pool, starts_of[spot], counts[spot])
                key, back = np.unique(np.column_stack([doc[hit], sentence[hit]]), axis=0, return_inverse=True)
                first = np.searchsorted(key[:, 0], np.arange(n + 1))
                row = (np.repeat(back.reshape(-1), counts[spot]) - np.repeat(first[doc[hit]], counts[spot])).astype("<i4")
                cut = np.searchsorted(np.repeat(doc[hit], counts[spot]), np.arange(n + 1))
                lists = [pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (row, own.astype("<f4"))]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.bincount(doc, minlength=n)), pa.array(np.diff(first)), *lists], names=["n", "toxic", "words", "sentences", "row", "near"])

    rows = sample.select("n", "text", "toxic").mapInArrow(sentences, "n long, toxic int, words long, sentences long, row binary, near binary").orderBy("n").collect()
    parts = []
    labels, totals = (np.array([r[c] for r in rows], np.int64) for c in ("toxic", "words"))
    for at in range(0, len(rows), 100):
        some = rows[at : at + 100]
        before = np.cumsum([0, *(r["sentences"] for r in some)])
        row = np.concatenate([np.frombuffer(r["row"], "<i4") + np.int32(b) for r, b in zip(some, before, strict=False)])
        values = np.concatenate([np.frombuffer(r["near"], "<f4") for r in some])
        parts.append((row, values.astype(np.int16), (values % 1) / np.float32(0.999), np.repeat(at + np.arange(len(some), dtype=np.int32), np.diff(before))))
    del rows
    return marks, *fit(marks, parts, labels, totals, plan)


def _with_kin(sample: DataFrame) -> DataFrame:
    """n, text, toxic and kin of a sample; a text without words is its own kin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                found = kin(lowered(data), offsets)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.where(found == 0, rows.column(0).to_numpy(), found))], names=["n", "text", "toxic", "kin"])

    return sample.mapInArrow(run, "n long, text string, toxic int, kin long")


def crc_fold(column: str, folds: int):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def toxicity(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, score, predicted of every row of doc_id, text.

    labels has doc_id and toxic (0 or 1; other values and nulls are left out; a document labelled twice counts
    twice). Null and empty texts get the score of a text without any word; texts of any length are taken whole. Without
    labels of both kinds all scores are 1 or 0, the share of label 1. Empty table: no row. Repeated rows give repeated
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(crc_fold("doc_id", plan.folds) != plan.test_fold)
    # Bounded by plan.documents; the hash spreads the draw over all.
    drawn = own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(plan.documents)
    known = fitting(rows.join(F.broadcast(drawn), "doc_id"), plan.bytes)
    model, share = None, 0.0
    if known is not None:
        sample = Table(_with_kin(known.select(F.monotonically_increasing_id().alias("n"), "text", "toxic")), "sample")
        made = learn(sample.df, plan)
        sample.drop()
        if isinstance(made, float):
            share = made
        else:
            model = spark.sparkContext.broadcast((made[0].found, *made[1:]))  # landmarks and weights only
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None and "marks" not in state:
            state["marks"] = _landmarks(tuple(model.value[0]), plan)
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                n = len(offsets) - 1
                if model is None:
                    score = np.full(n, share)
                else:
                    x, doc, totals = state["marks"].sentences(lowered(data), offsets)
                    _, weights, last = model.value
                    shape = _summary(x @ weights[:-1] + weights[-1], doc, totals)
                    score = 1 / (1 + np.exp(-np.clip(shape @ last, -30, 30)))
                code = np.array([0 if i is None else zlib.crc32(str(i).encode()) for i in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(code % plan.folds == plan.test_fold), pa.array(score), pa.array((score >= plan.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


_MADE: dict = {}


def _landmarks(found: tuple[bytes, ...], plan: Plan) -> Landmarks:
    """Kept in a worker over tasks."""
    if (found, plan) not in _MADE:
        _MADE.clear()
        _MADE[found, plan] = Landmarks(list(found), plan)
    return _MADE[found, plan]
