"""Operator 8: language of words by a linear-chain conditional random field, of texts by their words.

A word's potential is the sum of weights of its hashed character 2- to 4-grams (with marks at its ends, so affixes are
among them) and of the word itself as a lexicon entry. Transitions are learned too. Training sequences join pieces of
documents in different languages, so switching is seen; the pieces cover the whole of every drawn text. Marginals come from forward-backward over the whole text, in
segments whose transfer matrices are chained exactly.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgrid.llm.shared import fitting
from polisgrid.llm.textcore import Memo, hash_runs, mix, ragged, text_slices, words
from polisgrid.llm.toxicity import crc_fold, lowered

_SEGMENT = 128


@dataclasses.dataclass(frozen=True)
class Plan:
    documents: int = 3_000  # to learn from, at most: the smallest by hash
    bytes: int = 16 << 20  # of their texts, at most: what would exceed it is passed over
    piece: int = 30  # words of a training piece
    width: int = 1 << 16
    epochs: int = 4
    folds: int = 5
    test_fold: int = 0
    ridge: float = 1e-6


def features(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, one after another, and how many each has."""
    n = len(starts)
    size = lens + 2
    ends = np.cumsum(size)
    flat = np.zeros(int(ends[-1]) if n else 0, np.uint64)
    mark = np.zeros(len(flat), bool)
    mark[ends - 1] = mark[ends - size] = True
    flat[~mark] = ragged(data, starts, lens)
    flat[ends - 1], flat[ends - size] = 256, 257
    left = np.repeat(ends, size) - np.arange(len(flat))
    found, owner = [hash_runs(data, starts, lens) % np.uint64(width)], [np.arange(n)]
    word = np.repeat(np.arange(n), size)
    code = flat.copy()
    for k in (1, 2, 3):
        code[:-k] = code[:-k] * np.uint64(263) + flat[k:]
        ok = np.flatnonzero(left > k)
        found.append(mix(code[ok] + np.uint64(k << 50)) % np.uint64(width))
        owner.append(word[ok])
    owner, found = np.concatenate(owner), np.concatenate(found).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=n)


def letters(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Which words hold an ASCII letter or another character than ASCII."""
    is_letter = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    total = np.append(0, np.cumsum(is_letter))
    return total[starts + lens] > total[starts]


@dataclasses.dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # width x langs
    moves: np.ndarray  # log potentials from, to
    width: int

    def __post_init__(self):
        self.memo = Memo(np.dtype(np.float32), len(self.langs), most=1 << 20)

    def potentials(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        def make(at: np.ndarray):
            own, counts = features(data, starts[at], lens[at], self.width)
            sums = np.add.reduceat(self.weights[own], np.cumsum(counts) - counts, axis=0)
            return sums - sums.max(1, keepdims=True), None

        rows = self.memo.look(hash_runs(data, starts, lens), make)
        return np.exp(np.maximum(self.memo.pool[rows].astype(np.float64), -60))

    def sums(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per document the sum of its letter words' marginals, and their number."""
        n_docs, width = len(offsets) - 1, len(self.langs)
        starts, lens, before = words(low, offsets)
        out, number = np.zeros((n_docs, width)), np.zeros(n_docs, np.int64)
        if not len(starts):
            return out, number
        e = self.potentials(low, starts, lens)
        has = letters(low, starts, lens)
        move = np.exp(self.moves - self.moves.max())
        per = -(-np.diff(before) // _SEGMENT)
        first = np.cumsum(per) - per
        n_seg = int(per.sum())
        doc = np.repeat(np.arange(n_docs), per)
        begin = before[:-1][doc] + (np.arange(n_seg) - first[doc]) * _SEGMENT
        size = np.minimum(before[1:][doc] - begin, _SEGMENT)
        order = np.argsort(-size, kind="stable")  # longest first, so that the active ones stand in front
        begin_o, size_o = begin[order], size[order]
        on = np.searchsorted(-size_o, -np.arange(1, _SEGMENT + 1), "right")
        chain = np.tile(np.eye(width), (n_seg, 1, 1))
        for k in range(int(size_o[0])):
            n = on[k]
            step = chain[:n] @ move * e[begin_o[:n] + k][:, None, :]
            chain[:n] = step / step.sum((1, 2), keepdims=True)
        whole = np.empty_like(chain)
        whole[order] = chain
        ahead, behind = np.ones((n_seg, width)) / width, np.ones((n_seg, width))
        for k in range(1, int(per.max())):
            at = (first + k)[per > k]
            v = np.einsum("ni,nij->nj", ahead[at - 1], whole[at - 1])
            ahead[at] = v / v.sum(1, keepdims=True)
            at = (first + per - 1 - k)[per > k]
            v = np.einsum("nij,nj->ni", whole[at + 1], behind[at + 1])
            behind[at] = v / v.sum(1, keepdims=True)
        forward = np.empty_like(e)
        now = ahead[order]
        for k in range(int(size_o[0])):
            n = on[k]
            v = now[:n] @ move * e[begin_o[:n] + k]
            now[:n] = v / v.sum(1, keepdims=True)
            forward[begin_o[:n] + k] = now[:n]
        now = behind[order]
        for k in range(int(size_o[0])):  # from the end of each segment
            n = on[k]
            at = begin_o[:n] + size_o[:n] - 1 - k
            v = forward[at] * now[:n]
            back = (e[at] * now[:n]) @ move.T
            now[:n] = back / back.sum(1, keepdims=True)
            forward[at] = v / v.sum(1, keepdims=True)
        owner = np.repeat(np.arange(n_docs), np.diff(before))
        for j in range(width):
            out[:, j] = np.bincount(owner[has], forward[has, j], n_docs)
        return out, np.bincount(owner[has], minlength=n_docs)


def pieces(before: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of each piece: all words of every text, the last piece may be shorter."""
    per = -(-np.diff(before) // piece)
    doc = np.repeat(np.arange(len(per)), per)
    return doc, before[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * piece


def train(texts: list[str], labels: list[str], plan: Plan) -> Model:
    langs = sorted(set(labels))
    target = np.array([langs.index(x) for x in labels])
    raw = [t.encode() for t in texts]
    low = lowered(np.frombuffer(b"".join(raw), np.uint8))
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    starts, lens, before = words(low, offsets)
    model = Model(langs, np.zeros((plan.width, len(langs))), np.zeros((len(langs), len(langs))), plan.width)
    rng = np.random.default_rng(8)
    own_doc, begin = pieces(before, plan.piece)
    if not len(begin):
        return model
    at = begin[:, None] + np.arange(plan.piece)
    at[at >= before[own_doc + 1][:, None]] = -1  # behind the end of a text
    gold = np.repeat(target[own_doc][:, None], plan.piece, 1)
    _, word_first, word_of = np.unique(hash_runs(low, starts, lens), return_index=True, return_inverse=True)
    own, counts = features(low, starts[word_first], lens[word_first], plan.width)
    own_starts = np.cumsum(counts) - counts
    n_l = len(langs)
    square, square_m = np.full((plan.width, n_l), 1e-6), np.full((n_l, n_l), 1e-6)
    for _ in range(plan.epochs):
        mate = rng.permutation(len(at))
        seq = np.column_stack([at, at[mate]])  # two pieces in a row
        y = np.column_stack([gold, gold[mate]])
        order = np.argsort(seq < 0, axis=1, kind="stable")  # what no word stands at goes to the end
        seq, y = np.take_along_axis(seq, order, 1), np.take_along_axis(y, order, 1)
        for part in np.array_split(rng.permutation(len(seq)), max(1, len(seq) // 64)):
            real = seq[part] >= 0
            w = word_of[seq[part][real]]
            idx = ragged(own, own_starts[w], counts[w])
            spot = np.cumsum(counts[w]) - counts[w]
            score = np.zeros((*real.shape, n_l))
            score[real] = np.column_stack([np.add.reduceat(model.weights[idx, j], spot) for j in range(n_l)])
            e, m = np.exp(score - score.max(2, keepdims=True)), np.exp(model.moves)
            steps = e.shape[1]
            f, b = np.empty_like(e), np.ones_like(e)
            now = np.ones((len(part), n_l)) / n_l
            for k in range(steps):
                now = now @ m * e[:, k]
                now = now / now.sum(1, keepdims=True)
                f[:, k] = now
            for k in range(steps - 2, -1, -1):
                v = (e[:, k + 1] * b[:, k + 1]) @ m.T
                b[:, k] = np.where(real[:, k + 1, None], v / v.sum(1, keepdims=True), 1)
            p = f * b
            p /= p.sum(2, keepdims=True)
            pair = f[:, :-1, :, None] * m * (e[:, 1:] * b[:, 1:])[:, :, None, :]
            pair *= real[:, 1:, None, None] / pair.sum((2, 3), keepdims=True)
            true = np.eye(n_l)[y[part]] * real[:, :, None]
            slope = (p - true)[real] / len(part)
            g = np.column_stack([np.bincount(idx, np.repeat(slope[:, j], counts[w]), plan.width) for j in range(n_l)]) + plan.ridge * model.weights
            square += g * g
            model.weights -= 0.3 * g / np.sqrt(square)
            gm = (pair.sum((0, 1)) - np.einsum("nti,ntj->ij", true[:, :-1], true[:, 1:])) / len(part)
            square_m += gm * gm
            model.moves -= 0.1 * gm / np.sqrt(square_m)
    model.weights = model.weights.astype(np.float32)
    return model


_MADE: dict = {}


def languages(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, lang_pred, score of every row of doc_id, text, lang.

    lang_pred is und (score 0) for texts that are null or without a letter, and for all if there is nothing to learn
    from. Repeated rows give repeated rows; an empty table none. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.where("lang is not null and text is not null and length(text) > 0").where(crc_fold("doc_id", plan.folds) != plan.test_fold)
    drawn = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(plan.documents)  # bounded by plan.documents
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fit = fitting(known.join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id"), plan.bytes)
    sample = [] if fit is None else fit.orderBy(F.xxhash64("doc_id"), "text", "lang").collect()
    model = None
    if sample:
        made = train([r["text"] for r in sample], [r["lang"] for r in sample], plan)
        model = spark.sparkContext.broadcast((made.langs, made.weights, made.moves, made.width, hash((made.weights.tobytes(), tuple(made.langs)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        if model is not None:
            langs, weights, moves, width, key = model.value
            if key not in _MADE:
                _MADE.clear()
                _MADE[key] = Model(langs, weights, moves, width)
            own = _MADE[key]
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                n = len(offsets) - 1
                names, score = np.full(n, "und", object), np.zeros(n)
                if own is not None:
                    sums, number = own.sums(lowered(data), offsets)
                    ok = number > 0
                    doubtful = np.flatnonzero(ok & ~_ascii_letter(data, offsets))  # other characters only: letters among them?
                    for d in doubtful:
                        ok[d] = any(map(str.isalpha, data[offsets[d] : offsets[d + 1]].tobytes().decode()))
                    names[ok] = np.array(own.langs, object)[sums[ok].argmax(1)]
                    score[ok] = sums[ok].max(1) / number[ok]
                code = np.array([0 if i is None else zlib.crc32(str(i).encode()) for i in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(code % plan.folds == plan.test_fold), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _ascii_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 32
    total = np.append(0, np.cumsum((low >= 97) & (low <= 122) & (data < 128)))
    return total[offsets[1:]] > total[offsets[:-1]]
