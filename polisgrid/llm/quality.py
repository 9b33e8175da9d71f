"""Operator 10: a quality classifier by co-training two views.

One view sees the text's content (kinds of characters, repetition, shapes of words), the other its metadata (language,
source, length and layout of lines). Both start from the labelled documents; a fifth of these is held out. In each round
each view, calibrated on the held-out documents, labels for the other those documents of the whole corpus of which it is
sure, and the other makes a step of Newton's method on the labelled and pseudo-labelled documents together. A step that
raises the held-out loss is undone. A logistic combination of the calibrated views scores all documents.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgrid.llm.shared import Table
from polisgrid.llm.textcore import hash_runs, text_slices, words
from polisgrid.llm.toxicity import logistic

_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]


@dataclasses.dataclass(frozen=True)
class Plan:
    labelled: int = 6_000  # labelled documents to learn from, at most: the smallest by hash
    rounds: int = 3
    held: int = 5  # one of so many labelled documents is held out
    precision: float = 0.95  # a view labels where its precision on held-out documents is surely over this
    threshold: float = 0.5
    slots: int = 24  # hashed values of lang and of source


def content(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of the text view."""
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets))

    def share(flags: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return (total[offsets[1:]] - total[offsets[:-1]]) / (size if by is None else np.maximum(1, by))

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    high = data >= 128
    letters = share(upper | lower | high) * size
    starts, lens, before = words(data, offsets)
    counts = np.diff(before)
    hashes = hash_runs(data, starts, lens)
    doc = np.repeat(np.arange(n), counts)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    mean = lambda v: np.bincount(doc, v, n) / np.maximum(1, counts)
    last = data[starts + lens - 1] if len(starts) else np.zeros(0, np.uint8)
    mark = ~(((last >= 48) & (last <= 57)) | ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128))
    table = np.zeros((n, len(_PUNCT)))
    kind = np.full(256, len(_PUNCT), np.int64)
    kind[_PUNCT] = np.arange(len(_PUNCT))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    at = kind[data]
    on = at < len(_PUNCT)
    table = np.bincount(owner[on] * len(_PUNCT) + at[on], minlength=n * len(_PUNCT)).reshape(n, -1) / np.maximum(1, counts)[:, None]
    columns = [
        share(upper, letters), share((data >= 48) & (data <= 57)), letters / size, mean(same.astype(float)),
        np.log1p(np.bincount(doc[order], new, n)) - np.log1p(counts), np.minimum(mean(lens.astype(float)), 30) / 10, mean(mark.astype(float)), mean((lens == 1).astype(float)),
    ]
    return np.column_stack([*columns, np.minimum(table, 4.0), np.ones(n)])


def layout(data: np.ndarray, offsets: np.ndarray, lang: list, source: list, plan: Plan) -> np.ndarray:
    """Features of the metadata view."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    total = np.append(0, np.cumsum(data == 10))
    lines = total[offsets[1:]] - total[offsets[:-1]] + 1
    out = np.zeros((n, 2 * plan.slots))
    for shift, values in ((0, lang), (plan.slots, source)):
        at = [shift + zlib.crc32(str(v).encode()) % plan.slots for v in values]
        out[np.arange(n), at] = 1
    return np.column_stack([np.log1p(size) / 5, np.log1p(lines), np.log1p(size / lines) / 3, size == 0, out, np.ones(n)])


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


@dataclasses.dataclass
class View:
    """A logistic model of one view: the scale of its features, its weights, and what turns a score into a chance. Scores
    from `sure` on (bad, good) are certain enough to be labels; without such a place it is infinite."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    sure: tuple[float, float] = (-np.inf, np.inf)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights, -15, 15)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.score(x) + self.shift


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    mean[-1], scale[-1] = 0, 1
    return mean, scale


def _fit(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = _scaled(x)
    return View(mean, scale, logistic((x - mean) / scale, y.astype(float), ridge=1.0))


def sure_places(s: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """The scores up to which, and from which on, labels are right in surely so large a part of the held-out documents
    (the lower end of Wilson's interval of 95 %, one-sided)."""

    def place(score: np.ndarray, right: np.ndarray) -> float:
        order = np.argsort(-score, kind="stable")
        n = np.arange(1, len(order) + 1)
        part = np.cumsum(right[order]) / n
        z = 1.645
        low = (part + z * z / (2 * n) - z * np.sqrt(part * (1 - part) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        ends = np.append(score[order][1:] != score[order][:-1], True) if len(order) else np.zeros(0, bool)  # equal scores go together
        good = np.flatnonzero((low >= precision) & ends & (score[order] > 0))
        return float(score[order][good[-1]]) if len(good) else np.inf

    return -place(-s, y == 0), place(s, y == 1)


def _calibrate(view: View, x: np.ndarray, y: np.ndarray, precision: float) -> tuple[View, float]:
    """The view with its calibration on held-out documents, and their mean loss."""
    s = view.score(x)
    slope, shift = logistic(np.column_stack([s, np.ones(len(s))]), y.astype(float), ridge=1e-1) if 0 < y.sum() < len(y) else (1.0, 0.0)
    chance = np.clip(_sigmoid(slope * s + shift), 1e-6, 1 - 1e-6)
    loss = -float(np.where(y == 1, np.log(chance), np.log(1 - chance)).mean()) if len(y) else np.inf
    out = dataclasses.replace(view, slope=float(slope), shift=float(shift))
    return dataclasses.replace(out, sure=sure_places(out.calibrated(x), y, precision)), loss


def pseudo_labels(views: list[View], x: list[np.ndarray]) -> list[np.ndarray]:
    """What each view says of documents for the other one: 1, 0, or -1 where it isn't sure or the other surely differs."""
    s = [v.calibrated(f) for v, f in zip(views, x, strict=True)]
    said = [np.where(c >= v.sure[1], 1, np.where(c <= v.sure[0], 0, -1)) for v, c in zip(views, s, strict=True)]
    apart = (said[0] >= 0) & (said[1] >= 0) & (said[0] != said[1])
    return [np.where(apart, -1, x) for x in said]


def step_sums(teachers: list[View], learners: list[list[View]], x: list[np.ndarray]) -> list[np.ndarray]:
    """Of documents, for each view, each of its learners and each label that the other view gives: the number, the gradient
    and the matrix of Newton's method, one after another."""
    said = pseudo_labels(teachers, x)
    out = []
    for k in (0, 1):
        for view in learners[k]:
            z = (x[k] - view.mean) / view.scale
            p = _sigmoid(np.clip(z @ view.weights, -15, 15))
            for label in (0, 1):
                on = said[1 - k] == label
                zo, po = z[on], p[on]
                out += [np.array([on.sum()], float), zo.T @ (label - po), ((zo * (po * (1 - po))[:, None]).T @ zo).ravel()]
    return out


def stepped(view: View, x: np.ndarray, y: np.ndarray, pseudo: list[tuple[float, np.ndarray, np.ndarray]], size: float) -> View:
    """The view after a part of Newton's step on labelled documents and the sums over pseudo-labelled ones, which count as
    many as the labelled of their label at most."""
    z = (x - view.mean) / view.scale
    p = _sigmoid(np.clip(z @ view.weights, -15, 15))
    ridge = np.ones(z.shape[1])
    slope, matrix = z.T @ (y - p) - ridge * view.weights, (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
    for label, (n, g, h) in enumerate(pseudo):
        weight = min(1.0, float((y == label).sum()) / n) if n else 0.0
        slope, matrix = slope + weight * g, matrix + weight * h
    return dataclasses.replace(view, weights=view.weights + size * np.linalg.solve(matrix, slope))


def co_train(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, sums: Callable[[list[View], list[list[View]]], list[np.ndarray]], plan: Plan) -> tuple[list[View], np.ndarray]:
    """Both views, and the weights of (view one, view two, a constant). sums gives step_sums over all other documents.

    Held-out documents decide on calibration, on what is sure and on each step; the views that are returned make the same
    steps with the held-out documents among the labelled ones.
    """
    train, test = [v[~held] for v in views], [v[held] for v in views]
    honest, whole, losses = [], [], []
    for k in (0, 1):
        view, loss = _calibrate(_fit(train[k], y[~held]), test[k], y[held], plan.precision)
        honest.append(view)
        losses.append(loss)
        whole.append(_fit(views[k], y))
    for _ in range(plan.rounds):
        if not any(np.isfinite(v.sure).any() for v in honest):
            break
        found = iter(sums(honest, [[honest[k], whole[k]] for k in (0, 1)]))
        pseudo = [[[(float(next(found)[0]), next(found), next(found).reshape(views[k].shape[1], -1)) for _ in (0, 1)] for _ in (0, 1)] for k in (0, 1)]
        moved, now = False, list(honest)
        for k in (0, 1):
            if not any(n for n, _, _ in pseudo[k][0]):
                continue
            for size in (1.0, 0.5, 0.25):
                view, loss = _calibrate(stepped(honest[k], train[k], y[~held], pseudo[k][0], size), test[k], y[held], plan.precision)
                if loss < losses[k]:
                    now[k], losses[k], moved = view, loss, True
                    whole[k] = stepped(whole[k], views[k], y, pseudo[k][1], size)
                    break
        honest = now
        if not moved:
            break
    proper = 0 < y[held].sum() < held.sum()
    by = np.column_stack([v.score(x) for v, x in (zip(honest, test, strict=True) if proper else zip(whole, views, strict=True))] + [np.ones(held.sum() if proper else len(y))])
    return whole, combined(by, y[held] if proper else y)


def combined(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the views' scores (the last column is constant); a view that would count against itself counts nothing."""
    on = np.ones(scores.shape[1], bool)
    while True:
        weights = np.zeros(scores.shape[1])
        weights[on] = logistic(scores[:, on], y.astype(float), ridge=1e-1)
        if not (weights[:-1] < 0).any():
            return weights
        on[:-1] &= weights[:-1] >= 0


def _labelled(labels: DataFrame, plan: Plan) -> DataFrame:
    own = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(plan.labelled)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))


def _both(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(batch.column(k).to_pylist()), "<f4").reshape(batch.num_rows, -1).astype(np.float64) for k in (2, 3)]


def _summed(features: DataFrame, teachers: list[View], learners: list[list[View]]) -> list[np.ndarray]:
    """step_sums over all documents without a label, summed by the executors in two steps."""
    sizes = [len(a) for a in step_sums(teachers, learners, [np.zeros((0, len(v.mean))) for v in teachers])]

    def of(batches: Iterator[pa.RecordBatch], values: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes))
        for batch in batches:
            total += values(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return of((b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)), lambda b: np.concatenate(step_sums(teachers, learners, _both(b))))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return of(batches, lambda b: np.sum([np.frombuffer(x) for x in b.column(0).to_pylist()], axis=0))

    each = features.where("quality < 0").mapInArrow(documents, "sums binary")
    rows = each.repartition(16).mapInArrow(parts, "sums binary").collect()  # 16 rows of a fixed size
    return np.split(np.sum([np.frombuffer(r[0]) for r in rows], axis=0), np.cumsum(sizes)[:-1])


def learn(features: DataFrame, plan: Plan) -> tuple | None:
    """Models of the views and their combination from rows of _features; None without labels of both kinds. Labelled rows
    are bounded by the plan, rows that repeat a doc_id included; all others take part in every round where they are."""
    known = features.where("quality >= 0").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "a", "b").limit(2 * plan.labelled).collect()
    y = np.array([r["quality"] for r in known], np.int64)
    if not ((y == 0).any() and (y == 1).any()):
        return None
    views = [np.array([np.frombuffer(r[k], "<f4") for r in known], np.float64) for k in ("a", "b")]
    held = np.arange(len(y)) % plan.held == 0
    if not ((y[~held] == 0).any() and (y[~held] == 1).any()):
        held[:] = False
    return co_train(views, y, held, lambda teachers, learners: _summed(features, teachers, learners), plan)


def _chance(model: tuple | None, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    if model is None:
        return [np.ones(len(a))] * 3
    one, two = (v.score(x) for v, x in zip(model[0], (a, b), strict=True))
    return [_sigmoid(s) for s in (np.column_stack([one, two, np.ones(len(a))]) @ model[1], one, two)]


def quality(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """doc_id, score (of good quality), score_text, score_meta, keep of every row.

    docs has doc_id, text, lang, source; labels has doc_id and quality (0 or 1; other values are left out). Null and
    empty texts are scored as texts of no word, texts of any length whole. Without labels of both kinds every score is 1
    and all are kept. Repeated rows give repeated rows, each with the label of its doc_id; of several labels of a doc_id
    each counts. A score equal to the threshold is kept. Other columns are ignored, whatever their names; an empty table
    gives no row. The features of all documents stay in the shared folder, as the result is read from them.
    """
    features = Table(_features(_columns(docs), labels, plan), "features").df
    model = learn(features, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _chance(model, *_both(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p), pa.array(p[0] >= plan.threshold)], names=["doc_id", "score", "score_text", "score_meta", "keep"])

    # A row that several labels match is there once for each; only its first one stays.
    return features.where("copy = 0").select("doc_id", "quality", "a", "b").mapInArrow(run, "doc_id long, score double, score_text double, score_meta double, keep boolean")


def _features(rows: DataFrame, labels: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, quality (-1: no label), a and b (features of the views), copy (numbers a row's several labels)."""
    drawn = _labelled(labels, plan).groupBy("doc_id").agg(F.array_sort(F.collect_list("quality")).alias("qualities"))  # bounded by the plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                a = content(data, offsets).astype("<f4")
                b = layout(data, offsets, part.column(1).to_pylist(), part.column(2).to_pylist(), plan).astype("<f4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary()), part.column(4)], names=["doc_id", "a", "b", "qualities"])

    joined = rows.join(F.broadcast(drawn), "doc_id", "left").select("doc_id", "lang", "source", "text", F.coalesce("qualities", F.array(F.lit(-1))).alias("qualities"))
    made = joined.mapInArrow(run, "doc_id long, a binary, b binary, qualities array<int>")
    return made.select("doc_id", "a", "b", F.posexplode("qualities").alias("copy", "quality")).select("doc_id", "quality", "a", "b", "copy")


def good(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """The rows that are kept, with the same columns. Each row is judged by itself, so no text is shuffled; texts are read
    twice, to learn from them and to judge them."""
    features = Table(_features(_columns(docs), labels, plan), "features")
    model = learn(features.df, plan)
    features.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                lang, source = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("lang", "source"))
                # The same precision as the features that were learned from.
                a, b = content(data, offsets), layout(data, offsets, lang, source, plan)
                chance = _chance(model, *(x.astype("<f4").astype(np.float64) for x in (a, b)))
                yield part.filter(pa.array(chance[0] >= plan.threshold))

    return docs.mapInArrow(run, docs.schema)
