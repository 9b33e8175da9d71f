"""Co-training against a plain version, and on labels kept aside."""

import math

import numpy as np

from polisgrid.llm import quality
from polisgrid.llm.shared import read


def sample(seed=4, n=900):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.7).astype(int)
    one = np.column_stack([2.5 * y + rng.standard_normal(n), rng.standard_normal(n), np.ones(n)])
    two = np.column_stack([0.8 * y + rng.standard_normal(n), rng.standard_normal(n), rng.standard_normal(n), np.ones(n)])
    return [one, two], y


def plain_step(x, y, w, pseudo):
    """A Newton step row by row: labelled rows, and for each label the pseudo-labelled rows of it."""
    d = len(w)
    slope, matrix = -w.copy(), np.eye(d)

    def add(z, label, weight):
        p = 1 / (1 + math.exp(-max(-15.0, min(15.0, float(z @ w)))))
        slope[:] += weight * (label - p) * z
        matrix[:] += weight * p * (1 - p) * np.outer(z, z)

    for z, label in zip(x, y, strict=True):
        add(z, label, 1.0)
    for label, rows in enumerate(pseudo):
        for z in rows:
            add(z, label, min(1.0, sum(y == label) / len(rows)))
    return w + np.linalg.solve(matrix, slope)


def test_a_round_is_a_newton_step_on_all_documents():
    views, y = sample()
    known, held = slice(0, 200), np.arange(200) % 5 == 0
    train, pool = [v[known] for v in views], [v[200:] for v in views]
    teachers = [quality._calibrate(quality._fit(v[~held], y[known][~held]), v[held], y[known][held], 0.6)[0] for v in train]
    said = quality.pseudo_labels(teachers, pool)
    for k in (0, 1):
        for z, label in zip(pool[k], said[k], strict=True):
            s = teachers[k].slope * float(np.clip(((z - teachers[k].mean) / teachers[k].scale) @ teachers[k].weights, -15, 15)) + teachers[k].shift
            assert label in (-1, 1 if s >= teachers[k].sure[1] else 0 if s <= teachers[k].sure[0] else -1)
    assert not ((said[0] >= 0) & (said[1] >= 0) & (said[0] != said[1])).any() and (said[0] >= 0).sum() > 50
    found = iter(quality.step_sums(teachers, [[t] for t in teachers], pool))
    for k in (0, 1):
        d = views[k].shape[1]
        sums = [(float(next(found)[0]), next(found), next(found).reshape(d, d)) for _ in (0, 1)]
        view = quality.stepped(teachers[k], train[k], y[known], sums, 1.0)
        scaled = lambda v: (v - teachers[k].mean) / teachers[k].scale  # noqa: B023, E731
        want = plain_step(scaled(train[k]), y[known], teachers[k].weights, [[z for z, s in zip(scaled(pool[k]), said[1 - k], strict=True) if s == label] for label in (0, 1)])
        assert np.allclose(view.weights, want)


def test_no_round_raises_the_held_out_loss():
    views, y = sample(7)
    held = np.arange(200) % 5 == 0
    pool = [v[200:600] for v in views]
    losses = []
    for rounds in (0, 1, 3):
        plan = quality.Plan(rounds=rounds, precision=0.6)
        models, weights = quality.co_train([v[:200] for v in views], y[:200], held, lambda t, n: quality.step_sums(t, n, pool), plan)
        assert (weights[:-1] >= 0).all()
        p = np.clip(quality._chance((models, weights), *(v[600:] for v in views))[0], 1e-9, 1 - 1e-9)
        losses.append(-np.log(np.where(y[600:] == 1, p, 1 - p)).mean())
    assert losses[1] < losses[0] + 0.02 and losses[2] < losses[0] + 0.02


def test_sure_places():
    s, y = np.array([-3.0, -2, -1, 0, 1, 2, 3, 4] * 60), np.array([0, 0, 1, 0, 0, 1, 1, 1] * 60)
    assert quality.sure_places(s, y, 0.95) == (-2.0, 2.0)
    assert quality.sure_places(s[:8], y[:8], 0.95) == (-np.inf, np.inf)  # too few to be sure
    assert quality.sure_places(np.zeros(0), np.zeros(0), 0.95) == (-np.inf, np.inf)


def test_sums_of_the_executors(spark):
    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels")
    features = quality._features(quality._columns(docs), labels, quality.Plan())
    rows = features.collect()
    assert {r.quality for r in rows} == {-1, 0, 1} and len(rows) == docs.count()
    x = [np.array([np.frombuffer(r[k], "<f4") for r in rows], float) for k in ("a", "b")]
    y = np.array([r.quality for r in rows])
    views = [quality._calibrate(quality._fit(v[y >= 0], y[y >= 0]), v[y >= 0], y[y >= 0], 0.5)[0] for v in x]
    want = quality.step_sums(views, [[v] for v in views], [v[y < 0] for v in x])
    got = quality._summed(features, views, [[v] for v in views])
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True)) and sum(want[0]) + sum(want[6]) > 0


def test_bad_documents_of_labels_kept_aside(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    got = {r.doc_id: r.keep for r in quality.quality(docs, labels.where("doc_id % 3 != 0")).collect()}
    aside = [r for r in labels.where("doc_id % 3 = 0").collect() if r.quality in (0, 1)]
    bad, good = [r for r in aside if r.quality == 0], [r for r in aside if r.quality == 1]
    assert sum(not got[r.doc_id] for r in bad) >= 192 and sum(got[r.doc_id] for r in good) >= 1150 and (len(bad), len(good)) == (195, 1154)


def test_ties_repeats_and_long_texts(spark):
    good, bad = "A calm sentence about the sea. ", "BUY!! NOW!! $$$ ### BUY!! "
    rows = [(k, (good if k % 2 else bad) * (k % 5 + 1), "en", "s", 1.0, 0) for k in range(200)]
    rows += [(300, good * 120_000, "en", "s", 1.0, 0), (301, good, "en", "s", 1.0, 0), (301, good, "en", "s", 1.0, 0), (302, None, None, None, 1.0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, copy int").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(5, 1), (6, 1), (7, None), (None, 0)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and len({(r.score, r.keep) for r in got if r.doc_id == 301}) == 1
    by = {r.doc_id: r.keep for r in got}
    assert all(by[k] == bool(k % 2) for k in range(100, 200)) and by[300] and by[301]
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.keep)
