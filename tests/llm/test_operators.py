"""The operators on nulls, empty and long texts, repeated rows, empty tables and other columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from polisgrid.llm import bpe, decontaminate, itq, language, minhash, ngram, quality, records, secrets, toxicity
from polisgrid.llm.shared import read

SF = "/root/testdata/sf0.001"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
#: Columns beyond those an operator needs have names that it uses itself.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, sig string, score double, n_tokens long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (0, None), (1, ""), (2, BASE), (3, BASE), (3, BASE), (4, BASE + " more"), (5, "word " * 4000), (6, "a"), (7, "x" * 20000),
        (None, "no id here"), (8, " \n\t "), (9, "token = 'abcdefghijklmnop' idiot"),
    ]
    return spark.createDataFrame([(i, t, "en" if i else None, None, 3, 1, "k", "s", 0.5, 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_records(docs, none):
    path = P.path("byte_bpe_50k.json")
    got = records.token_records(docs, path).orderBy("start").collect()
    assert len(got) == 12 and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert {r.n_tokens for r in got if r.doc_id in (0, 1)} == {1}
    assert {r.ids_crc32 for r in got if r.doc_id in (0, 1)} == {zlib.crc32(bytes(4))}
    assert records.token_records(none, path).count() == 0


def test_records_are_what_the_library_gives(spark):
    path = P.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", None, "<|endoftext|>", "plain text", "x" * 50000 + " <|endoftext|>", ""]
    rows = [(10 - k, t) for k, t in enumerate(texts)]
    got = records.token_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()
    library, start, want = Tokenizer.from_file(path), 0, {}
    for d, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_records_in_any_order(docs, tmp_path):
    folder = f"file://{tmp_path}/r"
    shards = records.write_records(docs, folder, P.path("byte_bpe_50k.json"))
    shard, n = shards[0][:2]
    plain = [(int(e["doc_id"][k]), ids.tolist()) for e, x in records.read_shard(folder, shard) for k, ids in enumerate(x)]
    mixed = [(int(e["doc_id"][0]), x[0].tolist()) for e, x in records.read_shard(folder, shard, np.arange(n)[::-1])]
    assert mixed == plain[::-1]
    file = tmp_path / "r" / f"shard-{shard:06d}.rec"
    raw = bytearray(file.read_bytes())
    raw[14] ^= 1
    file.write_bytes(raw)
    with pytest.raises(ValueError, match="checksum"):
        list(records.read_shard(folder, shard))


def test_bpe(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    got = by_id(bpe.bpe(docs, path, P.PATTERN))
    assert got[0][0].n_tokens == 0 and got[0][0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(got[3]) == 2 and got[2][0].decoded_sha256 == hashlib.sha256(BASE.encode()).hexdigest()
    assert bpe.bpe(none, path, P.PATTERN, with_ids=True, keep=("lang",)).columns == ["doc_id", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_minhash(docs, none):
    got = by_id(minhash.near_duplicates(docs))
    assert {k: v[0].component_id for k, v in got.items()} == {**{k: k for k in got}, 3: 2, 4: 2}
    assert [r.kept for r in got[3]] == [False, False] and got[0][0].n_shingles == 0 and got[None][0].kept
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_against_all_pairs(spark):
    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(read(spark, SF, "documents")).collect()}
    assert got == {d: (len(sets[d]), top(d)) for d in ids}


def test_copies_apart_from_the_centre_are_linked(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(3):  # chains whose ends are unlike
        now = list(rng.permutation(words)[:200])
        for step in range(12):
            now[step * 5] = f"new{group}_{step}"
            rows.append((group * 100 + step, " ".join(now)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Plan(block=4)).collect()}
    assert got == {d: d // 100 * 100 for d, _ in rows}


def test_secrets(docs, none):
    got = by_id(secrets.secrets(docs))
    assert got[9][0].spans == "assign:0:25" and got[9][0].n_assign == 1 and got[0][0].spans == ""
    assert secrets.secrets(none).count() == 0 and secrets.redact(none).columns == none.columns
    assert by_id(secrets.redact(docs))[9][0].text == "[assign]' idiot"


@pytest.mark.parametrize("plan", [itq.Plan(cell=16, block=16), itq.Plan(cell=64, block=32, dense=1)])
def test_itq(spark, plan):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for d in (1, 8, 16, 32):  # each dimension by itself
        base = rng.normal(size=(80, d))
        near = base[:40] + rng.normal(scale=0.2, size=(40, d)) * np.linalg.norm(base[:40], axis=1, keepdims=True) / d**0.5
        group = base[50] + rng.normal(scale=0.02, size=(60, d))  # more links than a block gives as pairs
        x = np.concatenate([base, near, base[:3], 7 * base[5:6], group])
        ids = 1000 * d + np.arange(len(x))
        rows += [(int(k), v.tolist(), "other") for k, v in zip(ids, x, strict=True)]
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= 0.9
        root = ids.copy()
        for _ in range(len(x)):
            root = np.array([root[row].min() for row in linked])
        want |= {int(k): (int(n) - 1, int(r), d) for k, n, r in zip(ids, linked.sum(1), root, strict=True)}
    odd = [(900, None), (901, [0.0] * 8), (902, [None] * 8), (903, [float("nan")] + [1.0] * 7), (904, []), (905, [float("inf")] * 8), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows + [(*x, "other") for x in odd], "vec_id long, embedding array<double>, code string")
    got = {r.vec_id: r for r in itq.near_vectors(frame, plan).collect()}
    assert len(got) == len(rows) + len(odd) and all(got[k].n_links == 0 and got[k].kept for k, _ in odd)
    for d in (1, 8, 16, 32):
        own = [k for k in want if want[k][2] == d]
        assert all(got[k].n_links <= want[k][0] for k in own)
        assert sum(got[k].n_links for k in own) >= 0.95 * sum(want[k][0] for k in own), d
        assert np.mean([got[k].component_id == want[k][1] for k in own]) > 0.9
    assert itq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_itq_finds_the_links_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in itq.near_vectors(read(spark, "/root/testdata/sf0.01", "embeddings")).collect()}
    assert all(got[k] <= n for (k, _), n in zip(rows, want.tolist(), strict=True)) and sum(got.values()) >= 0.97 * want.sum()


def test_ngram(spark, docs, none):
    got = {r.doc_id: r for r in ngram.score(read(spark, SF, "documents")).collect()}
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), None] for r in read(spark, SF, "documents").collect()}
    count: dict = {}
    for d, t in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for w in t:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for d, t in tokens.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert ngram.score(docs).count() == 12 and ngram.score(none).count() == 0


def test_ngram_tells_long_words_of_two_letters_apart(spark):
    one = "p"
    while len(one) < 2048:
        one += one.translate(str.maketrans("pq", "qp"))
    other = one.translate(str.maketrans("pq", "qp"))
    texts = {k: (one if k < 30 else other) for k in range(50)}
    got = {r.doc_id: r for r in ngram.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    count: dict = {}
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for w in (t, None):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    assert v == 3
    for d, t in texts.items():
        assert got[d].base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in (t, None)), rel=1e-9)


def plain_trigram_scores(texts, plan):
    """log10 probabilities by dictionaries, with weights from plain expectation-maximisation."""
    words = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for d, t in texts.items()}
    code = {d: zlib.crc32(str(d).encode()) for d in texts}
    train = [d for d in texts if code[d] % 5 != 1]
    tune = [d for d in train if code[d] // 5 % plan.tuning == 0]

    def count(ids):
        c = {"docs": len(ids), "n": 0, "v": set()}
        for d in ids:
            w = ["<", "<", *words[d]]
            c["n"] += len(words[d])
            c["v"] |= set(words[d])
            for k in range(2, len(w)):
                for size in (1, 2, 3):
                    key = tuple(w[k + 1 - size : k + 1])
                    c[key] = c.get(key, 0) + 1
        return c

    def tokens(d, c):
        w = ["<", "<", *words[d]]
        for k in range(2, len(w)):
            two = c["docs"] if k == 2 else c.get((w[k - 2], w[k - 1]), 0)
            one = c["docs"] if k == 2 else c.get((w[k - 1],), 0)
            at = tuple(n if n <= 8 else min(5 + int(math.log2(n)), 35) for n in (two, one))
            yield at, (c.get((w[k - 2], w[k - 1], w[k]), 0) / max(1, two), c.get((w[k - 1], w[k]), 0) / max(1, one), c.get((w[k],), 0) / max(1, c["n"]), 1 / (len(c["v"]) + 1))

    part = count([d for d in train if d not in set(tune)])
    held = [x for d in tune for x in tokens(d, part)]
    start = (0.3, 0.3, 0.3, 0.1)
    weights: dict = {}
    for _ in range(plan.rounds):
        sums: dict = {}
        for at, p in held:
            w = weights.get(at, start)
            mass = [x * y for x, y in zip(w, p, strict=True)]
            own = sums.setdefault(at, [0.0] * 4)
            for k in range(4):
                own[k] += mass[k] / sum(mass)
        new, level = {}, start
        for a in range(36):
            own = [sum(s[k] for at, s in sums.items() if at[0] == a) + plan.prior * level[k] for k in range(4)]
            level = [x / sum(own) for x in own]
            for b in range(36):
                own = [x + plan.prior * y for x, y in zip(sums.get((a, b), [0.0] * 4), level, strict=True)]
                new[a, b] = [x / sum(own) for x in own]
        moved = max(abs(x - y) for at, w in new.items() for x, y in zip(w, weights.get(at, start), strict=True))
        weights = new
        if moved < plan.settled:
            break
    whole = count(train)
    return {d: sum(math.log10(sum(x * y for x, y in zip(weights.get(at, start), p, strict=True))) for at, p in tokens(d, whole)) for d in texts}


def test_ngram_scores_are_those_of_a_plain_model(spark):
    docs = read(spark, SF, "documents")
    want = plain_trigram_scores({r.doc_id: r.text for r in docs.collect()}, ngram.Plan())
    got = {r.doc_id: r.score for r in ngram.score(docs).collect()}
    assert got == {d: pytest.approx(s, rel=1e-4) for d, s in want.items()}
    dealt = {r.doc_id: r.score for r in ngram.score(docs.repartition(5)).collect()}  # no plain scan: stored first
    assert dealt == {d: pytest.approx(s, rel=1e-6) for d, s in got.items()}


def test_ngram_tells_documents_that_occur_twice_apart(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(400)]
    rows = [(k, texts[k % 400]) for k in range(500)]  # the first hundred occur twice
    got = {r.doc_id: r.score for r in ngram.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r.held_out}
    both = [(got[k] + got[k + 400]) / 2 for k in range(100) if k in got and k + 400 in got]
    once = [got[k] for k in range(100, 400) if k in got]
    assert np.mean(np.array(both)[:, None] > np.array(once)) > 0.95


def test_ngram_weights_sum_to_one():
    w = ngram.next_weights(np.random.default_rng(1).random((ngram.BUCKETS, 4)), ngram.Plan())
    assert np.allclose(w.sum(1), 1) and (w > 0).all()


def test_toxicity(spark, docs, none):
    kinds = [("you idiot", 1), ("what a moron and idiot", 1), ("stupid idiot moron", 1), ("a fine quiet day", 0), ("rain falls on hills", 0), ("bread and water", 0)]
    labelled = spark.createDataFrame([(k, kinds[k % 6][0] + f" number{k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, kinds[k % 6][1]) for k in range(300)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = [(r, kinds[r.doc_id % 6][1]) for r in toxicity.toxicity(labelled, labels).collect()]
    held = [(r.predicted, y) for r, y in got if r.held_out]
    assert held and np.mean([p == y for p, y in held]) > 0.95
    more = spark.createDataFrame([(1000, "such an i.d.i.o.t"), (1001, "i d i o t"), (1002, ""), (1003, None)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.toxicity(labelled.union(more), labels).collect()}
    assert score[1000] > score[1002] and score[1001] > score[1002] and score[1002] == score[1003]
    assert toxicity.toxicity(docs, labels.limit(0)).where("score = 0 and predicted = 0").count() == 12
    assert toxicity.toxicity(none, labels).count() == 0


def test_language(spark, docs, none):
    own = spark.createDataFrame([(k, ("the house and the dog " if k % 2 else "das haus und der hund ") * 12, "en" if k % 2 else "de") for k in range(200)] + [(500, "123 !?", None), (501, None, None), (502, "den hund", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.languages(own).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") for k in range(200)) and got[502].lang_pred == "de"
    assert (got[500].lang_pred, got[501].lang_pred, got[500].score) == ("und", "und", 0)
    assert language.languages(docs).count() == 12 and language.languages(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, BASE), (2, None), (None, BASE), (3, "tiny")], "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, items))
    assert {k for k, v in got.items() if v[0].contaminated} == {2, 3, 4} and got[2][0].item_ids == [1]
    many = by_id(decontaminate.contamination(docs, items, decontaminate.Plan(shard=64)))
    assert {k: v[0].item_ids for k, v in many.items()} == {k: v[0].item_ids for k, v in got.items()}
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.clean(docs, items).columns == docs.columns


def test_a_benchmark_of_several_parts_gives_the_same_rows(spark):
    items = spark.createDataFrame([(k, f"{BASE} item number {k} " + "abc def " * k) for k in range(20)] + [(50, "only a short one")], "item_id long, text string")
    rows = spark.createDataFrame([(None, BASE + " item number 4 abc def"), (1, f"x {BASE} item number 7 "), (1, "clean"), (None, "clean as well"), (2, "Only a short one")], "doc_id long, text string")
    key = lambda r: str(r)
    one = sorted(decontaminate.contamination(rows, items).collect(), key=key)
    many = sorted(decontaminate.contamination(rows, items, decontaminate.Plan(shard=600)).collect(), key=key)
    assert one == many and sum(r.contaminated for r in one) == 3
    for plan in (decontaminate.Plan(), decontaminate.Plan(shard=600)):
        assert sorted(r.text for r in decontaminate.clean(rows, items, plan).collect()) == ["clean", "clean as well"]


def test_quality(spark, docs, none):
    good, bad = "A calm sentence about the sea. ", "BUY!! NOW!! $$$ ### BUY!! "
    own = spark.createDataFrame([(k, (good if k % 2 else bad) * (k % 5 + 1), "en", "s") for k in range(400)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(own, labels).collect()}
    assert all(got[k].keep == bool(k % 2) for k in range(200, 400))
    assert quality.quality(docs, labels.limit(0)).where("keep").count() == 12
    assert quality.quality(none, labels).count() == 0 and quality.good(docs, labels.limit(0)).columns == docs.columns


def test_pipeline(spark):
    import corpus_pipeline

    whole = read(spark, SF, "documents").count()
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0.6 * whole < len(got) < whole and len({r.doc_id for r in got}) == len(got)
    assert all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in got)
