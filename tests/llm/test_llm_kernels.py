"""The kernels against plain versions and the public libraries."""

import base64
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from polisgrid.llm import automaton, bpe, decontaminate, itq, language, minhash, ngram, records, secrets, textcore, toxicity

ODD = [None, "", " ", "  a", "\n\n b", "it's  x", "é× a÷b", "a b  c", "日本 語, x", "naïve\n\nté 12 3a", "don't!? \t\n x\n", "a\n", "\nb\n \nc", "<|endoftext|> x", "a <|endoftext|> b", "<|endof", "text|>", "a<|endoftext|><|endoftext|>", "x" * 3000, "aaaaaaa aaaa", "ab" * 500, " x  y", "A, b.C\r\n;d"]


def flat(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(np.array([len(x) for x in raw], np.int64)))


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for c, e in zip(counts, ends, strict=True)]


def test_both_encoders_match_the_library(reference):
    data, offsets = flat(ODD)
    want = [reference.encode_ordinary(t or "") for t in ODD]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert split(*records.encode(data, offsets, P.path("byte_bpe_50k.json"))) == [library.encode(t or "", add_special_tokens=False).ids for t in ODD]
    ranks = bpe.ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids, counts = ranks.encode(data, offsets)
    assert split(ids, counts) == want
    assert ranks.decode(ids)[0].tobytes() == data.tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .,'\n\tés日🙂1ſ ÀŒ-")), max_size=30), max_size=4))
def test_encoders_on_random_texts(reference, texts):
    data, offsets = flat(texts)
    want = [reference.encode_ordinary(t) for t in texts]
    assert split(*records.encode(data, offsets, P.path("byte_bpe_50k.json"))) == want
    assert split(*bpe.ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode(data, offsets)) == want


def test_checksum():
    def plain(b):
        c = 0xFFFFFFFF
        for y in b:
            c ^= y
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 * (c & 1))
        c ^= 0xFFFFFFFF
        return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF

    counts = np.array([2, 3, 255, 256, 257, 700])
    units = np.random.default_rng(1).integers(0, 65536, counts.sum()).astype(np.uint16)
    ends = np.cumsum(counts)
    assert records.masked_crc32c(units, counts).tolist() == [plain(units[e - c : e].tobytes()) for c, e in zip(counts, ends, strict=True)]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets_against_regular_expressions():
    random.seed(3)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN", "x", "é", "\n", "0" * 16, "a1", "==", "token=", "ſecret"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 30))) for _ in range(3000)] + [None, ""]
    data, offsets = flat(texts)
    found = secrets.find(data, offsets, secrets.BASE)
    got = [secrets._points((t or "").encode(), found.get(k, [])) for k, t in enumerate(texts)]
    assert got == [plain_secrets(t or "") for t in texts]


def test_secrets_in_long_texts_are_those_of_regular_expressions(monkeypatch):
    random.seed(4)
    bits = ["password", "token", "=", ":", " ", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN", "a1", "\n", "f" * 5000, "Z" * 3000, "é"]
    texts = ["".join(random.choice(bits) for _ in range(n)) for n in (40, 100, 300)] + ["token=" + "a" * 20_000, "AKIA" + "Q" * 9000]
    for lane in (7, 64, 4096):
        monkeypatch.setattr(secrets, "_LANE", lane)
        found = secrets.find(*flat(texts), secrets.BASE)
        assert [secrets._points(t.encode(), found.get(k, [])) for k, t in enumerate(texts)] == [plain_secrets(t) for t in texts]


def test_secrets_in_a_text_of_five_megabytes():
    text = "some words and more\n" * 250_000 + "token=abcdefghijklmnop"
    found = secrets.find(*flat([text, "x"]), secrets.BASE)
    assert found == {0: [(5_000_000, 0, 5_000_022)]}


def test_public_formats_are_found_beside_base_kinds():
    texts = ["x ghp_" + "a1B2" * 9 + " y", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK", "ghp_short"]
    found = secrets.find(*flat(texts), secrets.BASE + secrets.MORE)
    names = [[(secrets.BASE + secrets.MORE)[k].name for _, k, _ in found.get(d, [])] for d in range(4)]
    assert names == [["github"], ["pem"], ["jwt"], []]
    assert secrets.redacted(pa.array([None, "a token=abcdefghijkl z"])).to_pylist() == [None, "a [assign] z"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=12))
def test_automata_agree_with_re(text):
    for pattern in ("ab*c", "(a|bc)+", "a{2,3}b?", "[^a]c", "(ab|a)(c|bc)"):
        dfa = automaton.compile_rules([automaton.parse(automaton.Rule("r", pattern))], False)
        longest = secrets.Scanner.run(dfa, text.encode(), range(len(text)))
        assert longest == max((n for n in range(1, len(text) + 1) if re.fullmatch(pattern, text[:n])), default=0)


def test_shingle_sets():
    texts = [None, "", "a", "A a", "a b c d e", "x y z a b c d e x y z a b", " \t\n"]
    sets, counts = minhash.shingles(*flat(texts))
    plain = []
    for t in texts:
        w = (t or "").lower().split()
        plain.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    assert counts.tolist() == [len(s) for s in plain]
    for s, h in zip(plain, np.split(sets, np.cumsum(counts)[:-1]), strict=True):
        assert len(set(h.tolist())) == len(s)
    a, b = minhash.shingles(*flat(["p q r s t u", "q r s t u v"]))
    assert len(set(a[: b[0]].tolist()) & set(a[b[0] :].tolist())) == 1


def test_keys_find_all_pairs_within_the_distance():
    plan = minhash.Plan()
    rng = np.random.default_rng(0)
    keys = plan.keys()
    for _ in range(300):
        a = rng.integers(0, 256, plan.symbols)
        b = a.copy()
        at = rng.choice(plan.symbols, plan.distance, replace=False)
        b[at] = (b[at] + 1) % 256
        assert any((a[cols] == b[cols]).all() for _, cols in keys)


def test_subsequence_kernel():
    def plain(s, t, decay=0.6):
        total = 0.0
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    for x in range(len(t)):
                        for y in range(x + 1, len(t)):
                            for z in range(y + 1, len(t)):
                                if (s[i], s[j], s[k]) == (t[x], t[y], t[z]):
                                    total += decay ** (k - i + 1 + z - x + 1)
        return total

    for s, t in (("idiot", "i.d.i.ot"), ("stupid", "stuupid"), ("abc", "abd")):
        a, b = (np.frombuffer(x.encode(), np.uint8).astype(np.int16)[None] for x in (s, t))
        assert float(toxicity.kernel(a, b, 0.6)[0]) == pytest.approx(plain(s, t), rel=1e-4)


def test_landmarks_of_a_small_language():
    rng = np.random.default_rng(3)
    insults = ["".join(rng.choice(list("abcdefghijklm"), 8)) for _ in range(70)]  # of the large language
    texts = [" ".join(["plain", *rng.choice(insults, 15)]) for _ in range(300)] + ["nada zorvuqy"] * 6 + ["plain words"] * 1500 + ["nada otras"] * 500
    labels = np.repeat([1, 0], [306, 2000])
    _, neg, word, doc, spelled = toxicity.tally(*flat(texts), labels)
    counts = np.column_stack([np.bincount(word, minlength=len(neg)), neg])
    assert {w: tuple(c) for w, c in zip(spelled, counts.tolist(), strict=True)} == {w.encode(): tuple(sum(w in t.split() for t, y in zip(texts, labels, strict=True) if y == k) for k in (1, 0)) for w in {w for t in texts for w in t.split()}}
    plan = toxicity.Plan()
    held = [(w, *c, doc[word == k].tolist()) for k, (w, c) in enumerate(zip(spelled, counts.tolist(), strict=True))]
    found = toxicity.pick(held, 306, 2000, plan)
    assert b"zorvuqy" in found and b"plain" not in found and b"nada" not in found
    marks = toxicity.Landmarks(found, plan)
    row, mark, value, own, totals = marks.sparse(*flat(texts))
    weights, last = toxicity.fit(marks, [(row, mark, value, own)], labels, totals, plan)
    x, doc, totals = marks.sentences(*flat(["otras zorvuqy", "otras nada", insults[0]]))
    score = 1 / (1 + np.exp(-toxicity._summary(x @ weights[:-1] + weights[-1], doc, totals) @ last))
    assert (score >= plan.threshold).tolist() == [True, False, True]


def test_copies_are_kin():
    base = " ".join(f"word{k}" for k in range(200))
    found = toxicity.kin(*flat([base, base, base + " end", "quite another text with words of its own", None, "two words"]))
    assert found[0] == found[1] == found[2] and len(set(found.tolist())) == 4 and found[4] == 0


def test_forward_backward_in_segments():
    rng = np.random.default_rng(2)
    model = language.Model(["a", "b", "c"], rng.normal(size=(1 << 10, 3)).astype(np.float32), rng.normal(size=(3, 3)), 1 << 10)
    texts = [" ".join(rng.choice(["ab", "cd", "e", "fgh", "12"], n)) for n in (1, 5, 127, 128, 129, 700)] + [""]
    data, offsets = flat(texts)
    sums, number = model.sums(data, offsets)
    move = np.exp(model.moves - model.moves.max())
    for d, t in enumerate(texts):
        starts, lens, _ = textcore.words(*flat([t]))
        if not len(starts):
            assert number[d] == 0
            continue
        e = model.potentials(flat([t])[0], starts, lens)
        f, v = [], np.ones(3) / 3
        for x in e:
            v = v @ move * x
            v = v / v.sum()
            f.append(v)
        total, b = np.zeros(3), np.ones(3)
        for x, y, w in zip(e[::-1], f[::-1], t.split()[::-1], strict=True):
            m = y * b
            total += m / m.sum() * (not w.isdigit())
            b = move @ (x * b)
            b = b / b.sum()
        assert sums[d] == pytest.approx(total)


def test_training_takes_whole_texts():
    rng = np.random.default_rng(4)

    def text(letters, n):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))

    head = text("xyz", 130)  # the same for both languages
    texts = [head + " " + text("abcde", 200) for _ in range(40)] + [head + " " + text("fghij", 200) for _ in range(40)]
    texts += [text("klmno", 7) for _ in range(40)] + ["".join(rng.choice(list("一丁七万丈"), 40)) for _ in range(40)]
    model = language.train(texts, ["a"] * 40 + ["b"] * 40 + ["short"] * 40 + ["none"] * 40, language.Plan())
    sums, _ = model.sums(*flat([text("abcde", 60), text("fghij", 60), text("klmno", 60), "".join(rng.choice(list("一丁七万丈"), 60))]))
    assert [model.langs[k] for k in sums.argmax(1)] == ["a", "b", "short", "none"]
    doc, begin = language.pieces(np.array([0, 0, 5, 35, 400]), 30)
    assert doc.tolist() == [1, 2] + [3] * 13 and begin.tolist() == [0, 5, *range(35, 400, 30)]


def test_edit_budget():
    random.seed(5)
    base = "the quick brown fox jumps over the lazy dog while seventeen small zebras watch it from a hill far away today"
    index = decontaminate.Searcher([(7, base), (8, "tiny")], decontaminate.Plan())
    window = index.indexes[0].windows[0][1].tobytes().decode()
    k = int(index.indexes[0].edits[0])

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        return min(row)

    for n in range(60):
        t = list(base)
        for _ in range(random.choice([0, 3, k - 2, k, k + 2, 2 * k])):
            at = random.randrange(len(t))
            r = random.random()
            if r < 0.4:
                t[at] = "%"
            elif r < 0.7:
                t.insert(at, "#")
            else:
                del t[at]
        text = "pad " * (n % 7) + "".join(t) + " end" * (n % 5)
        doc, _ = index.search(*flat([text]))
        assert bool(len(doc)) == (distance(window, text) <= k), (n, distance(window, text), k)


def test_windows_begin_at_every_place():
    random.seed(6)
    whole = "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(240))
    index = decontaminate.Searcher([(7, whole)], decontaminate.Plan())
    for at in range(len(whole) - 119):
        quote = list(whole[at : at + 120])
        for k in random.sample(range(1, 119), 12 * (at % 2)):  # exact, or with the whole edit budget used
            quote[k] = "%"
        for text in ("0" * 30 + "".join(quote) + "0" * 30, "".join(quote), whole[200:] + "".join(quote)):
            doc, _ = index.search(*flat([text]))
            assert len(doc), at
    for at in range(0, 140, 7):
        doc, _ = index.search(*flat(["0" * 30 + whole[at : at + 100] + "0" * 30]))
        assert not len(doc), at


def test_rotations_are_orthogonal_and_find_made_pairs():
    sample = np.random.default_rng(0).normal(size=(300, 16))
    model = itq.learn(sample, 100_000, itq.Plan(rounds=5))
    assert model.chunk == 9 and model.turns.shape == (16, 9 * model.tables)
    assert np.allclose(model.turns[:, :16].T @ model.turns[:, :16], np.eye(16))
    rng = np.random.default_rng(1)
    one = itq.unit(rng.normal(size=(3000, 16)))
    two = rng.normal(size=one.shape)
    two = itq.unit(two - (two * one).sum(1, keepdims=True) * one)
    two = 0.9 * one + np.sqrt(0.19) * two
    assert (model.bits(one) == model.bits(two)).all(2).any(1).mean() > 0.93


def test_labels_of_links():
    label = itq.joined(np.arange(8), np.array([0, 2, 5, 3]), np.array([1, 1, 6, 2]))
    assert label.tolist() == [0, 0, 0, 0, 4, 5, 5, 7]


def test_items_of_all_lengths_in_one_benchmark():
    items = [(1, "sixteen letters."), (2, "tiny"), (3, "a middling item of some forty characters"), (4, "long item " * 30 + "end"), (5, "Tiny"), (6, " ")]
    search = decontaminate.Searcher(items, decontaminate.Plan())
    texts = ["x Sixteen  letters. y", "it is tiny", "first\n  TINY \nlast", None, "", "so a middling item of some forty charakters", "long item " * 12, "tiny", "sixteen"]
    doc, item = search.search(*flat(texts))
    assert list(zip(doc.tolist(), item.tolist(), strict=True)) == [(0, 1), (2, 2), (2, 5), (5, 3), (6, 4), (7, 2), (7, 5)]


def test_frequent_grams_are_expanded_some_at_a_time(monkeypatch):
    rng = random.Random(5)
    items = [(k, "the same beginning of every item, and then " + "".join(rng.choice("abcdef ") for _ in range(100))) for k in range(40)]
    texts = ["the same beginning of every item " * 20 + items[7][1] + " zz" * 50, "z" * 700, items[3][1], None]
    want = [x.tolist() for x in decontaminate.Searcher(items, decontaminate.Plan()).search(*flat(texts))]
    monkeypatch.setattr(decontaminate, "_EXPANDED", 50)
    assert [x.tolist() for x in decontaminate.Searcher(items, decontaminate.Plan()).search(*flat(texts))] == want == [[0, 2], [7, 3]]


def test_a_very_long_text_is_searched_whole():
    item = "what stands in the benchmark must be found wherever it stands in a text, at its very end as well, and across the cuts"
    search = decontaminate.Searcher([(1, item)], decontaminate.Plan())
    for at in (0, (2 << 20) - 50, (4 << 20) + 5, 6_000_000):
        text = "y" * at + item.upper() + "y" * (6_000_000 - at)
        assert [x.tolist() for x in search.search(*flat([text]))] == [[0], [1]]
    assert not len(search.search(*flat(["y" * 6_000_000]))[0])


def test_packed_hashes():
    rng = np.random.default_rng(2)
    for low in (0, 12345, 7 << 50):
        x = np.unique(np.concatenate([np.uint64(low) + rng.integers(0, 1 << 52, 200, dtype=np.uint64), np.uint64(low) + np.arange(5, dtype=np.uint64)]))
        raw = ngram.packed(x, low)
        assert (ngram.unpacked(raw, low) == x).all() and len(raw) < 400 + 13 * len(x)
    assert not len(ngram.unpacked(ngram.packed(x[:0], 0), 0))


def test_keys_become_narrower_where_rotations_do_not_suffice():
    x = np.random.default_rng(2).standard_normal((3000, 6))
    wide, narrow = itq.learn(x, 1 << 22, itq.Plan()), itq.learn(x, 1 << 22, itq.Plan(most=6))
    assert narrow.chunk < wide.chunk and narrow.turns.shape[1] <= 6 * 6
    with pytest.raises(ValueError, match="recall"):
        itq.learn(x, 1 << 22, itq.Plan(most=1, recall=1.1))
