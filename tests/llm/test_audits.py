"""Source divergence, WARC archives and the filter audit against plain versions, and on odd tables."""

import collections
import gzip
import io
import itertools
import re

import duckdb
import numpy as np
import pytest
import xxhash

from polisgrid.llm import divergence, filters, warc
from polisgrid.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "documents pages labels".split()


@pytest.mark.parametrize("name", ["op11_divergence", "op12_warc", "op13_filters"])
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    given = [c[0] for c in cur.description]
    assert sorted(given) == sorted(df.columns)
    assert sorted((tuple(r[k] for k in given) for r in df.collect()), key=str) == sorted(cur.fetchall(), key=str)


# Divergence


def plain_divergence(rows, least):
    counts, docs, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        terms = sorted(t for (k, t), n in docs.items() if k == lang and n >= least)
        sources = sorted(s for k, s in groups if k == lang)
        p = {}
        for s in sources:
            n = [counts[lang, s, t] for t in terms]
            p[s] = [1 + 10**9 * (x + 5) // (sum(n) + 5 * len(terms)) for x in n]
        every = [sum(counts[lang, s, t] for s in sources) for t in terms]
        q = [1 + 10**9 * (x + 5) // (sum(every) + 5 * len(terms)) for x in every]
        for s in sources:
            pairs = [(-sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s]
            over = [(-(x - y), t.encode()) for x, y, t in zip(p[s], q, terms, strict=True) if x > y and counts[lang, s, t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, 50)):
                out |= {(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(found)[:most])}
    return out


def test_divergence_is_exact(spark):
    rng = np.random.default_rng(5)
    words = ["Ab", "ab", "c", "élan", "ÉLAN", "naïve", "字字", "x" * 40, *(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(150))]
    rows = []
    for k in range(300):
        text = " ".join(words[int(x)] + ["", "1", "-", "'s"][int(x) % 4] for x in np.minimum(rng.geometric(0.03, int(rng.integers(0, 60))), len(words) - 1))
        rows.append((["en", "de", None, "xx"][k % 4 if k < 290 else 3], [None, "a", "ä", "b"][int(rng.integers(4))], text if k % 11 else None))
    rows += rows[:20] + [("only", "one", "words " * 3), ("none", "p", "1 2 3"), ("none", "q", None)]
    rows.append(("en", "a", "Long text, " * 900_000))  # over two slices
    df = spark.createDataFrame([(k, t, lang, s, "v", 1) for k, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, value string, rank int").repartition(5)
    got = [tuple(r) for r in divergence.divergence(df, 7).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_divergence(rows, 7)
    assert divergence.divergence(df.where("false")).count() == 0


def test_hashes_and_groups():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 6000, dtype=np.uint8)
    lens = rng.integers(1, 70, 900)
    lens[:600] = rng.integers(1, 4, 600)
    starts = rng.integers(0, 5900, 900)
    raw = [data[s : s + n].tobytes() for s, n in zip(starts, lens, strict=True)]
    assert divergence.xxh64(data, starts, lens).tolist() == [xxhash.xxh64_intdigest(x) for x in raw]
    for hashes in (divergence.xxh64, lambda d, s, n: (n % 5).astype(np.uint64)):  # the second one has many clashes
        first, back = divergence.grouped(data, starts, lens, hashes)
        assert [raw[first[b]] for b in back] == raw and len(first) == len(set(raw))


def test_shares_beyond_64_bits():
    n, total = np.array([0, 7, 4 * 10**15, 10**6]), 4 * 10**15 + 10**6 + 7
    assert divergence.share(n, total, 4).tolist() == [1 + 10**9 * (int(x) + 5) // (total + 20) for x in n]


def test_pieces_of_a_text():
    raw = np.frombuffer(("word " * 50 + "x" * 300 + " end").encode(), np.uint8)
    pieces = list(divergence._pieces(raw, 64))
    assert b"".join(p.tobytes() for p in pieces) == raw.tobytes() and max(map(len, pieces)) > 300
    assert [t for p in pieces for t in re.findall(rb"[a-z]+", p.tobytes())] == re.findall(rb"[a-z]+", raw.tobytes())


# WARC

PAGES = [(1, None, None), (2, "http://a b", ""), (3, "u", "x" * 50), (4, None, "x" * 50), (4, "twice", "x" * 50), (None, None, "x" * 50), (None, "n", "only"), (7, "long", "é\r\n\r\nWARC/1.1" * 300_000), (9, "é", "<p>ü</p>")]


def pages(spark, parts=3):
    return spark.createDataFrame([(*p, "d", 3) for p in PAGES], "page_id long, url string, html string, digest string, seq int").repartition(parts)


def test_warc_types_and_digests(spark):
    got = warc.warc(pages(spark)).collect()
    plain = collections.Counter()
    for page, _, html in PAGES:
        raw = (html or "").encode()
        latest = max((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        revisit = latest is not None and page != latest
        plain[page, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", latest if revisit else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain
    assert warc.warc(pages(spark).where("false")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    got = warc.warc(pages(spark), f"file://{tmp_path}/w", least=51).collect()
    assert {r.record_type for r in got} == {"response"}


def test_every_record_is_a_member_of_its_own(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    got = warc.warc(pages(spark, 2), folder).collect()
    for r in got:
        record = warc.read_record(folder, r.archive, r.offset, r.length)
        assert warc.described(record) == (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        if r.record_type == "revisit":
            assert record.fields["warc-profile"].endswith("identical-payload-digest") and record.block.endswith(b"\r\n\r\n")
            named = [x for x in got if x.page_id == r.refers_to and x.record_type == "response" and x.payload_digest == r.payload_digest]
            assert record.fields["warc-refers-to"] == warc.read_record(folder, named[0].archive, named[0].offset, named[0].length).fields["warc-record-id"]
    for archive in {r.archive for r in got}:
        index = warc.read_index(folder, archive)
        raw = (tmp_path / "w" / f"{archive}.warc.gz").read_bytes()
        assert index["offset"].tolist() == [0, *np.cumsum(index["length"]).tolist()][:-1] and int(index["length"].sum()) == len(raw)
        assert len(list(warc.parsed(warc.inflated(io.BytesIO(raw), 100)))) == len(index)


def test_streams_of_any_members_and_broken_ones():
    one = warc.response(1, "u", b"a" * 5000, warc.base32_sha1(b"a" * 5000))
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nX-Long: first\r\n second\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for raw in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two), gzip.compress(one[:70]) + gzip.compress(one[70:] + two)):
        for piece in (1, 7, 1 << 20):
            records = list(warc.parsed(warc.inflated(io.BytesIO(raw), piece)))
            assert [r.fields["warc-type"] for r in records] == ["response", "metadata"] and records[1].fields["x-long"] == "first second" and records[1].block == b"abc"
    with pytest.raises(ValueError, match="ends inside a gzip member"):
        list(warc.inflated(io.BytesIO(gzip.compress(one)[:-12])))
    with pytest.raises(ValueError, match="cut"):
        list(warc.parsed(iter([one[:-5]])))
    with pytest.raises(ValueError, match="no record begins"):
        list(warc.parsed(iter([b"HTTP/1.1 200\r\n\r\n"])))
    with pytest.raises(ValueError, match="not the one"):
        warc.described(next(warc.parsed(iter([one.replace(b"aaa", b"aab", 1)]))))


# Filters


def plain_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = collections.defaultdict(lambda: [0] * 6)
    for d, t, lang in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > first[text]}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order):
                x = out[lang or "", "".join(order), k + 1]
                x[0] += not gone and not fails[f]
                x[1] += fails[f] and not gone
                x[2] += fails[f] and gone
                x[3] += fails[f] and sum(fails.values()) == 1
                x[4] += fails[f] and not gone and d in good and d is not None
                x[5] += fails[f] and not gone and d in toxic and d is not None
                gone = gone or fails[f]
    total = collections.Counter()
    for (part, order, k), x in out.items():
        total[part, order[k - 1]] += x[1]
    return {(*key, *x, total[key[0], key[1][key[2] - 1]]) for key, x in out.items()}


def test_audit_in_every_order(spark):
    rng = np.random.default_rng(8)
    docs = [(0, None, "en"), (1, "", "en"), (1, "", "en"), (2, " \t\n", None), (None, "", "de"), (None, "same", None), (5, "same", "de"), (5, "same", "de"), (4, "same", "en"), (6, "same", "en"), (6, "Same", "en")]
    docs += [(7, "word " * 250, "en"), (8, " ".join(f"w{k}" for k in range(250)), "en"), (9, "LOUD" + " ".join(f"w{k}" for k in range(300)), "de"), (10, "word\x0bword\x0cword é" * 40_000, "de"), (11, "x" * 3_000_000 + "#", "de")]
    docs += [(int(rng.integers(20, 60)), ["A b #", "c d", "C d", "é"][int(rng.integers(4))] * int(rng.integers(1, 3)), ["en", "de", None][int(rng.integers(3))]) for _ in range(150)]
    labels = [(1, 1, 0), (1, None, 1), (5, 1, None), (6, 0, 1), (None, 1, 1), (7, None, None), *((k, k % 2, k % 3 % 2) for k in range(20, 50))]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, lang string, n long, part string").repartition(4)
    known = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    got = [tuple(r) for r in filters.audit(df, known).select(names).collect()]
    assert len(got) == 3 * 600 and set(got) == plain_audit(docs, labels)
    assert filters.audit(df.where("false"), known).count() == 0
    none = {tuple(r) for r in filters.audit(df, known.where("false")).select(names).collect()}
    assert none == plain_audit(docs, [])
