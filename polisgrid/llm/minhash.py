"""Operator 3: near-duplicates by b-bit MinHash signatures and a multi-index Hamming join.

A signature has K symbols of 8 bits, the low bits of K minima over the document's shingles. It is cut into m chunks;
two signatures that differ in at most T symbols have, by the pigeonhole principle, a chunk with at most e = T // m
differing symbols. With e = 1 such chunks share a key in which one symbol is masked, so equal keys find all pairs
within T. A pair with a similarity of 0.85 differs in 9.6 of 64 symbols on average; more than T = 19 have a
probability of 0.001. Links are confirmed on the full sets.

A candidate pair must also be within 57 of all 256 symbols, of which the first 64 make the keys: of pairs at 0.85, one
in two thousand is not, while pairs at 0.7 seldom are.

Documents with equal sets form a class; only its smallest doc_id takes part in the search. Within a key, members are
compared with three of them first (that of the largest class and two by hash); what components that leaves apart is
then compared in full, in blocks.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgrid.llm.links import components
from polisgrid.llm.shared import Table
from polisgrid.llm.textcore import mix, text_slices, word_hashes

WORDS = 5


@dataclasses.dataclass(frozen=True)
class Plan:
    symbols: int = 64
    chunks: int = 10
    distance: int = 19
    checked: int = 256
    checked_distance: int = 57
    percent: int = 85
    block: int = 1024

    def cuts(self) -> list[int]:
        return [round(k * self.symbols / self.chunks) for k in range(self.chunks + 1)]

    def keys(self) -> list[tuple[int, list[int]]]:
        """(chunk, its symbols without the masked one); no symbol is masked where no error is allowed."""
        if self.distance // self.chunks > 1:
            raise ValueError("keys mask one symbol: distance must be under 2 * chunks")
        out = []
        for c, (a, b) in enumerate(zip(self.cuts(), self.cuts()[1:], strict=False)):
            masks = range(a, b) if self.distance >= self.chunks else [-1]
            out += [(c, [s for s in range(a, b) if s != x]) for x in masks]
        return out


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and the number of each."""
    hashes, before = word_hashes(data, offsets)
    counts = np.diff(before)
    with np.errstate(over="ignore"):
        n = len(hashes)
        rolled = np.full(n, 0x51ED270B0A1F39C1, np.uint64)
        for k in range(WORDS):  # each place gets the hash of the five words from it on
            part = np.zeros(n, np.uint64)
            part[: max(0, n - k)] = hashes[k:]
            rolled = mix(rolled * np.uint64(0x9FB21C651E98DF25) + part)
    # A document of n words has n - 4 shingles, or one of all its words if they are fewer than five.
    per = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), per)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(before[:-1], per)
    own = rolled[at]
    for d in np.flatnonzero((counts > 0) & (counts < WORDS)):
        h = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for x in hashes[before[d] : before[d + 1]]:
                h = mix(np.array([h * np.uint64(0x9FB21C651E98DF25) + x]))[0]
        own[int(per[:d].sum())] = h
    order = np.argsort(own)
    order = order[np.argsort(doc[order], kind="stable")]
    own, doc = own[order], doc[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    return own[new], np.bincount(doc[new], minlength=len(counts))


def signatures(sets: np.ndarray, counts: np.ndarray, symbols: int) -> np.ndarray:
    """Rows of 8-bit symbols; documents without shingles get zeros."""
    rng = np.random.default_rng(8500)
    a = rng.integers(1, 2**63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(counts), symbols), np.uint8)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        with np.errstate(over="ignore"):
            for k in range(symbols):
                least = np.minimum.reduceat(mix_light(sets * a[k]), starts)
                out[full, k] = mix(least).astype(np.uint8)
    return out


def mix_light(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(32))


def _prints(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; 0 for an empty one."""
    out = []
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        for salt in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93):
            total = np.append(np.uint64(0), np.cumsum(mix(sets ^ np.uint64(salt))))
            h = mix((total[ends] - total[ends - counts]) + counts.astype(np.uint64))
            out.append(np.where(counts > 0, h, 0).view(np.int64))
    return out[0], out[1]


def _sketch(docs: DataFrame, plan: Plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                sets, counts = shingles(data, offsets)
                one, two = _prints(sets, counts)
                sig = signatures(sets, counts, plan.checked)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": rows.column(0), "n_shingles": pa.array(counts.astype(np.int64)), "p1": pa.array(one), "p2": pa.array(two), "sig": pa.array([x.tobytes() for x in sig], pa.binary())}
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, p1 long, p2 long, sig binary")


def _keys(reps: DataFrame, plan: Plan) -> DataFrame:
    wanted = plan.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, plan.checked)
            out = np.zeros((len(wanted), n), np.uint64)
            with np.errstate(over="ignore"):
                for j, (chunk, cols) in enumerate(wanted):
                    block = np.zeros((n, 8), np.uint8)
                    block[:, : len(cols)] = sig[:, cols]  # up to 8 symbols fit without loss
                    out[j] = mix(block.view("<u8")[:, 0] ^ mix(np.array([j * 1000 + chunk + 1], np.uint64))[0])
            copies = batch.column(2).to_numpy()
            number = np.repeat(np.arange(len(wanted), dtype=np.int32), n)
            yield pa.RecordBatch.from_pydict({"key": pa.array(out.ravel().view(np.int64)), "j": pa.array(number), "id": pa.array(np.tile(ids, len(wanted))), "copies": pa.array(np.tile(copies, len(wanted)))})

    if max(len(c) for _, c in wanted) > 8:
        raise ValueError("a key holds eight symbols at most")
    return reps.select("id", "sig", "copies").mapInArrow(run, "key long, j int, id long, copies long")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                sets, counts = shingles(data, offsets)
                one, two = _prints(sets, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(one), pa.array(two), lists], names=["id", "p1", "p2", "set"])

    return docs.mapInArrow(run, "id long, p1 long, p2 long, set array<long>")


def _met(pairs: DataFrame, held: DataFrame, hubs: DataFrame, value: str) -> DataFrame:
    """pairs (a, b, hub, parts) with the value of both ends from held (id, value), as va and vb.

    An end that many pairs share is their hub: what is held of it is copied to as many parts as hubs (id, parts) says,
    and its pairs are dealt over them by their other end. The other ends have few pairs each.
    """
    spoke = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    dealt = pairs.select("a", "b", "hub", spoke.alias("spoke"), F.pmod(F.xxhash64(spoke), F.col("parts")).alias("part"))
    copies = held.join(hubs, "id", "left").select(F.col("id").alias("hub"), F.col(value).alias("vh"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part"))
    both = dealt.join(held.select(F.col("id").alias("spoke"), F.col(value).alias("vs")), "spoke").join(copies, ["hub", "part"])
    first = F.col("hub") == F.col("a")
    return both.select("a", "b", "hub", "part", F.when(first, F.col("vh")).otherwise(F.col("vs")).alias("va"), F.when(first, F.col("vs")).otherwise(F.col("vh")).alias("vb"))


def _linked(pairs: DataFrame, sets: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the similarity."""
    both = _met(pairs, sets, hubs, "set").withColumn("common", F.size(F.array_intersect("va", "vb")))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("va") + F.size("vb") - F.col("common"))).select("a", "b")


def _apart(members: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of different components within the distance, each once, from rows (key, id, comp, i, j, side, number,
    sig) sorted by group."""

    cuts = np.array(plan.cuts())
    allowed = int(plan.distance >= plan.chunks)

    def first_key(differ: np.ndarray) -> np.ndarray:
        """The number of the first key that two signatures share: elsewhere the pair is not given again."""
        wrong = np.add.reduceat(differ, cuts[:-1], axis=1, dtype=np.int64)
        chunk = (wrong <= allowed).argmax(1)
        if not allowed:
            return chunk
        at = cuts[chunk]
        inside = (np.arange(plan.symbols) >= at[:, None]) & (np.arange(plan.symbols) < cuts[chunk + 1][:, None])
        return np.where(wrong[np.arange(len(at)), chunk] == 0, at, (differ & inside).argmax(1))

    def pairs(ids: np.ndarray, comp: np.ndarray, sig: np.ndarray, side: np.ndarray, same: bool, number: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        for x in left:
            ok = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) if same else True)]
            ok = ok[(sig[ok, : plan.symbols] != sig[x, : plan.symbols]).sum(1) <= plan.distance]
            ok = ok[(sig[ok] != sig[x]).sum(1) <= plan.checked_distance]
            ok = ok[first_key(sig[ok, : plan.symbols] != sig[x, : plan.symbols]) == number]
            if len(ok):
                yield np.full(len(ok), ids[x]), ids[ok]

    def batch_of(found: list) -> pa.RecordBatch:
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def emit(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            _, ids, comp, i, j, side, number = (np.concatenate([r[k] for r in rows]) for k in range(7))
            sig = np.concatenate([r[7] for r in rows])
            out, n = [], 0
            for x in pairs(ids, comp, sig, side, bool(i[0] == j[0]), int(number[0])):
                out.append(x)
                n += len(x[0])
                if n >= 50_000:
                    yield batch_of(out)
                    out, n = [], 0
            if out:
                yield batch_of(out)

        last = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            sig = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(batch.num_rows, plan.checked)
            group = np.column_stack([cols[0], cols[3], cols[4]])
            cut = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(group)]
            for s, e in zip(cut, cut[1:], strict=False):
                if s == e:
                    continue
                now = tuple(group[s])
                if last is not None and now != last:
                    yield from emit(held)
                    held = []
                last = now
                held.append([c[s:e] for c in cols] + [sig[s:e]])
        if held:
            yield from emit(held)

    return members.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id, kept of every row.

    doc_id is taken as unique; rows that repeat it with another text share their links, which are those of the text with
    the least fingerprints. A null or empty text has no shingle, no link, and is its own component; a row without doc_id
    is likewise alone (component_id null, kept true). Texts of any length are taken whole. Other columns are ignored; an
    empty table gives no row. The result is a table in the shared folder; all others made on the way are removed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = Table(_sketch(rows, plan), "sketch")
    full = sketch.df.where("n_shingles > 0 and doc_id is not null")
    reps = Table(full.groupBy("p1", "p2").agg(F.min("doc_id").alias("id")), "reps")
    # One signature for each id: the first by its prints, should several texts share a doc_id.
    classes = full.groupBy("p1", "p2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    one = Table(classes.groupBy("id").agg(F.min_by(F.struct("sig", "copies"), F.struct("p1", "p2")).alias("v")).select("id", "v.sig", "v.copies"), "signatures")
    own = Table(sketch.df.select("doc_id", "n_shingles", "p1", "p2"), "prints")
    sketch.drop()
    keys = _keys(one.df, plan)
    several = keys.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("n")).where("x < y")
    shared = Table(keys.join(several.select("key", F.ceil(F.col("n") / plan.block).cast("long").alias("parts")), "key"), "keys")
    firsts = [F.max_by("id", F.struct("copies", -F.col("id"))).alias("c0"), *(F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"c{k}") for k in (1, 2))]
    # Stored, so that the join with a large key's members is one of two scans, which Spark can split.
    centres = Table(shared.df.groupBy("key").agg(*firsts).select("key", F.array_distinct(F.array("c0", "c1", "c2")).alias("centres")), "centres")
    candidates = shared.df.select("id").distinct()
    texts = _sets(rows.join(candidates.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"))
    sets = Table(texts.groupBy("id").agg(F.min_by("set", F.struct("p1", "p2")).alias("set")), "sets")
    # Each member of a key against its centres; a centre with many members is copied to several parts.
    to = shared.df.join(centres.df, "key").select("id", "parts", F.explode("centres").alias("c"))
    hubs = Table(to.where("parts > 1").groupBy(F.col("c").alias("id")).agg(F.max("parts").alias("parts")), "hubs")
    ends = to.where("id != c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"), F.struct("parts", F.col("c").alias("hub")).alias("at"))
    stars = Table(ends.groupBy("a", "b").agg(F.max("at").alias("at")).select("a", "b", "at.hub", "at.parts"), "stars")
    close = Table(_within(_met(stars.df, one.df, hubs.df, "sig"), plan), "close")
    found = Table(_linked(close.df.join(stars.df, ["a", "b"]), sets.df, hubs.df, plan.percent), "links")
    close.drop()
    roots = components(found.df)
    # Keys whose members are still in several components.
    comp = shared.df.select("key", "j", "id").join(roots.df, "id", "left").select("key", "j", "id", F.coalesce("root", "id").alias("comp"))
    several = comp.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key", "n")
    members = comp.join(several, "key").join(one.df.select("id", "sig"), "id")
    members = members.withColumn("parts", F.ceil(F.col("n") / plan.block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("key", "id", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), F.col("j").alias("number"), "sig")
    members = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = _apart(members, plan).join(stars.df, ["a", "b"], "left_anti").select("a", "b", F.col("b").alias("hub"), F.lit(1).alias("parts"))
    more = Table(_linked(rest, sets.df, hubs.df.limit(0), plan.percent), "links")
    last = components(found.df.union(more.df))
    groups = reps.df.join(last.df, "id", "left").select("p1", "p2", F.coalesce("root", "id").alias("component_id"))
    searched = own.df.where("n_shingles > 0 and doc_id is not null").join(groups, ["p1", "p2"]).select("doc_id", "n_shingles", "component_id")
    alone = own.df.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = Table(searched.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")
    for table in (reps, one, own, shared, centres, sets, hubs, stars, found, roots, more, last):
        table.drop()
    return out.df


def _within(both: DataFrame, plan: Plan) -> DataFrame:
    """Pairs whose signatures differ in at most so many symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, plan.checked) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((one != two).sum(1) <= plan.checked_distance))

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")
