"""Operator 5: near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

Rotations, each learned from another start on a bounded sample, turn a vector into balanced binary codes. The codes are
cut into chunks; each chunk is a table, and vectors with the same chunk share a cell. A chunk has about log2(N / cell)
bits, so cells stay of one size as N grows, and rotations are added until pairs at the least cosine, made from the
sample, meet in some table with the wanted probability. Vectors of each dimension have a model of their own.

What is shuffled for the tables are ids and codes. Within a cell, cut into blocks, pairs whose whole codes are near
become candidates in the first table in which they meet; their vectors are fetched and their cosine is computed in
double precision. A block with more than a few candidates for each of its members, as in a large group of near copies,
gives no pairs: its vectors are brought together and compared there, and only counts and a star of links are given out.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polisgrid.llm.links import components
from polisgrid.llm.shared import Table


@dataclasses.dataclass(frozen=True)
class Plan:
    cosine: float = 0.9
    recall: float = 0.97  # of made pairs at that cosine, by which tables are added
    bits: int = 64  # of one rotation's code, at most; also at most the dimension
    cell: int = 256  # vectors that share a chunk, about
    sample: int = 20_000  # vectors of each dimension that rotations are learned from, about
    rounds: int = 30
    most: int = 400  # rotations; if they don't suffice, keys become narrower
    block: int = 2048
    dense: int = 8  # candidates for each member from which on a block's vectors are brought together


@dataclasses.dataclass(frozen=True)
class Model:
    mean: np.ndarray
    turns: np.ndarray  # dimension x bits of all tables
    chunk: int  # bits of a table's key
    far: int  # bits in which a candidate's whole code may differ

    @property
    def tables(self) -> int:
        return self.turns.shape[1] // self.chunk

    def bits(self, unit: np.ndarray) -> np.ndarray:
        """n x tables x chunk."""
        return ((unit - self.mean) @ self.turns >= 0).reshape(len(unit), self.tables, self.chunk)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _enough(differ: np.ndarray, chunk: int, recall: float) -> int:
    """How many tables of so many bits bring made pairs together often enough; 0 if all of them do not."""
    tables = differ.shape[1] // chunk
    if not tables:
        return 0
    met = ~differ[:, : tables * chunk].reshape(len(differ), tables, chunk).any(2)
    enough = np.flatnonzero(np.maximum.accumulate(met, 1).mean(0) >= recall)
    return int(enough[0]) + 1 if len(enough) else 0


def learn(sample: np.ndarray, n: int, plan: Plan) -> Model:
    """The model for n vectors like the sample's."""
    data = unit(sample)
    dim = data.shape[1]
    mean = data.mean(0) if len(data) > 2 * dim else np.zeros(dim)
    centred = data - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    size = min(plan.bits, dim)
    principal = vectors[:, ::-1][:, :size]
    turned = centred @ principal
    chunk = int(np.clip(round(np.log2(max(1, n / plan.cell))), min(6, 2 * dim), 30))
    rng = np.random.default_rng(77)
    one = data[rng.integers(0, len(data), 2000)]
    two = rng.standard_normal(one.shape)
    two -= (two * one).sum(1, keepdims=True) * one
    two /= np.maximum(np.linalg.norm(two, axis=1, keepdims=True), 1e-300)
    two = one if dim == 1 else plan.cosine * one + np.sqrt(1 - plan.cosine**2) * two
    turns, differ, tables = np.zeros((dim, 0)), np.zeros((len(one), 0), bool), 0
    for k in range(plan.most):
        turn = np.linalg.qr(np.random.default_rng(500 + k).standard_normal((size, size)))[0]
        for _ in range(plan.rounds):  # the code nearest to the turned data, then the turn that fits the code best
            code = np.where(turned @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(turned.T @ code)
            turn = u @ v
        fresh = principal @ turn
        turns = np.column_stack([turns, fresh])
        differ = np.column_stack([differ, ((one - mean) @ fresh >= 0) != ((two - mean) @ fresh >= 0)])
        if tables := _enough(differ, chunk, plan.recall):
            break
    while not tables and chunk > 1:  # all rotations are made: narrower keys meet more often
        chunk -= 1
        tables = _enough(differ, chunk, plan.recall)
    if not tables:
        raise ValueError(f"{plan.most} rotations don't reach a recall of {plan.recall}")
    own = differ[:, : tables * chunk].sum(1)
    return Model(mean, turns[:, : tables * chunk], chunk, int(np.ceil(own.mean() + 4 * own.std())))


def _vectors(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim).astype(np.float64)


def _tables(vectors: DataFrame, models: dict[int, Model], kind: str) -> DataFrame:
    """(dimension, table, cell, id, n, whole code) of each vector (id, n, d, vec), once a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                model, rows = models[d], np.flatnonzero(dims == d)
                for at in range(0, len(rows), 2000):
                    batch = whole.take(pa.array(rows[at : at + 2000]))
                    n = batch.num_rows
                    bits = model.bits(unit(_vectors(batch.column(3), kind, d)))
                    cells = (bits @ (1 << np.arange(model.chunk))).astype(np.int32)
                    flat = bits.reshape(n, -1)
                    flat = np.column_stack([flat, np.zeros((n, -flat.shape[1] % 64), bool)])  # whole words of 64 bits
                    codes = pa.array([c.tobytes() for c in np.packbits(flat, axis=1, bitorder="little")], pa.binary())
                    for t in range(model.tables):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(cells[:, t]), batch.column(0), batch.column(1), codes], names=["d", "t", "cell", "id", "n", "code"]
                        )

    return vectors.select("id", "n", "d", "vec").mapInArrow(run, "d int, t int, cell int, id long, n long, code binary")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches cut where one of the first columns changes: all parts of a group together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        group = np.column_stack([batch.column(k).to_numpy() for k in range(keys)])
        cut = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(group)]
        for s, e in zip(cut, cut[1:], strict=False):
            if s == e:
                continue
            now = tuple(group[s])
            if held and now != last:
                yield held
                held = []
            last = now
            held.append(batch.slice(s, e - s))
    if held:
        yield held


class Block:
    """Rows (d, t, cell, i, j, id, n, side, code) of a cell's block, or of two blocks that are compared with each other."""

    def __init__(self, parts: list[pa.RecordBatch], models: dict[int, Model]):
        cols = [np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(8)]
        self.key = [int(c[0]) for c in cols[:5]]
        self.dim, self.table = self.key[:2]
        self.model = models[self.dim]
        self.same = self.key[3] == self.key[4]
        self.ids, self.sizes, side = cols[5:]
        raw = b"".join(x for p in parts for x in p.column(8).to_pylist())
        self.words = np.frombuffer(raw, "<u8").reshape(len(self.ids), -1)
        self.left, self.right = (np.arange(len(self.ids)),) * 2 if self.same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))

    def near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of some rows of the left side: near by their codes, and not met in an earlier table."""
        differ = np.zeros((len(rows), len(self.right)), np.int64)
        for k in range(self.words.shape[1]):
            differ += np.bitwise_count(self.words[rows, k][:, None] ^ self.words[self.right, k])
        p, q = np.nonzero(differ <= self.model.far)
        p, q = rows[p], self.right[q]
        return self.first(*((p[p < q], q[p < q]) if self.same else (p, q)))

    def first(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that do not meet in an earlier table."""
        if self.table and len(p):
            chunk = self.model.chunk
            bits = np.unpackbits((self.words[p] ^ self.words[q]).view(np.uint8), axis=1, bitorder="little")[:, : self.table * chunk]
            new = bits.reshape(len(p), self.table, chunk).any(2).all(1)
            p, q = p[new], q[new]
        return p, q


def _candidates(rows: DataFrame, models: dict[int, Model], plan: Plan) -> DataFrame:
    """(a, b) of candidates; of a dense block one row with its key instead, and a and b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _grouped(batches, 5):
            if sum(p.num_rows for p in parts) < 2:
                continue
            block = Block(parts, models)
            most, n, found = plan.dense * len(block.ids), 0, []
            for at in range(0, len(block.left), 256):
                p, q = block.near(block.left[at : at + 256])
                found.append((block.ids[p], block.ids[q]))
                n += len(p)
                if n > most:
                    break
            key = [pa.array([x], pa.int32()) for x in block.key]
            if n > most:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *key], names=_FOUND)
            elif n:
                a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(n, pa.int32())] * 5], names=_FOUND)

    return rows.mapInArrow(run, "a long, b long, d int, t int, cell int, i int, j int")


_FOUND = ["a", "b", "d", "t", "cell", "i", "j"]


def exact(x: np.ndarray, y: np.ndarray, plan: Plan) -> np.ndarray:
    """Whether the cosines of the rows reach the least one."""
    return np.einsum("ij,ij->i", x, y) >= plan.cosine


def _confirmed(pairs: DataFrame, kind: str, plan: Plan) -> DataFrame:
    """(a, b, na, nb) of the candidates (a, b, na, nb, d, va, vb) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ok = batch.column(4).to_numpy(), np.zeros(batch.num_rows, bool)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                own = batch.take(pa.array(rows))
                ok[rows] = exact(*(unit(_vectors(own.column(k), kind, d)) for k in (5, 6)), plan)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(ok))

    return pairs.select("a", "b", "na", "nb", "d", "va", "vb").mapInArrow(run, "a long, b long, na long, nb long")


def _compared(rows: DataFrame, models: dict[int, Model], kind: str, plan: Plan) -> DataFrame:
    """From the rows of dense blocks, with vectors: (id, null, links) and, to the least id of those linked within the
    block, (id, root, 0); linear in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _grouped(batches, 5):
            block = Block(parts, models)
            x = unit(np.concatenate([_vectors(p.column(9), kind, block.dim) for p in parts]))
            n = len(block.ids)
            count, label = np.zeros(n, np.int64), np.arange(n)
            for at in range(0, len(block.left), 256):
                some = block.left[at : at + 256]
                p, q = np.nonzero(x[some] @ x[block.right].T >= plan.cosine - 1e-9)
                p, q = some[p], block.right[q]
                if block.same:
                    p, q = p[p < q], q[p < q]
                p, q = block.first(p, q)
                for s in range(0, len(p), 1 << 16):
                    u, v = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
                    ok = exact(x[u], x[v], plan)
                    u, v = u[ok], v[ok]
                    np.add.at(count, u, block.sizes[v])
                    np.add.at(count, v, block.sizes[u])
                    label = joined(label, u, v)
            some = np.flatnonzero(count)
            if len(some):
                yield pa.RecordBatch.from_pydict({"a": pa.array(block.ids[some]), "b": pa.nulls(len(some), pa.int64()), "n": pa.array(count[some])})
                yield pa.RecordBatch.from_pydict({"a": pa.array(block.ids[some]), "b": pa.array(block.ids[label[some]]), "n": pa.array(np.zeros(len(some), np.int64))})

    return rows.mapInArrow(run, "a long, b long, n long")


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after the links (u, v): one for all that are linked, itself a member."""
    while True:
        low = np.minimum(label[u], label[v])
        high = np.maximum(label[u], label[v])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def near_vectors(vectors: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """vec_id, n_links, component_id, kept of every row of vec_id, embedding.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; others with those of
    their own dimension. Equal vectors form a class whose members link with each other; one of each class is searched.
    vec_id is taken as unique; a row without it is alone. Other columns are ignored; an empty table gives no row. The
    result is a table in the shared folder; all others made on the way are removed.
    """
    element = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    size = F.size("e")
    good = F.coalesce((size > 0) & F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("e", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    rows = rows.select("id", F.when(good, F.col("e")).alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.concat_arrays([batch.column(1)])
            x = (lists.flatten().to_numpy(zero_copy_only=False) + 0.0).astype(kind)
            sizes = np.diff(lists.offsets.to_numpy())
            ends = np.append(0, np.cumsum(sizes)) * x.itemsize
            vec = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), vec], names=["id", "d", "vec"])

    held = Table(rows.where("e is not null").mapInArrow(pack, "id long, d int, vec binary"), "vectors")
    classes = Table(held.df.groupBy("d", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    sizes = {r[0]: r[1] for r in classes.df.groupBy("d").count().where("count > 1").collect()}  # one row a dimension
    made = [held, classes]
    links = stars = counts = None
    if sizes:
        spark = vectors.sparkSession
        listed = F.broadcast(spark.createDataFrame([(d, min(1.0, plan.sample / n)) for d, n in sizes.items()], "d int, share double"))
        searched = classes.df.join(listed, "d")
        # About plan.sample vectors of each dimension.
        drawn = searched.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).orderBy("d", "id").select("d", "vec").collect()
        grouped: dict[int, list[bytes]] = {}
        for r in drawn:
            grouped.setdefault(r[0], []).append(bytes(r[1]))
        models = {d: learn(np.frombuffer(b"".join(grouped[d]) if d in grouped else np.eye(1, d, dtype=kind).tobytes(), kind).reshape(-1, d).astype(np.float64), n, plan) for d, n in sizes.items()}
        links, stars, counts = _links(searched.drop("share"), models, kind, plan, made)
    linked = None if links is None else links.select(F.col("a").alias("class"), F.col("nb").alias("k")).union(links.select("b", "na")).union(counts).groupBy("class").agg(F.sum("k").alias("linked"))
    per = classes.df.select("d", "vec", F.col("id").alias("class"), "n")
    if linked is None:
        per = per.withColumn("linked", F.lit(0)).withColumn("root", F.lit(None).cast("long"))
    else:
        roots = components(links.select("a", "b").union(stars))
        made.append(roots)
        per = per.join(linked, "class", "left").join(roots.df.withColumnRenamed("id", "class"), "class", "left")
    per = per.select("d", "vec", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("root", "class").alias("component_id"))
    out = held.df.join(per, ["d", "vec"]).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    alone = rows.where("e is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    result = Table(out.union(alone), "near-vectors")
    for table in made:
        table.drop()
    return result.df


def _links(searched: DataFrame, models: dict[int, Model], kind: str, plan: Plan, made: list[Table]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, na, nb) of linked classes in sparse blocks; of dense ones (a, b) to the least linked, and (class, links)."""
    cells = _tables(searched, models, kind)
    block = ["d", "t", "cell", "i", "j"]
    sizes = cells.groupBy("d", "t", "cell").agg(F.count("*").alias("members")).where("members > 1")
    spread = cells.join(sizes, ["d", "t", "cell"]).withColumn("parts", F.ceil(F.col("members") / plan.block).cast("int"))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    spread = spread.select("d", "t", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", side, "code")
    dealt: Callable[[DataFrame], DataFrame] = lambda df: df.repartition(*block).sortWithinPartitions(*block)
    found = Table(_candidates(dealt(spread), models, plan), "candidates")
    pairs = found.df.where("a is not null").select("a", "b")
    left = searched.select(F.col("id").alias("a"), F.col("n").alias("na"), "d", F.col("vec").alias("va"))
    right = searched.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    links = Table(_confirmed(pairs.join(left, "a").join(right, "b"), kind, plan), "links")
    dense = found.df.where("a is null").select(*block)
    both = spread.join(dense, block, "left_semi").join(searched.select("id", "vec"), "id").select(*block, "id", "n", "side", "code", "vec")
    compared = Table(_compared(dealt(both), models, kind, plan) if dense.limit(1).count() else searched.sparkSession.createDataFrame([], "a long, b long, n long"), "compared")
    made += [found, links, compared]
    return links.df, compared.df.where("b is not null").select("a", "b"), compared.df.where("b is null").select(F.col("a").alias("class"), F.col("n").alias("k"))
