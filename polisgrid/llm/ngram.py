"""Operator 6: a trigram model with deleted interpolation.

P(w | u v) = l3 * c(u v w) / c(u v) + l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1), with weights by bucket of the
two contexts' counts. The weights are learned by expectation-maximisation over the tokens of a part of the training
documents that is held out from the counts used there; the final counts take all training documents. Each round is a
pass over the stored estimates of those tokens, and only sums by bucket come to the driver.

Counting: each task of the scan reduces its rows to the distinct hashes of their words, bigrams and trigrams, sorted and
packed in ranges of hashes. Ranges, whose number grows with the text, meet in one task each, which answers every asking
task with the corpus counts in the order asked. The scoring scan makes the same hashes anew and reads the counts beside
them. So what is shuffled are distinct hashes of a few megabytes of text; a row holds at least one of them, and no key
gathers more than one row for each such group.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgrid.llm.shared import Table, new_path, remove
from polisgrid.llm.textcore import distinct_of, mix, text_slices, word_hashes

_END = np.uint64(0xE4D0F7E4D0F7E4D1)
_BEGIN = np.uint64(0xBE617BE617BE6171)
_GROUP_BYTES = 5 << 20
_RANGE_BYTES = 4 << 20  # of text, for each range of hashes
_NAMES = ("l3", "l2", "l1", "l0")


@dataclasses.dataclass(frozen=True)
class Plan:
    folds: int = 5
    test_fold: int = 1
    tuning: int = 10  # one training document in so many is held out to learn the weights
    rounds: int = 10  # of expectation-maximisation, at most
    settled: float = 3e-3  # change of a weight from which on it goes on
    prior: float = 10.0  # tokens that a bucket takes from those around it
    smoothing: float = 0.5


def crc(doc_ids: list) -> np.ndarray:
    """crc32 of doc_id as text; 0 for null."""
    return np.array([0 if x is None else zlib.crc32(str(x).encode()) for x in doc_ids], np.int64)


def _stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all documents with an end each, of each with its left neighbour, and with its two left
    neighbours, and token counts. The lowest two bits tell words (0), bigrams (1) and trigrams (2) apart."""
    words, before = word_hashes(data, offsets)
    counts = np.diff(before)
    tokens = np.insert(words, before[1:], _END)
    starts = np.cumsum(counts + 1) - counts - 1
    left, pair_left = np.empty_like(tokens), np.empty_like(tokens)
    with np.errstate(over="ignore"):
        left[1:] = tokens[:-1]
        left[starts] = _BEGIN
        pairs = mix(left * np.uint64(0x9FB21C651E98DF25) + tokens)
        pair_left[1:] = pairs[:-1]
        pair_left[starts] = _BEGIN
        triples = mix(pair_left * np.uint64(0xD6E8FEB86659FD93) + tokens)
    return _kind(tokens, 0), _kind(pairs, 1), _kind(triples, 2), counts + 1


def _kind(hashes: np.ndarray, kind: int) -> np.ndarray:
    """56 bits: enough to tell 10**9 distinct n-grams apart but for about seven of them."""
    return (hashes >> np.uint64(8)) & ~np.uint64(3) | np.uint64(kind)


_FAR = 255


def packed(hashes: np.ndarray, low: int) -> bytes:
    """Sorted hashes from low on as their number and the distances between them: four bytes of each as they are, the byte
    above, which is small, by a Huffman code. Where that byte is _FAR, the distance follows in full."""
    step = np.diff(hashes, prepend=np.uint64(low))
    high = np.minimum(step >> np.uint64(32), np.uint64(_FAR)).astype(np.uint8)
    coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    head = coder.compress(high.tobytes()) + coder.flush()
    return len(hashes).to_bytes(4, "little") + len(head).to_bytes(4, "little") + head + step.astype("<u4").tobytes() + step[high == _FAR].astype("<u8").tobytes()


def unpacked(raw: bytes, low: int) -> np.ndarray:
    n, size = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    high = np.frombuffer(zlib.decompress(raw[8 : 8 + size]), np.uint8)
    step = np.frombuffer(raw, "<u4", n, 8 + size).astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
    step[high == _FAR] = np.frombuffer(raw, "<u8", offset=8 + size + 4 * n)
    return np.cumsum(step, dtype=np.uint64) + np.uint64(low)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of a task in groups of bounded bytes: lists of (rows, data, offsets)."""
    held, size = [], 0
    for batch in batches:
        for part in text_slices(batch, "text"):
            if held and size + len(part[1]) > _GROUP_BYTES:
                yield held
                held, size = [], 0
            held.append(part)
            size += len(part[1])
    if held:
        yield held


def _asked(group: list[tuple], plan: Plan, tune: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Distinct hashes of the group (of its tuning rows only, if tune), their counts in the rows that count and in
    the tuning rows, and per part what scoring needs."""
    keys, kinds, parts = [], [], []
    for rows, data, offsets in group:
        code = crc(rows.column(0).to_pylist())
        train = code % plan.folds != plan.test_fold
        held = train & (code // plan.folds % plan.tuning == 0)
        *hashes, counts = _stream(data, offsets)
        kind = np.repeat(np.where(held, 2, np.where(train, 1, 0)).astype(np.uint8), counts)
        if tune:
            on = kind == 2
            hashes, kind = [h[on] for h in hashes], kind[on]
            counts = np.where(held, counts, 0)
        keys += hashes
        kinds += [kind] * 3
        parts.append((rows, code, len(kind), counts))
    every, kind = np.concatenate(keys), np.concatenate(kinds)
    distinct, _, back = distinct_of(every)
    main = np.bincount(back, kind == 1, len(distinct)).astype(np.uint32)
    dev = np.bincount(back, kind == 2, len(distinct)).astype(np.uint32)
    return distinct, main, dev, [parts, back]


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes, 255 standing for what follows in full, compressed."""
    big = counts >= 255
    return zlib.compress(np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<u8").tobytes(), 1)


def _large(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def _cut(distinct: np.ndarray, ranges: int) -> np.ndarray:
    return np.append(np.searchsorted(distinct, np.arange(ranges, dtype=np.uint64) * np.uint64(_step(ranges))), len(distinct))


def _step(ranges: int) -> int:
    return (1 << 56) // ranges


def _ask(docs: DataFrame, plan: Plan, ranges: int) -> DataFrame:
    """Rows (range, task, group, tune, hashes, counts, tuning counts) and a check of the rows read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, group in enumerate(_groups(batches)):
            sign = _sign(group)
            for tune in (False, True):
                distinct, main, dev, _ = _asked(group, plan, tune)
                at = _cut(distinct, ranges)
                out = [[], [], [], []]
                for r in range(ranges):
                    a, b = at[r], at[r + 1]
                    if a < b:
                        out[0].append(r)
                        out[1].append(packed(distinct[a:b], r * _step(ranges)))
                        out[2].append(b"" if tune else _small(main[a:b]))
                        out[3].append(b"" if tune else _small(dev[a:b]))
                n = len(out[0])
                del distinct, main, dev
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array([task] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array([tune] * n, pa.bool_()), pa.array([sign] * n, pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])],
                    names=["range", "task", "part", "tune", "sign", "hashes", "main", "dev"],
                )

    return docs.mapInArrow(run, "range int, task int, part int, tune boolean, sign long, hashes binary, main binary, dev binary")


def _sign(group: list[tuple]) -> int:
    """Tells whether a later scan gives the same rows in the same order."""
    code = 0
    for rows, _, offsets in group:
        code = zlib.crc32(offsets.tobytes(), zlib.crc32(",".join(map(str, rows.column(0).to_pylist())).encode(), code))
    return code


def _answer(asked: DataFrame, ranges: int) -> DataFrame:
    """Per asking group and range the counts of its hashes: all training counts, or without the tuning part. A row
    with task -1 carries the range's sums: tokens and distinct words, of both kinds of counts."""

    def answer(key, table):
        hashes = [unpacked(x, key[0].as_py() * _step(ranges)) for x in table["hashes"].to_pylist()]
        tune = table["tune"].to_pylist()
        main, dev = table["main"].to_pylist(), table["dev"].to_pylist()
        plain = [k for k, t in enumerate(tune) if not t]
        every = np.concatenate([hashes[k] for k in plain]) if plain else np.zeros(0, np.uint64)
        order = np.argsort(every)
        held = every[order]
        first = np.flatnonzero(np.append(np.ones(min(1, len(held)), bool), held[1:] != held[:-1]))
        own = held[first]
        total = []
        for part in (main, dev):
            values = np.concatenate([_large(part[k], len(hashes[k])) for k in plain]) if plain else np.zeros(0, np.int64)
            total.append(np.add.reduceat(values[order], first) if len(first) else np.zeros(0, np.int64))
        both = total[0] + total[1]
        del every, order, held
        counts = []
        for k, h in enumerate(hashes):
            at = np.searchsorted(own, h)
            counts.append(_small((total[0] if tune[k] else both)[at]))
        word = own & np.uint64(3) == 0
        sums = np.array([both[word].sum(), (both[word] > 0).sum(), total[0][word].sum(), (total[0][word] > 0).sum()], "<i8").tobytes()
        cols = [table[c].to_pylist() for c in ("range", "task", "part", "tune", "sign")]
        return pa.table(
            {
                "range": pa.array([*cols[0], cols[0][0]], pa.int32()),
                "task": pa.array([*cols[1], -1], pa.int32()),
                "part": pa.array([*cols[2], 0], pa.int32()),
                "tune": pa.array([*cols[3], False]),
                "sign": pa.array([*cols[4], 0], pa.int64()),
                "counts": pa.array([*counts, sums], pa.binary()),
            }
        )

    return asked.groupBy("range").applyInArrow(answer, "range int, task int, part int, tune boolean, sign long, counts binary")


def _level(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, counts up to 8 each, then by the binary logarithm, up to 2 ** 31."""
    more = 5 + np.log2(np.maximum(context, 1)).astype(np.int64)
    return np.where(context <= 8, context, np.minimum(more, LEVELS - 1)).astype(np.int64)


LEVELS = 36
BUCKETS = LEVELS * LEVELS


def _estimates(counts: np.ndarray, n: int, back: np.ndarray, sizes: int, total: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, maximum-likelihood estimates (trigram, bigram, word) and c(w) of each of the n tokens of a part. back: of
    its words, then bigrams, then trigrams."""
    word, pair, triple = (counts[back[k * n : (k + 1) * n]] for k in range(3))
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    one[1:], two[1:] = word[:-1], pair[:-1]
    one[starts] = two[starts] = sizes  # every training document has a begin
    found = np.column_stack([triple / np.maximum(two, 1), pair / np.maximum(one, 1), word / max(1, total)])
    return _level(two) * LEVELS + _level(one), found, word


def shares(weights: np.ndarray, bucket: np.ndarray, found: np.ndarray, vocabulary: int) -> np.ndarray:
    """What each estimate gives of each token's probability; they sum up to it."""
    return weights[bucket] * np.column_stack([found, np.full(len(found), 1.0 / (vocabulary + 1))])


def start_weights(plan: Plan) -> np.ndarray:
    return np.tile(np.array([0.3, 0.3, 0.3, 0.1]), (BUCKETS, 1))


def next_weights(sums: np.ndarray, plan: Plan) -> np.ndarray:
    """Weights from the expected counts by bucket. A bucket with few held-out tokens leans on all buckets of its trigram
    context's level, and a level with few on the level below it."""
    table = sums.reshape(LEVELS, LEVELS, 4)
    level = start_weights(plan)[0]
    out = np.empty_like(table)
    for k in range(LEVELS):
        own = table[k].sum(0) + plan.prior * level
        level = own / own.sum()
        out[k] = table[k] + plan.prior * level
    return (out / out.sum(2, keepdims=True)).reshape(BUCKETS, 4)


def _plain_scan(df: DataFrame) -> bool:
    """Whether df only reads files, picks rows and computes columns, so that each scan gives the same partitions."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        name = plan.nodeName()
        if name == "LogicalRelation":
            return True
        if name not in ("Project", "Filter") or plan.children().size() != 1:
            return False
        plan = plan.children().head()


def score(docs: DataFrame, plan: Plan = Plan(), ranges: int | None = None) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null and empty texts are one end token. A null doc_id counts as crc 0. Repeated rows are counted and scored each.
    Texts of any length are taken whole. Other columns are ignored; an empty table gives no row. The rows are scanned
    several times, which must give the same rows in the same partitions and order, as a table's scan does: what is no
    such scan is stored first. A difference is noticed and raises an error. The result is a table in the shared folder;
    all others made on the way are removed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    copy = None if _plain_scan(rows) else Table(rows, "documents")
    rows = rows if copy is None else copy.df
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    train = code % plan.folds != plan.test_fold
    held = train & (F.floor(code / plan.folds) % plan.tuning == 0)
    sizes = rows.select(train.alias("t"), (train & ~held).alias("m"), F.octet_length("text").alias("n")).agg(F.count_if("t"), F.count_if("m"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = ranges or max(8, -(-int(sizes[2]) // _RANGE_BYTES))
    tasks = max(1, rows.rdd.getNumPartitions())
    folder = new_path(spark, "answers")
    _answer(_ask(rows, plan, ranges).repartition(ranges, "range"), ranges).repartition(tasks, "task").write.partitionBy("task").parquet(folder)
    sums = np.zeros(4, np.int64)
    answers = spark.read.schema("range int, part int, tune boolean, sign long, counts binary, task int").parquet(folder)
    # One row of four numbers a range, added up in the tasks.
    for r in answers.where("task = -1").select("counts").mapInArrow(_added, "v array<long>").collect():
        sums += np.array(r[0], np.int64)
    out = _scored(rows, folder, sizes, sums, plan)
    remove(spark, folder)
    if copy is not None:
        copy.drop()
    return out.df


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(4, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total += np.frombuffer(raw, "<i8")
    yield pa.RecordBatch.from_pydict({"v": pa.array([total.tolist()], pa.list_(pa.int64()))})


def _scored(rows: DataFrame, folder: str, sizes, sums: np.ndarray, plan: Plan) -> Table:
    def answered(task: int, tune: bool):
        """The counts of each group of one task, read from its own folder."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(f"{folder}/task={task}")
        table = ds.dataset(root, filesystem=system, format="parquet").to_table(filter=ds.field("tune") == tune)
        table = table.sort_by([("part", "ascending"), ("range", "ascending")])
        parts: dict[int, list[bytes]] = {}
        signs = {}
        for part, sign, raw in zip(table["part"].to_pylist(), table["sign"].to_pylist(), table["counts"].to_pylist(), strict=True):
            parts.setdefault(part, []).append(raw)
            signs[part] = sign
        return parts, signs

    def counted(batches: Iterator[pa.RecordBatch], tune: bool):
        from pyspark import TaskContext

        found = None
        for k, group in enumerate(_groups(batches)):
            if found is None:
                found = answered(TaskContext.get().partitionId(), tune)
            distinct, _, _, (parts, back) = _asked(group, plan, tune)
            if len(distinct):
                if found[1].get(k) != _sign(group):
                    raise ValueError("the input's rows or their order changed between scans")
                counts = _joined(found[0].pop(k), len(distinct))
            else:
                counts = np.zeros(0, np.int64)
            del distinct
            at = 0
            for rows_, code_, n, per in parts:
                yield rows_, code_, n, per, back[at : at + 3 * n], counts
                at += 3 * n

    def tuned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, n, per, back, counts in counted(batches, True):
            if not n:
                continue
            per = per[per > 0]
            bucket, found, _ = _estimates(counts, n, back, int(sizes[1]), int(sums[2]), np.cumsum(per) - per)
            # Tokens of a part with the same estimates are one row with their number.
            every = np.rec.fromarrays([bucket.astype(np.int32), *found.astype(np.float32).T], names="bucket,p3,p2,p1")
            one, times = np.unique(every, return_counts=True)
            columns = [np.ascontiguousarray(one[c]) for c in ("bucket", "p3", "p2", "p1")] + [times.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(b"".join(c.tobytes() for c in columns), 1)], pa.binary())], names=["tokens"])

    weights = start_weights(plan)
    tokens = Table(rows.mapInArrow(tuned, "tokens binary"), "held-out")
    for _ in range(plan.rounds):
        before = weights
        weights = next_weights(_expected(tokens.df, weights, int(sums[3])), plan)
        if np.abs(weights - before).max() < plan.settled:
            break
    tokens.drop()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_all, v_all = int(sums[0]), int(sums[1])
        for rows_, code_, n, per, back, counts in counted(batches, False):
            starts = np.cumsum(per) - per
            bucket, found, word = _estimates(counts, n, back, int(sizes[0]), n_all, starts)
            p = shares(weights, bucket, found, v_all).sum(1)
            base = np.log10((word + plan.smoothing) / (n_all + plan.smoothing * (v_all + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    rows_.column(0),
                    pa.array(code_ % plan.folds == plan.test_fold),
                    pa.array(per.astype(np.int64)),
                    pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(per), n_all, np.int64)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(np.log10(p), starts)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return Table(rows.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")


def _expected(tokens: DataFrame, weights: np.ndarray, vocabulary: int) -> np.ndarray:
    """Expected counts of the estimates by bucket: at most four numbers a bucket come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, 4))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                bucket, *found, times = np.frombuffer(zlib.decompress(raw), "<i4").reshape(5, -1)
                part = shares(weights, bucket, np.column_stack([x.view("<f4") for x in found]).astype(np.float64), vocabulary)
                part *= (times / part.sum(1))[:, None]
                for k in range(4):
                    total[:, k] += np.bincount(bucket, part[:, k], BUCKETS)
        on = np.flatnonzero(total.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *(pa.array(total[on, k]) for k in range(4))], names=["bucket", *_NAMES])

    out = np.zeros((BUCKETS, 4))
    for r in tokens.mapInArrow(run, "bucket int, l3 double, l2 double, l1 double, l0 double").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _NAMES)).collect():
        out[r[0]] = r[1:]
    return out


def _joined(raws: list[bytes], n: int) -> np.ndarray:
    """Counts of all ranges in order. A range's bytes hold one byte a hash, then eight for each 255."""
    out, at = np.zeros(n, np.int64), 0
    for packed_ in raws:
        raw = np.frombuffer(zlib.decompress(packed_), np.uint8)
        size = len(raw)  # n1 bytes and 8 for each 255 among them
        low, high = -(-size // 9), size
        while low < high:
            mid = (low + high) // 2
            if mid + 8 * int((raw[:mid] == 255).sum()) >= size:
                high = mid
            else:
                low = mid + 1
        own = raw[:low].astype(np.int64)
        own[own == 255] = np.frombuffer(raw[low:].tobytes(), "<u8").astype(np.int64)
        out[at : at + low] = own
        at += low
    assert at == n
    return out
