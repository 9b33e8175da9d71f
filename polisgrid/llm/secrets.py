"""Operator 4: secrets found by one automaton for all rules, in one pass over the bytes.

The combined automaton marks bytes where a match of some rule ends. From the first such byte the rule's backward
automaton gives the leftmost start and its forward automaton the longest end; the search for this rule goes on behind
that match. So each rule yields its leftmost, longest, non-overlapping matches.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgrid.llm.automaton import Dfa, Rule, compile_rules, parse
from polisgrid.llm.textcore import text_slices

#: The base rules of the contract. A match of assign counts if its value has 12 characters or more.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=\\-]+", True),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Public formats of credentials. Lengths are checked on the match, as counting inside an automaton that may begin
#: anywhere multiplies its states.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9\\-]+", least=15),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", least=36),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", "AIza[A-Za-z0-9_\\-]+", least=39),
)
MIN_VALUE = 12
_LANE = 4096


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = compile_rules([parse(r) for r in rules], True)
        self.ahead = [compile_rules([parse(r)], False) for r in rules]
        self.back = [compile_rules([parse(r, True)], False) for r in rules]
        table = self.all.accept[np.arange(len(self.all.accept))] != 0
        self.hit = np.repeat(table, self.all.n_classes)
        self.mask = np.repeat(self.all.accept, self.all.n_classes)

    def ends(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a match of any rule ends (index of its last byte), and the rules as a bit mask.

        Texts are cut into lanes that are advanced together, one byte a step. A lane that does not begin a text is
        first run from the automaton's start; where the lane before it ends in another state it is run anew from that
        state, until all agree. So the states are those of one pass over each whole text.
        """
        per = -(-np.diff(offsets) // _LANE)
        doc = np.repeat(np.arange(len(per)), per)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[:-1][doc] + number * _LANE
        lens = np.minimum(offsets[1:][doc] - begin, _LANE)
        kind = self.all.classes.astype(np.int32)[data]
        came, went = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32)
        places, masks = [], []
        due = np.arange(len(doc))
        while len(due):
            where, mask, lane, went[due] = self.advance(kind, begin[due], lens[due], came[due])
            again = np.zeros(len(doc), bool)
            again[due] = True
            for k in range(len(places)):  # what an earlier run of these lanes gave
                keep = ~again[places[k][1]]
                places[k], masks[k] = places[k][:, keep], masks[k][keep]
            places.append(np.stack([where, due[lane]]))
            masks.append(mask)
            wrong = np.zeros(len(doc), bool)
            wrong[1:] = (number[1:] > 0) & (went[:-1] != came[1:])
            due = np.flatnonzero(wrong)
            came[due] = went[due - 1]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, mask = np.concatenate(places, 1)[0], np.concatenate(masks)
        order = np.argsort(where)
        return where[order], mask[order]

    def advance(self, kind: np.ndarray, begin: np.ndarray, lens: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, rules, lane) of each match's end in lanes begun in the given states, and the states they end in."""
        order = np.argsort(-lens, kind="stable")  # longest first, so that those still on stand in front
        begin, lens, state = begin[order], lens[order], state[order]
        longest = int(lens[0]) if len(lens) else 0
        on = np.searchsorted(-lens, -np.arange(1, longest + 1), "right")  # lanes with over k bytes
        places, lanes, masks = [], [], []
        step, hit = self.all.step, self.hit
        for k in range(longest):
            n = on[k]
            at = begin[:n] + k
            now = step.take(state[:n] + kind.take(at))
            state[:n] = now
            seen = hit.take(now)
            if seen.any():
                places.append(at[seen])
                lanes.append(np.flatnonzero(seen))
                masks.append(self.mask[now[seen]])
        out = np.empty_like(state)
        out[order] = state
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), out
        return np.concatenate(places), np.concatenate(masks), order[np.concatenate(lanes)], out

    @staticmethod
    def run(dfa: Dfa, data: bytes, places: range) -> int:
        """How many bytes the longest match along places takes; 0 if none."""
        state, best, step, classes = 0, 0, dfa.step, dfa.classes
        dead = dfa.dead * dfa.n_classes
        for n, p in enumerate(places, 1):
            state = int(step[state + classes[data[p]]])
            if state == dead:
                break
            if dfa.accept[state // dfa.n_classes]:
                best = n
        return best

    def spans(self, text: bytes, places: list[int], masks: list[int]) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes of all matches in one text, by start, then rule."""
        out = []
        for k in range(len(self.rules)):
            done = 0
            for p, m in zip(places, masks, strict=True):
                if p < done or not m >> k & 1:
                    continue
                n = self.run(self.back[k], text, range(p, done - 1, -1))
                if n:
                    start = p + 1 - n
                    done = start + self.run(self.ahead[k], text, range(start, len(text)))
                    out.append((start, k, done))
        return sorted(out)


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...]) -> dict[int, list[tuple[int, int, int]]]:
    """Spans (start, rule number, end) in bytes of the texts that have any."""
    own = scanner(rules)
    places, masks = own.ends(data, offsets)
    if not len(places):
        return {}
    doc = np.searchsorted(offsets, places, "right") - 1
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    out = {}
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=True):
        d = int(doc[a])
        begin = int(offsets[d])
        text = data[begin : offsets[d + 1]].tobytes()
        spans = own.spans(text, (places[a:b] - begin).tolist(), masks[a:b].tolist())
        spans = [s for s in spans if s[2] - s[0] >= rules[s[1]].least and (rules[s[1]].name != "assign" or _value(text[s[0] : s[2]]) >= MIN_VALUE)]
        if spans:
            out[d] = spans
    return out


def _value(match: bytes) -> int:
    """The length of the value: what follows the separator, blanks and an opening quote."""
    at = min(k for k in (match.find(b"="), match.find(b":")) if k >= 0) + 1
    while match[at] == 32:
        at += 1
    if match[at] in b"\"'":
        at += 1
    return len(match) - at


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if text.isascii():
        return spans
    head = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    before = np.append(0, np.cumsum(head))
    return [(int(before[s]), k, int(before[e])) for s, k, e in spans]


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and spans (kind:start:end, code points, end exclusive).

    Null and empty texts have no span (base_sha256 is that of the empty string). Texts of any length are scanned whole,
    in one pass. Repeated rows give repeated rows, a null doc_id stays null; other columns are ignored; an empty table
    gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                n = len(offsets) - 1
                counts = np.zeros((len(BASE), n), np.int64)
                digest, listed = [nothing] * n, [""] * n
                for d, spans in find(data, offsets, rules).items():
                    spans = _points(data[offsets[d] : offsets[d + 1]].tobytes(), spans)
                    said = [f"{rules[k].name}:{s}:{e}" for s, k, e in spans]
                    base = [x for x, (_, k, _) in zip(said, spans, strict=True) if k < len(BASE)]
                    for _, k, _ in spans:
                        if k < len(BASE):
                            counts[k, d] += 1
                    digest[d], listed[d] = hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(listed, pa.string())],
                    names=["doc_id", *(f"n_{r.name}" for r in BASE), "base_sha256", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(texts: pa.Array, rules: tuple[Rule, ...] = BASE + MORE) -> pa.Array:
    """Each text with its secrets replaced by the name of their kind in square brackets; null stays null."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    out: list[pa.Array] = []
    for rows, data, offsets in text_slices(batch, "text"):
        found = find(data, offsets, rules)
        if not found:
            out.append(rows.column(0))
            continue
        fresh = rows.column(0).to_pylist()
        for d, spans in found.items():
            text, at, parts = data[offsets[d] : offsets[d + 1]].tobytes(), 0, []
            for s, k, e in spans:
                if s >= at:
                    parts += [text[at:s], f"[{rules[k].name}]".encode()]
                at = max(at, e)
            fresh[d] = b"".join([*parts, text[at:]]).decode()
        out.append(pa.array(fresh, pa.string()))
    return pa.concat_arrays(out) if out else texts


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; secrets in text are replaced."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = redacted(columns[at].cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
