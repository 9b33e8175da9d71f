"""Regular expressions over bytes compiled to minimal deterministic automata.

The dialect: literals, escapes (`\\xHH`, `\\.`), classes with ranges, groups, `|`, `? * +` and `{m,n}`. A rule marked
ignore_case takes letters in either case. Construction: syntax tree, position sets (followpos), subset construction
over byte classes, then partition refinement.
"""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    ignore_case: bool = False
    least: int = 0  # shorter matches, in bytes, take their place but don't count


class _Parser:
    """To nested tuples: ('set', frozenset), ('cat', parts), ('alt', parts), ('star', x), ('empty',)."""

    def __init__(self, rule: Rule):
        self.text, self.at, self.fold = rule.pattern, 0, rule.ignore_case

    def parse(self) -> tuple:
        tree = self.alt()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} of {self.text!r}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alt(self) -> tuple:
        parts = [self.cat()]
        while self.peek() == "|":
            self.take()
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeat())
        return ("cat", parts) if parts else ("empty",)

    def repeat(self) -> tuple:
        atom = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "?":
                atom = ("alt", [atom, ("empty",)])
            elif c == "*":
                atom = ("star", atom)
            elif c == "+":
                atom = ("cat", [atom, ("star", atom)])
            else:
                end = self.text.index("}", self.at)
                low, _, high = self.text[self.at : end].partition(",")
                bounded = "," not in self.text[self.at : end]
                self.at = end + 1
                tail = [] if bounded else [("star", atom)] if not high else [("alt", [atom, ("empty",)])] * (int(high) - int(low))
                atom = ("cat", [atom] * int(low) + tail)
        return atom

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            tree = self.alt()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            return tree
        if c == "[":
            return ("set", self.many())
        return ("set", self.folded({self.escape() if c == "\\" else ord(c)}))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def many(self) -> frozenset:
        negate = self.peek() == "^"
        if negate:
            self.take()
        out: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                out |= set(range(low, (self.escape() if c == "\\" else ord(c)) + 1))
            else:
                out.add(low)
        return self.folded(set(range(256)) - out if negate else out)

    def folded(self, found: set[int]) -> frozenset:
        if self.fold:
            found = found | {ord(chr(x).swapcase()) for x in found if x < 128 and chr(x).isalpha()}
        return frozenset(found)


def parse(rule: Rule, backward: bool = False) -> tuple:
    def turned(x: tuple) -> tuple:
        if x[0] == "cat":
            return ("cat", [turned(y) for y in reversed(x[1])])
        if x[0] == "alt":
            return ("alt", [turned(y) for y in x[1]])
        return ("star", turned(x[1])) if x[0] == "star" else x

    tree = _Parser(rule).parse()
    return turned(tree) if backward else tree


@dataclasses.dataclass(frozen=True)
class Dfa:
    """step[state * n_classes + classes[byte]] is the next state times n_classes; state 0 starts; dead is -1 or a row."""

    classes: np.ndarray  # 256 values
    step: np.ndarray  # flat
    accept: np.ndarray  # bit mask of rules by state
    n_classes: int
    dead: int


def compile_rules(trees: list[tuple], anywhere: bool) -> Dfa:
    """One automaton for all rules; anywhere: a match may begin at any byte (and accept tells where one ends)."""
    sets: list[frozenset] = []
    follow: list[set[int]] = []
    ends: dict[int, int] = {}

    def leaf(symbols: frozenset) -> int:
        sets.append(symbols)
        follow.append(set())
        return len(sets) - 1

    def walk(x: tuple) -> tuple[bool, set[int], set[int]]:
        if x[0] == "empty":
            return True, set(), set()
        if x[0] == "set":
            k = leaf(x[1])
            return False, {k}, {k}
        if x[0] == "alt":
            found = [walk(y) for y in x[1]]
            return any(f[0] for f in found), set().union(*(f[1] for f in found)), set().union(*(f[2] for f in found))
        if x[0] == "star":
            _, first, last = walk(x[1])
            for k in last:
                follow[k] |= first
            return True, first, last
        null, first, last = True, set(), set()
        for y in x[1]:
            n, f, z = walk(y)
            for k in last:
                follow[k] |= f
            first = first | f if null else first
            last = last | z if n else z
            null = null and n
        return null, first, last

    start: set[int] = set()
    for k, tree in enumerate(trees):
        null, first, last = walk(tree)
        if null:
            raise ValueError("a rule matches the empty string")
        end = leaf(frozenset())
        ends[end] = 1 << k
        for p in last:
            follow[p].add(end)
        start |= first
    # Bytes that all sets treat alike form a class.
    signs: dict[tuple, int] = {}
    classes = np.zeros(256, np.int64)
    kinds = set(sets)
    for b in range(256):
        classes[b] = signs.setdefault(tuple(b in s for s in kinds), len(signs))
    example = [int(np.flatnonzero(classes == c)[0]) for c in range(len(signs))]
    first_state = frozenset(start)
    states, todo, rows = {first_state: 0}, [first_state], []
    for state in todo:
        row = []
        for b in example:
            to = set(first_state) if anywhere else set()
            for p in state:
                if b in sets[p]:
                    to |= follow[p]
            to = frozenset(to)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
        rows.append(row)
    step = np.array(rows, np.int64)
    accept = np.array([sum(ends.get(p, 0) for p in s) for s in todo], np.int64)
    block = np.unique(accept, return_inverse=True)[1]
    while True:  # partition refinement
        fresh = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if fresh.max() == block.max():
            break
        block = fresh
    order = np.full(block.max() + 1, -1)
    order[block[0]] = 0
    n = 1
    for x in block:
        if order[x] < 0:
            order[x] = n
            n += 1
    block = order[block]
    small, mask = np.zeros((n, len(example)), np.int64), np.zeros(n, np.int64)
    small[block], mask[block] = block[step], accept
    empty = states.get(frozenset())
    dead = int(block[empty]) if empty is not None and not anywhere else -1
    return Dfa(classes, (small * len(example)).ravel().astype(np.int32), mask, len(example), dead)
