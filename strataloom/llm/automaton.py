"""Deterministic automata over bytes, made from patterns by subset construction and minimisation.

Patterns know literals, classes in brackets, groups, `|`, `?`, `*`, `+`, `{n}`, `{n,}`, `{n,m}`, `\\xHH` and a backslash
before any other mark; each names bytes, so that classes should hold ASCII alone. Byte 0xFF, which no UTF-8 text has,
belongs to no pattern: it takes every automaton back to its start.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np

_LETTERS = [(1 << upper, 1 << (upper + 32)) for upper in range(65, 91)]
#: Longest stretch of bytes that a lane walks on its own, and the bytes that are walked at once.
LANE, AT_ONCE = 512, 1 << 22


class _Pattern:
    """A part of a pattern as a tree: ("set", bits), ("cat", trees), ("or", trees), ("rep", tree, least, most or None)."""

    def __init__(self, pattern: str, fold: bool):
        self.rest, self.fold = list(pattern)[::-1], fold
        self.tree = self.choice()
        if self.rest:
            raise ValueError(f"unexpected {self.rest[-1]!r} in {pattern!r}")

    def choice(self):
        ways = [self.sequence()]
        while self.rest and self.rest[-1] == "|":
            self.rest.pop()
            ways.append(self.sequence())
        return ways[0] if len(ways) == 1 else ("or", ways)

    def sequence(self):
        parts = []
        while self.rest and self.rest[-1] not in "|)":
            part = self.atom()
            while self.rest and self.rest[-1] in "?*+{":
                part = ("rep", part, *self.times())
            parts.append(part)
        return ("cat", parts)

    def times(self) -> tuple[int, int | None]:
        mark = self.rest.pop()
        if mark != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        text = ""
        while (c := self.rest.pop()) != "}":
            text += c
        least, comma, most = text.partition(",")
        return int(least), int(most) if most else None if comma else int(least)

    def byte(self) -> int:
        c = self.rest.pop()
        if c == "\\":
            c = self.rest.pop()
            if c == "x":
                return int(self.rest.pop() + self.rest.pop(), 16)
        return ord(c)

    def atom(self):
        if self.rest[-1] == "(":
            self.rest.pop()
            tree = self.choice()
            self.rest.pop()
            return tree
        if self.rest[-1] != "[":
            return ("set", self.folded(1 << self.byte()))
        self.rest.pop()
        bits, negated = 0, self.rest[-1] == "^"
        if negated:
            self.rest.pop()
        while self.rest[-1] != "]":
            low = high = self.byte()
            if self.rest[-1] == "-" and self.rest[-2] != "]":
                self.rest.pop()
                high = self.byte()
            bits |= (1 << (high + 1)) - (1 << low)
        self.rest.pop()
        bits = self.folded(bits)
        return ("set", ((1 << 255) - 1) & ~bits if negated else bits)

    def folded(self, bits: int) -> int:
        if self.fold:
            for upper, lower in _LETTERS:
                if bits & (upper | lower):
                    bits |= upper | lower
        return bits


class _Steps:
    """Steps of a nondeterministic automaton: free ones, and those that take a byte of a set."""

    def __init__(self):
        self.size, self.free, self.taking = 0, [], []

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, tree) -> tuple[int, int]:
        """First and last state of a tree's steps."""
        kind, first, last = tree[0], self.state(), self.state()
        if kind == "set":
            self.taking.append((first, tree[1], last))
        elif kind == "or":
            for way in tree[1]:
                a, b = self.add(way)
                self.free += [(first, a), (b, last)]
        elif kind == "cat":
            at = first
            for part in tree[1]:
                a, b = self.add(part)
                self.free.append((at, a))
                at = b
            self.free.append((at, last))
        else:
            _, part, least, most = tree
            at = first
            for _ in range(least):
                a, b = self.add(part)
                self.free.append((at, a))
                at = b
            if most is None:
                a, b = self.add(part)
                self.free += [(at, a), (b, a), (at, last), (b, last)]
            else:
                for _ in range(most - least):
                    self.free.append((at, last))
                    a, b = self.add(part)
                    self.free.append((at, a))
                    at = b
                self.free.append((at, last))
        return first, last


class Automaton:
    """`table[state * n_classes + class of byte]` is the next state times n_classes; `marks[state]` holds a bit for each
    pattern that ends in it. State 0 is the start; states with marks come last, from `marked` on.

    A pattern is a row of parts, each (text, whether its letters stand for either case).
    backwards: texts are walked from their last byte on, so that a pattern's mark stands where it can begin.
    anywhere: patterns may begin at every byte, else at the first alone."""

    def __init__(self, patterns: Iterable[tuple[tuple[str, bool], ...]], *, backwards: bool = False, anywhere: bool = False):
        steps = _Steps()
        ends = [steps.add(("cat", [_Pattern(*part).tree for part in parts])) for parts in patterns]
        if backwards:
            ends = [(b, a) for a, b in ends]
            steps.free = [(b, a) for a, b in steps.free]
            steps.taking = [(b, bits, a) for a, bits, b in steps.taking]
        masks = sorted({bits for _, bits, _ in steps.taking})
        kinds: dict[tuple[bool, ...], int] = {(False,) * len(masks): 0}
        self.classes = np.array([kinds.setdefault(tuple(bool(bits >> byte & 1) for bits in masks), len(kinds)) for byte in range(256)], dtype=np.uint8)
        members = [frozenset(bits for bits, has in zip(masks, kind) if has) for kind in kinds]
        free: list[list[int]] = [[] for _ in range(steps.size)]
        taking: list[list[tuple[int, int]]] = [[] for _ in range(steps.size)]
        for a, b in steps.free:
            free[a].append(b)
        for a, bits, b in steps.taking:
            taking[a].append((bits, b))
        closed = [self._closure(s, free) for s in range(steps.size)]
        begin = frozenset().union(*(closed[a] for a, _ in ends))
        table, marks = self._subsets(begin, closed, taking, members, {b: i for i, (_, b) in enumerate(ends)}, anywhere)
        self._minimise(table, marks)

    @staticmethod
    def _closure(state: int, free: list[list[int]]) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    @staticmethod
    def _subsets(begin, closed, taking, members, ends, anywhere):
        """Every set of states that can be reached is a state; an empty set is one too."""
        names, todo, table = {begin: 0}, [begin], []
        for at in todo:
            row = []
            for bits_of in members:
                to = begin if anywhere else frozenset()
                to = to.union(*(closed[b] for s in at for bits, b in taking[s] if bits in bits_of))
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                row.append(names[to])
            table.append(row)
        marks = [reduce(lambda m, s: m | (1 << ends[s] if s in ends else 0), at, 0) for at in todo]
        return np.array(table, dtype=np.int64), np.array(marks, dtype=np.int64)

    def _minimise(self, table: np.ndarray, marks: np.ndarray) -> None:
        """Split classes of states by where their bytes lead, until nothing splits."""
        block, count = np.unique(marks, return_inverse=True)[1].reshape(-1), 0
        while (block.max() + 1) > count:
            count = int(block.max()) + 1
            block = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        one = np.unique(block, return_index=True)[1]
        order = np.lexsort((one, one != one[block[0]], marks[one] != 0))  # the start first, states with marks last
        if marks[one[block[0]]]:
            raise ValueError("a pattern matches the empty text")
        rank = np.empty(count, dtype=np.int64)
        rank[order] = np.arange(count)
        self.n_classes = table.shape[1]
        self.table = (rank[block[table[one[order]]]] * self.n_classes).astype(np.int32).reshape(-1)
        self.marks = marks[one[order]]
        self.marked = int(np.count_nonzero(self.marks == 0))
        #: The state that nothing leads out of, if there is one, times n_classes.
        stuck = [s for s in range(count) if not self.marks[s] and (self.table[s * self.n_classes : (s + 1) * self.n_classes] == s * self.n_classes).all()]
        self.stuck = stuck[0] * self.n_classes if stuck else -1

    def __len__(self) -> int:
        return len(self.marks)

    def longest(self, data: bytes, at: int) -> int:
        """Where the longest match that begins at `at` ends, or -1."""
        table, classes, marked, state, end = self.table, self.classes, self.marked * self.n_classes, 0, -1
        for i in range(at, len(data)):
            state = int(table[state + int(classes[data[i]])])
            if state == self.stuck:
                break
            if state >= marked:
                end = i + 1
        return end

    def marks_backwards(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions of bytes whose state has marks when data is walked from its end, ascending, and their marks."""
        where, what, state = [], [], 0
        for end in range(len(data), 0, -AT_ONCE):
            begin = max(0, end - AT_ONCE)
            kinds = self.classes[np.frombuffer(data, np.uint8, end - begin, begin)[::-1]]
            at, states, state = self._walk(kinds, state)
            where.append(end - 1 - at)
            what.append(self.marks[states])
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, what = np.concatenate(where), np.concatenate(what)
        order = np.argsort(where)
        return where[order], what[order]

    def _walk(self, kinds: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
        """All states with marks along a stretch. It is cut into lanes that step together, each from the start; a lane
        whose lane before ended elsewhere is walked again until it meets the states that it had."""
        size = len(kinds)
        lanes = -(-size // LANE)
        padded = np.zeros(lanes * LANE, dtype=np.uint8)
        padded[:size] = kinds
        steps = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        states = np.empty((LANE, lanes), dtype=np.int32)
        now = np.zeros(lanes, dtype=np.int32)
        now[0] = state
        for t in range(LANE):
            now = self.table[now + steps[t]]
            states[t] = now
        again = np.flatnonzero(states[-1, :-1]) + 1
        now = states[-1, again - 1]
        for t in range(LANE):
            if not len(again):
                break
            now = self.table[now + steps[t, again]]
            other = now != states[t, again]
            again, now = again[other], now[other]
            states[t, again] = now
        for lane in again[again + 1 < lanes] + 1:  # few: their states differ to the end of a lane
            self._again(steps, states, int(lane))
        at, lane = np.nonzero(states >= self.marked * self.n_classes)
        where = lane * LANE + at
        inside = where < size
        last = int(states[(size - 1) % LANE, -1])
        return where[inside], states[at[inside], lane[inside]] // self.n_classes, last

    def _again(self, steps: np.ndarray, states: np.ndarray, lane: int) -> None:
        table, state = self.table, int(states[-1, lane - 1])
        while lane < states.shape[1]:
            for t, (kind, had) in enumerate(zip(steps[:, lane].tolist(), states[:, lane].tolist())):
                state = int(table[state + kind])
                if state == had:
                    return
                states[t, lane] = state
            lane += 1
