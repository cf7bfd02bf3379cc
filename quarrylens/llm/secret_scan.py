"""Secrets: the regexes of all rules as one minimal deterministic automaton, which reads every byte once.

Each rule's states keep the places where a match may have begun apart, earliest first, so the automaton follows the
leftmost match. A rule has to fit that: once a match is complete every further byte completes it again or ends it, and
none completes while an earlier one is still open; ``Scanner`` raises for others. The rules' states are combined by
subset construction over classes of bytes and minimised to a table of transitions. Where a match ends is read off that
table; where it began, by the reversed automaton of its rule, back from the byte that completed it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``head``, then ``letters`` ``first`` times or more. A match counts from ``least`` letters on; others are used up and dropped."""

    kind: str
    head: str
    letters: str
    first: int
    least: int

    @property
    def pattern(self) -> str:
        return f"{self.head}{self.letters}{{{self.first},}}"


#: The base kinds and their patterns.
BASE = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 1, 12),
    Rule("access", "AKIA", "[A-Z0-9]", 1, 14),
    Rule("hex", "", "[0-9a-f]", 4, 16),
)
#: Published forms of tokens and keys.
ADDED = (
    Rule("github", "gh[opsur]_", "[A-Za-z0-9]", 1, 36),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 1, 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 1, 20),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY----", "-", 1, 1),
    Rule("slack", "xox[abeoprs]-", "[A-Za-z0-9-]", 1, 10),
    Rule("stripe", "[rs]k_live_", "[A-Za-z0-9]", 1, 16),
)
RULES = (*BASE, *ADDED)

_TIMES = re.compile(r"[?*+]|\{(\d+)(,?)(\d*)\}")
_CLASS = re.compile(r"(\\x[0-9A-Fa-f]{2}|\\.|[^\\\]])(?:-(\\x[0-9A-Fa-f]{2}|\\.|[^\\\]]))?")


def _byte(text: str) -> int:
    if text.startswith("\\x") and len(text) == 4:
        return int(text[2:], 16)
    if text.startswith("\\") and text[1:].isalnum():
        raise ValueError(f"{text} is not supported")
    return ord(text[-1])


class Pattern:
    """The nondeterministic automaton of a regex of bytes: literals, classes, groups, alternatives and repetitions."""

    def __init__(self, pattern: str, backward: bool = False):
        self.text, self.at, self.backward = pattern, 0, backward
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        tree = self._alternatives()
        if self.at < len(pattern):
            raise ValueError(f"unexpected {pattern[self.at :]!r}")
        begin = self._state()
        self.final = self._build(tree, begin)
        self.begin = self.closed({begin})

    def _alternatives(self) -> tuple:
        parts = [self._sequence()]
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            parts.append(self._sequence())
        return ("any", parts)

    def _sequence(self) -> tuple:
        items = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            item = self._atom()
            while m := _TIMES.match(self.text, self.at):
                self.at = m.end()
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(m[0]) or (int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
                item = ("times", item, low, high)
            items.append(item)
        return ("all", items)

    def _atom(self) -> tuple:
        rest = self.text[self.at :]
        if m := re.match(r"\((?:\?:)?", rest):
            self.at += m.end()
            inner = self._alternatives()
            if self.text[self.at : self.at + 1] != ")":
                raise ValueError("a group is not closed")
            self.at += 1
            return inner
        if m := re.match(r"\[((?:\\.|[^\\\]^])(?:\\.|[^\\\]])*)\]", rest):
            self.at += m.end()
            return ("set", frozenset(b for x in _CLASS.finditer(m[1]) for b in range(_byte(x[1]), _byte(x[2] or x[1]) + 1)))
        if m := re.match(r"\\x[0-9A-Fa-f]{2}|\\.|[^\\\[.^$?*+{]", rest):
            self.at += m.end()
            return ("set", frozenset([_byte(m[0])]))
        raise ValueError(f"unexpected {rest!r}")

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _build(self, tree: tuple, at: int) -> int:
        if tree[0] == "set":
            end = self._state()
            self.moves[at].append((tree[1], end))
            return end
        if tree[0] == "all":
            for item in reversed(tree[1]) if self.backward else tree[1]:
                at = self._build(item, at)
            return at
        if tree[0] == "any":
            end = self._state()
            for part in tree[1]:
                self.free[at].append(begin := self._state())
                self.free[self._build(part, begin)].append(end)
            return end
        _, item, low, high = tree
        for _ in range(low):
            at = self._build(item, at)
        end = self._state()
        self.free[at].append(end)
        if high is None:
            self.free[self._build(item, end)].append(end)
        else:
            for _ in range(high - low):
                at = self._build(item, at)
                self.free[at].append(end)
        return end

    def closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed({to for s in states for among, to in self.moves[s] if byte in among})


class Leftmost:
    """The states of one rule: whether the leftmost match is complete, and the sets of open matches, earliest first."""

    def __init__(self, pattern: str):
        self.nfa = Pattern(pattern)
        self.sets = {among for moves in self.nfa.moves for among, _ in moves}
        self.known: dict[tuple, tuple] = {}
        if self.nfa.final in self.nfa.begin:
            raise ValueError(f"{pattern} matches nothing")

    begin = (False, ())

    def step(self, state: tuple, byte: int) -> tuple:
        if (state, byte) not in self.known:
            self.known[state, byte] = self._step(*state, byte)
        return self.known[state, byte]

    def _step(self, complete: bool, open_: tuple, byte: int) -> tuple:
        if complete:
            went = self.nfa.step(open_[0], byte)
            if went and self.nfa.final not in went:
                raise ValueError("a complete match may not become open again")
            if went:
                return True, (went,)
            after = self.step(self.begin, byte)
            if after[0]:
                raise ValueError("a match may not be complete on the byte that ends another")
            return after
        kept, before = [], frozenset()
        for states in (*open_, self.nfa.begin):
            went = self.nfa.step(states, byte) - before
            if self.nfa.final in went:
                if kept:
                    raise ValueError("a match may not be complete while an earlier one is open")
                return True, (went,)
            if went:
                kept.append(went)
                before |= went
        return False, tuple(kept)


def _classes(sets: set[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """(class of each byte, a byte of each class): bytes that no rule tells apart share one."""
    marks: dict[tuple, int] = {}
    of = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)])
    return of, [int(np.flatnonzero(of == c)[0]) for c in range(len(marks))]


def _minimal(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table and masks of the automaton with as few states as possible; the first state stays the first."""
    _, group = np.unique(masks, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    # number groups by their first state
    _, first = np.unique(group, return_index=True)
    order = np.argsort(np.argsort(first))
    group = order[group]
    _, first = np.unique(group, return_index=True)
    return group[table[first]], masks[first]


class Scanner:
    """The combined automaton of several rules. ``table`` has a row a state and a column a class of bytes."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        own = [Leftmost(r.pattern) for r in rules]
        self.classes, samples = _classes({s for x in own for s in x.sets})
        numbers, table, todo = {tuple(x.begin for x in own): 0}, [], [tuple(x.begin for x in own)]
        for states in todo:
            row = []
            for byte in samples:
                to = tuple(x.step(s, byte) for x, s in zip(own, states, strict=True))
                if to not in numbers:
                    numbers[to] = len(todo)
                    todo.append(to)
                row.append(numbers[to])
            table.append(row)
        masks = np.array([sum(s[0] << i for i, s in enumerate(states)) for states in todo])
        self.unreduced = len(todo)
        self.table, self.masks = _minimal(np.array(table), masks)
        self.back = [self._backward(r.pattern) for r in rules]
        self._rows: list | None = None

    @staticmethod
    def _backward(pattern: str) -> tuple[list[dict[int, int]], list[bool]]:
        nfa = Pattern(pattern, backward=True)
        numbers, moves, todo = {nfa.begin: 0}, [], [nfa.begin]
        for states in todo:
            row = {}
            for byte in set().union(*(among for s in states for among, _ in nfa.moves[s])):
                to = nfa.step(states, byte)
                if to not in numbers:
                    numbers[to] = len(todo)
                    todo.append(to)
                row[byte] = numbers[to]
            moves.append(row)
        return moves, [nfa.final in states for states in todo]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None}

    def _linked(self) -> tuple[list, bytes]:
        """The first state, and the class of each byte.

        A state is a list of the states that each class leads to, each such a list. None stands for a state with another
        mask; those are in the last place, a dict by class with the mask.
        """
        if self._rows is None:
            rows = [[] for _ in self.masks]
            for row, to, mask in zip(rows, self.table.tolist(), self.masks.tolist(), strict=True):
                row += [rows[t] if self.masks[t] == mask else None for t in to]
                row.append({c: (rows[t], int(self.masks[t])) for c, t in enumerate(to) if self.masks[t] != mask})
            self._rows = rows[0]
        return self._rows, bytes(self.classes.tolist())

    def _began(self, rule: int, data: bytes, at: int, floor: int) -> int:
        """The earliest begin, not before ``floor``, of a match whose last byte is at ``at``."""
        moves, final = self.back[rule]
        state, found = 0, at
        while at >= floor:
            state = moves[state].get(data[at])
            if state is None:
                break
            if final[state]:
                found = at
            at -= 1
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule: of each rule the leftmost longest matches that do not overlap."""
        row, classes = self._linked()
        marks = []
        for at, c in enumerate(data.translate(classes)):
            to = row[c]
            if to is None:
                to, mask = row[-1][c]
                marks.append((at, mask))
            row = to
        marks.append((len(data), 0))
        out, entered, floor, last = [], [0] * len(self.rules), [0] * len(self.rules), 0
        for at, mask in marks:
            changed = mask ^ last
            while changed:
                i = changed.bit_length() - 1
                changed ^= 1 << i
                if mask >> i & 1:
                    entered[i] = at
                else:
                    if at - entered[i] - 1 + self.rules[i].first >= self.rules[i].least:
                        out.append((self._began(i, data, entered[i], floor[i]), i, at))
                    floor[i] = at
            last = mask
        return sorted(out)


_INNER = bytes(range(0x80, 0xC0))


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans, counted in code points of UTF-8 text."""
    at, n, place = 0, 0, {}
    for x in sorted({p for a, _, b in spans for p in (a, b)}):
        n += len(data[at:x].translate(None, _INNER))
        at, place[x] = x, n
    return [(place[a], i, place[b]) for a, i, b in spans]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, spans (array of kind, start, end, in code points, end exclusive, by start, then rule).

    Null and empty texts have no spans; texts of any length are read whole, once; repeated rows give repeated results; an
    empty table an empty one; only the two named columns are read, so others cannot clash. Kinds do not suppress each other.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner.value
        for b in batches:
            rows = []
            for text in b.column("text"):
                data = text.as_py() or b""
                spans = scan.spans(data)
                rows.append([{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in in_code_points(data, spans)] if spans else [])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, of)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(found, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)
