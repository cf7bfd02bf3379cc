"""The token table: one row per token of every SQL unit, with statement, parenthesis group, clause and slot.

The texts of units are shuffled once, before they are lexed. A task then folds its units in Arrow batches, each unit once
and in order, holding one statement's tokens; no token is shuffled, sorted or put into a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.storage import SQL_A_TASK, spread, written
from quarrylens.functions.text import NAME, newlines

#: String, comment, host variable, dotted name (may end in .*), number, operator, line feed, blanks, anything.
_TOKEN = rf"(?s)('[^']*+(?:''[^']*+)*+'?|--[^\n]*|/\*/|/\*.*?(?:\*/|\Z)|:[ ]*[A-Za-z][A-Za-z0-9-]*(?:\.[A-Za-z][A-Za-z0-9-]*)?|{NAME}(?:\s*\.\s*{NAME}){{0,2}}(?:\s*\.\s*\*)?|\d+(?:\.\d+)?|<=|>=|<>|!=|\|\||[^\S\n]+|.)"
CLAUSES = ["SELECT", "INTO", "FROM", "WHERE", "GROUP", "ORDER", "HAVING", "FETCH", "FOR", "OPTIMIZE", "WITH", "UNION", "EXCEPT", "INTERSECT", "SET", "VALUES", "ON", "USING", "WHEN", "UPDATE", "INSERT", "DELETE", "MERGE", "JOIN"]
VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "ALTER", "DROP", "DECLARE", "LOCK", "FETCH", "OPEN", "CLOSE", "LOAD", "UNLOAD", "WITH"]
_U = ["path", "unit"]
_LEXED = {"pos": pa.int32(), "tok": pa.string(), "word": pa.string(), "kind": pa.string(), "blank": pa.bool_(), "line": pa.int32()}
_STRUCTURE = {"kw": pa.string(), "p1": pa.string(), "p2": pa.string(), "p3": pa.string(), "stmt": pa.int64(), "verb": pa.string(), "n1": pa.string(), "n2": pa.string(), "n3": pa.string(), "n4": pa.string(), "depth": pa.int64(), "level": pa.int32(), "grp": pa.int32(), "clause": pa.string(), "part": pa.int64(), "branch": pa.int64(), "slot": pa.int64()}
_PLACE = {"owner": pa.int32(), "own_clause": pa.string(), "own_part": pa.int64(), "own_branch": pa.int64(), "own_slot": pa.int64()}
_MADE = _LEXED | _STRUCTURE | _PLACE
_SQL_TYPES = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
#: Tokens of an Arrow batch, about.
_BATCH = 1 << 14
#: Units that are looked at together for alike texts, and characters of a unit that is.
_UNITS, _SHORT = 1 << 12, 1 << 12
_NO_LINE = -(1 << 62)
#: ASCII, as Java's classes are.
_TOKENS, _NAMES = re.compile(_TOKEN, re.ASCII), re.compile(NAME)
#: What a token is to nesting: these marks, and these words.
_MARKS, _SHAPING = frozenset("(),"), frozenset(CLAUSES)
_CLAUSES, _VERBS, _BLOCKS, _SETS = frozenset(CLAUSES), frozenset(VERBS), frozenset({"ELSE", "BEGIN", "DO", "LOOP", "ATOMIC"}), frozenset({"UNION", "EXCEPT", "INTERSECT"})


def tokens(units: DataFrame) -> DataFrame:
    """(path, unit, pos, tok, word, kind, blank, line, structure, place) of units (path, unit, first, origin, text).

    word is the token as compared; blank tells whether white space or a comment precedes. Lines are original ones:
    logical line numbers are looked up in ``origin`` where that is not null. ``structured`` and ``placed`` open the structs.
    """
    # a unit's text is shuffled, not its tokens; of the file's line numbers its own go with it
    units = units.select("path", "unit", "first", "text", F.slice("origin", F.col("first").cast("int"), newlines(F.col("text")) + 1).alias("origin"))
    units = spread(written(units, "units"), *_U, size=F.octet_length("text"), per_task=SQL_A_TASK)
    schema = ", ".join([f"path {units.schema['path'].dataType.simpleString()}", f"unit {units.schema['unit'].dataType.simpleString()}", *[f"{c} {_SQL_TYPES[t]}" for c, t in _MADE.items()]])
    return units.mapInArrow(_folded, schema).select(*_U, *_LEXED, F.struct(*_STRUCTURE).alias("structure"), F.struct(*_PLACE).alias("place"))


def structured(toks: DataFrame) -> DataFrame:
    """Adds neighbours (p1-p3, n1-n4), stmt and verb, level, grp, clause, part (which clause of its kind), branch, slot."""
    return toks.select(*_U, *_LEXED, "structure.*", "place")


def placed(rows: DataFrame) -> DataFrame:
    """The structured tokens with owner, and clause, part, branch and slot as seen from the owner (own_clause ...).

    A group whose first token is SELECT or WITH is its own owner; others belong to the nearest such group around
    them, or to the statement (-1), at the clause and slot where their outermost parenthesis stands. Parentheses of
    such groups alone give a second nesting, with levels as in ``structured``; so owners are found at any depth.
    """
    return rows.select(*[c for c in rows.columns if c != "place"], "place.*")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short units of one text are folded once for all of them in a batch, as generated statements are much alike; longer ones alone."""
    for whole in batches:
        for begin in range(0, whole.num_rows, _UNITS):
            batch = whole.slice(begin, _UNITS)
            places = _places(batch)
            alike: dict[str, list[int]] = {}
            for row, text in enumerate(batch.column("text").to_pylist()):
                if len(text or "") <= _SHORT:
                    alike.setdefault(text or "", []).append(row)
                else:
                    for held in _pieces(text):
                        yield _told(batch, places, _columns(held), np.full(len(held["pos"]), row), None)
            held, spans = {c: [] for c in _MADE}, []
            for text, rows in alike.items():
                begun = len(held["pos"])
                for piece in _pieces(text):
                    for c, values in piece.items():
                        held[c] += values
                spans.append((begun, len(held["pos"]) - begun, rows))
                if len(held["pos"]) >= _BATCH:
                    yield from _repeated(batch, places, held, spans)
                    held, spans = {c: [] for c in _MADE}, []
            yield from _repeated(batch, places, held, spans)


def _pieces(text: str) -> Iterator[dict[str, list]]:
    """A unit's columns, some statements at a time; the line is counted from the unit's begin."""
    before, held = [None] * 3, None
    for stmt, toks in enumerate(_statements(_lexed(text)), 1):
        made = _structure(toks, before, stmt)
        before = (before + [t[6] or t[1] for t in toks[-3:]])[-3:]
        if held is None:
            held = {c: made[c] for c in _MADE}
        else:
            for c, values in held.items():
                values += made[c]
        if len(held["pos"]) >= _BATCH:
            yield held
            held = None
    if held is not None:
        yield held


def _columns(held: dict[str, list]) -> dict[str, pa.Array]:
    return {c: pa.array(held[c], t) for c, t in _MADE.items()}


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of each unit: its first line, the number of its own line numbers and where they begin; and all of these, with a last one."""
    origin = batch.column("origin")
    size = origin.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = np.append(origin.flatten().cast(pa.int64()).fill_null(_NO_LINE).to_numpy(zero_copy_only=False), _NO_LINE)
    return batch.column("first").cast(pa.int64()).fill_null(_NO_LINE).to_numpy(zero_copy_only=False), size, np.cumsum(size) - size, lines


def _told(batch: pa.RecordBatch, places: tuple[np.ndarray, ...], made: dict[str, pa.Array], rows: np.ndarray, take: np.ndarray | None) -> pa.RecordBatch:
    """The tokens ``take`` of ``made`` (all if None), of the units ``rows``, with original line numbers."""
    if take is not None:
        take = pa.array(take)
        made = {c: x.take(take) for c, x in made.items()}
    first, size, begin, lines = places
    at = made["line"].to_numpy()
    own = lines[np.where(at < size[rows], begin[rows] + at, len(lines) - 1)]
    line = np.where((own == _NO_LINE) & (first[rows] != _NO_LINE), first[rows] + at, own)
    made = made | {"line": pa.array(line, mask=line == _NO_LINE).cast(pa.int32())}
    of = pa.array(rows)
    return pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in _U], *made.values()], [*_U, *made])


def _repeated(batch: pa.RecordBatch, places: tuple[np.ndarray, ...], held: dict[str, list], spans: list[tuple[int, int, list[int]]]) -> Iterator[pa.RecordBatch]:
    """The tokens of every unit of each text (begin, number of tokens, units), about ``_BATCH`` at a time."""
    spans = [x for x in spans if x[1]]
    if not spans:
        return
    made = _columns(held)
    if all(len(rows) == 1 for _, _, rows in spans):
        yield _told(batch, places, made, np.repeat([rows[0] for _, _, rows in spans], [n for _, n, _ in spans]), None)
        return
    rows = np.concatenate([rows for _, _, rows in spans])
    begin, n = (np.repeat([x[k] for x in spans], [len(x[2]) for x in spans]) for k in (0, 1))
    at = (np.cumsum(n) - n) // _BATCH
    for i, j in pairwise([0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(n)]):
        some = n[i:j]
        take = np.arange(some.sum()) + np.repeat(begin[i:j] - (np.cumsum(some) - some), some)
        yield _told(batch, places, made, np.repeat(rows[i:j], some), take)


def _kind(tok: str) -> tuple:
    """(line feeds, kind, word, kw) of a token; the kind of white space and comments is None."""
    c = tok[0]
    if c in " \t\n\r\f\v" or tok.startswith(("--", "/*")):
        return tok.count("\n"), None, None, None
    if c == "'":
        return tok.count("\n"), "str", tok, None
    if c == ":" and len(tok) > 1:
        return tok.count("\n"), "host", tok[1:].lstrip(" ").upper(), None
    if c in '"@#$' or c.isascii() and c.isalpha():
        word = ".".join(x.replace('"', "") if x[0] == '"' else x.upper() for x in _NAMES.findall(tok))
        return tok.count("\n"), *(("star", word, None) if tok[-1] == "*" else ("name", word, tok.upper()))
    return 0, "num" if c in "0123456789" else "op", tok, None


_known_kind = lru_cache(1 << 14)(_kind)


def _lexed(text: str) -> Iterator[tuple]:
    """(pos, tok, word, kind, blank, line, kw) of a unit's tokens, its first line being 0."""
    at, blank = 0, True
    for pos, found in enumerate(_TOKENS.finditer(text)):
        tok = found[0]
        breaks, kind, word, kw = _known_kind(tok) if len(tok) <= 64 else _kind(tok)
        if kind is not None:
            yield pos, tok, word, kind, blank, at, kw
        blank = kind is None
        at += breaks


def _statements(toks: Iterator[tuple]) -> Iterator[list[tuple]]:
    """A unit's tokens, cut into statements: after ';', at a verb that follows a block's opener, and at a utility's own verb."""
    held, told, p1 = [], "", None
    tok = next(toks, None)
    while tok is not None:
        after, kw = next(toks, None), tok[6]
        if kw in ("IF", "ELSEIF", "MATCHED", "CASE"):
            told = kw
        starts = p1 == ";" or kw in _VERBS and (p1 in _BLOCKS or p1 == "THEN" and told != "MATCHED")
        utility = kw in ("LOAD", "UNLOAD", "REORG", "RUNSTATS") and after is not None and (after[6] or after[1]) in ("DATA", "TABLESPACE", "INDEX", "LIST")
        if held and (starts or utility):
            yield held
            held = []
        held.append(tok)
        p1, tok = kw or tok[1], after
    if held:
        yield held


def _structure(toks: list[tuple], before: list[str | None], stmt: int) -> dict[str, list]:
    """The columns of one statement's tokens; ``before`` are the three tokens of the unit before it."""
    n = len(toks)
    made = {c: list(v) for c, v in zip([*_LEXED, "kw"], zip(*toks, strict=True), strict=True)}
    kws = made["kw"]
    near = [*before, *[k or t for k, t in zip(kws, made["tok"], strict=True)], *[None] * 4]
    made |= {f"p{i}": near[3 - i : 3 - i + n] for i in (1, 2, 3)} | {f"n{i}": near[3 + i : 3 + i + n] for i in (1, 2, 3, 4)}
    made |= {"stmt": [stmt] * n, "verb": [next((k for k in kws if k), None)] * n}
    pos, shape = tuple(made["pos"]), tuple([t if t in _MARKS else k if k in _SHAPING else "" for k, t in zip(kws, made["tok"], strict=True)])
    rest = (_known_nesting if n <= 256 else _nesting)(pos, shape, before[-1] in (None, "FOR"))
    return made | {c: list(v) for c, v in zip(["depth", "level", "grp", "clause", "part", "branch", "slot", *_PLACE], rest, strict=True)}


def _nesting(place: tuple[int, ...], shape: tuple[str, ...], plain: bool) -> list[tuple]:
    """depth, level, grp, clause, part, branch, slot and the owner's, by what tokens are to nesting and clauses alone.

    ``plain`` tells that an UPDATE or FETCH at the begin is no clause.
    """
    rest = []
    height = low = turns = lowest = 0
    opened, queries = {}, {}  # the last '(' of each level, and that of a query
    groups, ups = {}, {}  # a group's clause, part, branch, slot, whether it is a query, its place; the owners' states
    for pos, tok, n1 in zip(place, shape, (*shape[1:], ""), strict=True):
        opens, closes = tok == "(", tok == ")"
        height += opens - closes
        low = min(low, height)
        depth = height - low
        # both parentheses of a pair belong to the level inside them
        level = depth + closes
        if opens:
            opened[level] = pos
        grp = opened.get(level, -1)
        if grp not in groups:
            groups[grp] = [None, 0, 0, 0, opens and n1 in ("SELECT", "WITH"), None]
        state = groups[grp]
        if tok in _CLAUSES and not (plain and tok in ("FETCH", "UPDATE")):
            state[0], state[1], state[3] = "FROM" if tok == "JOIN" else tok, state[1] + 1, 0
        plain = tok == "FOR"
        state[2] += tok in _SETS
        state[3] += tok == ","
        query = state[4]
        turns += query * (opens - closes)
        lowest = min(lowest, turns)
        around = turns - lowest + (query and closes)
        if query and opens:
            queries[around] = pos
        within = queries.get(around, -1) if around else -1
        now = tuple(state[:4])
        if grp == within:
            ups[around] = now
        if opens:
            # a group's first token is its parenthesis, which tells the place of all of it: the owner's state just before
            state[5] = within, ups.get(around, (None, None, 0, None))
        owner, up = state[5] or (-1, now)
        rest.append((depth, level, grp, *now, owner, *(now if grp == owner else up)))
    return list(zip(*rest, strict=True))


_known_nesting = lru_cache(1 << 12)(_nesting)
