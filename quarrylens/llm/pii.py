"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

Generators with high recall propose spans that may overlap. Spans of the base patterns are always redacted; the
others are scored by gradient-boosted trees, trained here on a bounded set of generated sentences, and redacted
where the calibrated probability reaches the threshold. Kinds are email, ip, card and phone.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match can only begin where a run of digits does, as the one before it ends with a whole run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: What else may be personal data: kind and pattern; a span begins at the group ``at`` where there is one. They propose;
#: the trees decide. Runs of any length are taken whole and from their beginning alone, so a text is read once.
GENERATORS = (
    ("email", re.compile(r"(?i)(?<![a-z0-9._%+-])(?:[._%+-]++(?=[a-z0-9]))?+(?P<at>[a-z0-9][a-z0-9._%+-]*+)\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[a-z0-9-]+(?:\.[a-z0-9-]+|\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[a-z0-9-]+)+")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?@\s?[A-Za-z0-9-]+(?:(?:\.|\s\.\s)[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){2,7}:?(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?![0-9a-f:])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\.)\s?[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![\w.+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?!\w|\.[0-9])")),
)
_QUICK = (re.compile(r"(?i)[\s([{]at[\s)\]}]"), re.compile("@"), re.compile(r"[0-9a-fA-F]:[0-9a-fA-F:]"))
_CONTEXT = (
    ("email", re.compile(r"(?i)e-?mail|mail|contact|write|reach|correo|courriel|@")),
    ("phone", re.compile(r"(?i)phone|tel|call|mobile|cell|fax|whatsapp|sms|dial|telefon|appel|llam")),
    ("card", re.compile(r"(?i)card|visa|amex|master|credit|debit|pay|karte|carte|tarjeta")),
    ("ip", re.compile(r"(?i)\bip\b|address|host|server|login|from|connect|ipv")),
    ("not", re.compile(r"(?i)version|order|isbn|invoice|page|pages|token|id|total|price|date|ratio|score|time|ticket|build|release|chapter|serial|key|sum|years?")),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind, then start."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            out.append(("email", begin, done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in re.split(r"\.0*", "." + m[0])[1:])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, str, int, int]]:
    """(generator, kind, start, end) of all generators; they may overlap each other and the base spans."""
    digits = bool(_DIGIT.search(text))
    use = (bool(_QUICK[0].search(text)), "@" in text, bool(_QUICK[2].search(text)), digits, digits, digits)
    return [(g, kind, m.start("at") if "at" in pattern.groupindex else m.start(), m.end()) for (g, (kind, pattern)), ok in zip(enumerate(GENERATORS), use, strict=True) if ok for m in pattern.finditer(text)]


def span_features(text: str, g: int, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 12]
    digits = _NOT_DIGIT.sub("", span)
    groups = re.findall(r"[0-9]+", span)
    seps = re.findall(r"[^0-9A-Za-z]+", span)
    row = [float(g == i) for i in range(len(GENERATORS))]
    row += [len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(set(seps)), float(luhn(digits)) if digits else 0.0, len(set(digits))]
    row += [float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "\"'=#$/:_"), float(span[:1] == "("), float(span[:2] == "00"), float(span[:1] == "0"), span.count(":"), float("::" in span)]
    row += [float(digits[:1] in "3456"), sum(int(x) > 255 for x in groups if len(x) < 9), float(bool(re.search(r"(?i)\b(com|org|net|edu|gov|io|de|fr|es|co|uk|info)\b", span[-8:]))), float(bool(re.search(r"[([{]", span))), float(bool(re.search(r"(?:19|20)[0-9]{2}", span)))]
    return row + [float(bool(p.search(before))) for _, p in _CONTEXT] + [float(sum(map(len, groups[-2:])) == 7), float(len(groups) and len(groups[-1]) == 4)]


class Trees:
    """Gradient boosting for log loss with small regression trees over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2):
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.trees: list = []

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, 0.0)
        if depth and len(rows) > 20:
            for f in range(x.shape[1]):
                column = x[rows, f]
                for cut in self.edges[f]:
                    left = column <= cut
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0] and hl > 0.5 and total_h - hl > 0.5:
                        best = (gain, f, cut)
        if best[1] is None:
            return float(total_g / (total_h + 1) * self.rate)
        left = x[rows, best[1]] <= best[2]
        return best[1], float(best[2]), self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1)

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._value(low, x), self._value(high, x))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12)))[:-1] if len(np.unique(x[:, f])) > 2 else np.unique(x[:, f])[:-1] for f in range(x.shape[1])]
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._value(tree, x)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))


_LEADS = {
    "email": ("email me at ", "write to ", "contact: ", "mail ", "", "or "),
    "phone": ("call ", "phone: ", "tel. ", "mobile ", "", "fax "),
    "card": ("card ", "visa ", "paid with card ", "credit card number ", ""),
    "ip": ("ip ", "from host ", "address ", "server at ", ""),
    "not": ("order ", "version ", "invoice ", "pages ", "total ", "isbn ", "id ", "ratio ", "", "score ", "time ", "token = \"", "in ", "the years "),
}


def _with_luhn(rng: random.Random, n: int) -> str:
    digits = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def sample(rng: random.Random) -> tuple[str, str | None, int, int]:
    """A generated sentence with the kind and place of its personal span; kind None: none."""
    word = lambda n=8: "".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, n)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    d = lambda lo, hi: str(rng.randint(lo, hi))
    kind = rng.choice([*KINDS, *[None] * 5])
    tld = rng.choice(["com", "org", "net", "de", "fr", "io", "co"])
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" @ ", "."), ("@ ", " . ")])
        span = word() + rng.choice(["", "." + word(), num(2)]) + at + word() + dot + tld
    elif kind == "phone":
        sep = rng.choice("-. ")
        span = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", sep.join((num(3), num(3), num(4))), f"00{d(1, 99)} {num(3)} {num(3)} {num(4)}", f"0{num(2)}/{num(4)} {num(4)}", f"0{d(1, 9)} {num(2)} {num(2)} {num(2)} {num(2)}"])
    elif kind == "card":
        c = _with_luhn(rng, rng.choice([15, 16]))
        span = rng.choice([c if len(c) == 15 else ".".join(c[i : i + 4] for i in range(0, 16, 4)), f"{c[:4]} {c[4:10]} {c[10:]}" if len(c) == 15 else ".".join(c[i : i + 4] for i in range(0, 16, 4))])
    elif kind == "ip":
        span = rng.choice([":".join(f"{rng.randint(0, 65535):x}" for _ in range(8)), f"{rng.randint(4096, 65535):x}:{rng.randint(1, 65535):x}::{rng.randint(1, 65535):x}", "[.]".join(d(0, 255) for _ in range(4)), "(.)".join(d(0, 255) for _ in range(4))])
    else:
        span = rng.choice([
            f"{d(1900, 2030)}-{d(1900, 2030)}", f"{d(1900, 2030)}-{d(10, 12)}-{d(10, 28)}", f"{d(10, 28)}.{d(10, 12)}.{d(1900, 2030)}", num(rng.randint(11, 19)), f"{num(3)}-{num(2)}", f"{num(4)} {num(4)} {num(4)}",
            f"{d(1, 12)}:{d(10, 59)}:{d(10, 59)}", f"{d(0, 23):0>2}:{d(0, 59):0>2}:{d(0, 59):0>2}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{d(1, 9)}.{d(0, 20)}.{d(0, 20)}", f"{num(2)} {num(3)}", f"{num(3)} {num(3)} {num(3)}",
            f"meet at {word()} dot {word()}", f"look at {word()}.{word()}", f"{word()} at {word()}. {word()}", f"{d(256, 999)}.{num(3)}.{num(3)}.{num(3)}", "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"{num(5)} {num(5)}", f"{num(2)}/{num(2)}/{d(1900, 2030)}",
        ])
    lead = rng.choice(_LEADS[kind or "not"]) if rng.random() < 0.8 else ""
    head = " ".join(word() for _ in range(rng.randint(1, 6))).capitalize() + " " + lead
    text = head + span + rng.choice(["", ".", ",", " "]) + " " + " ".join(word() for _ in range(rng.randint(1, 6)))
    return text, kind, len(head), len(head) + len(span)


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of the candidates of n generated sentences."""
    rng, x, y, kinds = random.Random(seed), [], [], []
    for _ in range(n):
        text, kind, start, end = sample(rng)
        for g, k, a, b in candidates(text):
            x.append(span_features(text, g, k, a, b))
            y.append(float(k == kind and abs(a - start) <= 1 and abs(b - end) <= 1))
            kinds.append(k)
    return np.array(x), np.array(y), kinds


@cache
def model(n_train: int = 3000, precision: float = 0.97, seed: int = 11) -> tuple[Trees, tuple[float, float], dict[str, float]]:
    """Trees, Platt's two numbers and each kind's threshold: the least that reaches ``precision``.

    Trees, calibration and thresholds are fitted on three separate sets of generated sentences.
    """
    x, y, _ = labelled(n_train, seed)
    trees = Trees().fit(x, y)
    x, y, _ = labelled(n_train, seed + 1)
    m = trees.margin(x)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = p * (1 - p) + 1e-6
        grad, hess = np.array([((y - p) * m).sum(), (y - p).sum()]), np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    x, y, kinds = labelled(n_train, seed + 2)
    p = 1 / (1 + np.exp(-(a * trees.margin(x) + b)))
    least = {}
    for kind in KINDS:
        own = np.array([k == kind for k in kinds])
        order = np.argsort(-p[own])
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        least[kind] = float(max(0.5, p[own][order][good[-1]])) if len(good) else 1.1
    return trees, (a, b), least


def find(text: str, scorer: tuple[Trees, tuple[float, float], dict[str, float]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start. An added span overlaps no other span."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    begins, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def overlaps(a: int, b: int) -> bool:
        before = bisect_left(begins, b)
        return before > 0 and reach[before - 1] > a

    free = [c for c in candidates(text) if not overlaps(c[2], c[3])]
    if not free:
        return base, base
    trees, (slope, shift), least = scorer
    p = 1 / (1 + np.exp(-np.clip(slope * trees.margin(np.array([span_features(text, *c) for c in free])) + shift, -35, 35)))
    added: list[tuple[str, int, int]] = []
    places: list[tuple[int, int]] = []  # of the added spans, in order; they do not overlap
    for i in sorted(range(len(free)), key=lambda i: (-p[i], free[i][2], -free[i][3])):
        _, kind, a, b = free[i]
        at = bisect_left(places, (a, b))
        if p[i] >= least[kind] and (at == 0 or places[at - 1][1] <= a) and (at == len(places) or places[at][0] >= b):
            places.insert(at, (a, b))
            added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all).

    Offsets are code points of the whole text. Null and empty texts have no spans; repeated rows give repeated
    results; an empty table an empty one; only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for b in batches:
            rows = [find(t.as_py() or "", scorer) for t in b.column("text")]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), *counts, sha, pa.array([_joined(s) for _, s in rows], pa.string())], ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(found, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by [EMAIL], [IP], [CARD] or [PHONE]; overlapping ones by one mark, that of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text, all columns; null texts stay null, empty ones empty.

    Texts are read whole however long; repeated rows give repeated results; an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for b in batches:
            texts = [t if t is None else redact(t, find(t, scorer)[1]) for t in b.column(text_col).to_pylist()]
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(changed, docs.schema)
