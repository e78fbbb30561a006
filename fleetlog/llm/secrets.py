"""Secret scans over a trigram inverted index.

From each rule's parsed regular expression comes a Boolean query over trigrams (in lower case)
that every match must satisfy. Each segment of the table (one Arrow batch) gets an inverted index
from trigram to the rows that hold it; a rule's query intersects and unites those postings, and
only the rows left are matched with the expression. A rule without a mandatory trigram, such as
a run of hexadecimal digits, reads every row. An index lives in its task, so a lost
executor costs its own tasks and nothing is shuffled.

Matches are leftmost and non-overlapping per kind; a match shorter than its rule's least length is
dropped afterwards. Spans are code points of the whole match, end exclusive.

Defined cases: a missing text is empty and has no secrets; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
from pyspark.sql import DataFrame

from fleetlog.llm.base import append, fresh
from fleetlog.llm.wordbytes import LOWER, runs


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # fewest characters of ``group``; shorter matches are dropped
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | re.IGNORECASE if self.any_case else re.ASCII)


# The base rules, in the order that sorts equal starts.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
# Public formats of other credentials.
MORE = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("pay_key", r"sk_live_[A-Za-z0-9]+", 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
#: Literal strings followed at once while a query is derived; more than that end a literal.
MOST_STRINGS = 64


def _all(parts: list) -> object:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list) -> object:
    return None if not parts or any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> object:
    """What a text must hold if it holds one of these strings."""
    return _any([_all([s[i : i + 3].encode("utf-8")[:3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, object]:
    """The exact strings of a sequence if they are few, and its trigram query.

    ``run`` holds the strings that the literals since the last break can spell.
    """
    run: set[str] = {""}
    whole, needs = True, []
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        needs += [_of_strings(run), query if strings is None else _of_strings(strings)]
        run, whole = {""}, False
    return (run, None) if whole else (None, _all([*needs, _of_strings(run)]))


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL and arg < 128:
        return {chr(arg).lower()}, None
    if op is C.IN and len(arg) <= 8 and all(o is C.LITERAL and a < 128 for o, a in arg):
        return {chr(a).lower() for _, a in arg}, None
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), None
        return None, _any([_of_strings(s) if s is not None else q for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _walk(inner)
        if strings is not None and (least, most) == (0, 1):
            return {"", *strings}, None
        if least:
            return None, query if strings is None else _of_strings(strings)
    return None, None


def trigram_query(pattern: str) -> object:
    """A trigram (bytes), ("and", ...), ("or", ...), or None if nothing is mandatory."""
    strings, query = _walk(_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _named(query: object) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


class Index:
    """Rows of a segment by trigram, for the trigrams that some query names."""

    def __init__(self, texts: list[str], trigrams: set[bytes]):
        self.rows: dict[bytes, np.ndarray] = {t: np.zeros(0, np.int64) for t in trigrams}
        if not trigrams:
            return
        names = sorted(trigrams)
        table = np.zeros(1 << 24, np.uint8 if len(names) < 256 else np.uint16)
        for k, t in enumerate(names):
            table[t[0] | t[1] << 8 | t[2] << 16] = k + 1
        found = [[] for _ in names]
        for lo, hi in runs(texts):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
            ends = np.cumsum([len(b) + 1 for b in raw])
            data = LOWER[np.frombuffer(b"\xff".join(raw), np.uint8)].astype(np.uint32)  # \xff is in no text
            if len(data) < 3:
                continue
            at = np.flatnonzero(which := table[data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)])
            owner = np.searchsorted(ends, at, side="right") + lo
            pairs = np.unique(owner * len(names) + which[at] - 1)
            for k in range(len(names)):
                found[k].append(pairs[pairs % len(names) == k] // len(names))
        for t, parts in zip(names, found, strict=True):
            if parts:
                self.rows[t] = np.concatenate(parts)

    def answer(self, query: object) -> np.ndarray:
        if isinstance(query, bytes):
            return self.rows[query]
        parts = [self.answer(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r.kind, r.compiled(), r.least, r.group, trigram_query(r.pattern)) for r in rules]
        self.trigrams = set().union(*(_named(q) for *_, q in self.rules))

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Per text the (kind, start, end) by start, then by the order of the rules."""
        texts = [t or "" for t in texts]
        index = Index(texts, self.trigrams)
        found: list[list] = [[] for _ in texts]
        for order, (kind, pattern, least, group, query) in enumerate(self.rules):
            for i in range(len(texts)) if query is None else index.answer(query).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        found[i].append((m.start(), order, m.end(), kind))
        return [[(kind, a, b) for a, _, b, kind in sorted(rows)] for rows in found]


def spelled(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def digest(spans: list) -> str:
    return hashlib.sha256(spelled(spans).encode()).hexdigest()


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> tuple[DataFrame, str]:
    """All rows with an array of spans (kind, start, end); and that column's name."""
    name = fresh("secrets", docs.columns)
    scanner: list[Scanner] = []

    def work(texts: list) -> list:
        if not scanner:
            scanner.append(Scanner(rules))
        return [[[{"kind": k, "start": a, "stop": b} for k, a, b in row] for row in scanner[0].spans(texts)]]

    return append(docs, {name: "array<struct<kind:string,start:long,stop:long>>"}, work, text), name


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[secret]") -> DataFrame:
    """All rows; what any span covers is one ``mark`` in the text."""
    out, spans = scan(docs, text, rules)
    both, made = fresh("both", out.columns), fresh("made", out.columns)
    from pyspark.sql import functions as F

    def work(rows: list) -> list:
        return [[_redacted(r["x"], r["s"], mark) for r in rows]]

    out = append(out.withColumn(both, F.struct(F.col(f"`{text}`").alias("x"), F.col(spans).alias("s"))), {made: "string"}, work, both)
    return out.select(*[F.col(made).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _redacted(text: str | None, spans: list, mark: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for lo, hi in sorted((s["start"], s["stop"]) for s in spans):
        if lo >= at:
            out += [text[at:lo], mark]
        at = max(at, hi)
    return "".join([*out, text[at:]])
