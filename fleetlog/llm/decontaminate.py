"""Benchmark decontamination: a broadcast hash set of test n-grams against every token window.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). Tasks hash
every window of the whole texts, look the hashes up in the broadcast set, and compare the words of
each hit before it counts.

The set is built from the benchmark in blocks of at most ``BLOCK_CHARS`` characters (a longer item
is a block of its own), whatever its size: one block is the usual case; further blocks are further
passes over the documents with the hits so far kept in a column, so broadcasts stay bounded and
nothing is left out.

Defined cases: a missing or empty text has no words and is clean. Items without words have no
window. An item without an id marks words but is in no list of items. Repeated items and rows
count as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.base import append, fresh, stored
from fleetlog.llm.wordbytes import ALNUM_WORDS, runs, window_hashes, words_of

WIDTH = 13
#: Windows take about 115 bytes a character in Python (words of five letters), in the driver and in every worker.
BLOCK_CHARS = 1_000_000
#: Contaminated: this many times the hit words reach the number of words.
RULE = 20


class Windows:
    """The windows of some items: per width the sorted hashes, and what each hash stands for."""

    def __init__(self, items: list[tuple[object, str]], width: int = WIDTH):
        self.known: dict[tuple[int, int], dict[bytes, set[str]]] = {}
        for item, text in items:
            w = words_of([text], ALNUM_WORDS)
            n = len(w.hash)
            size = min(width, n)
            if not size:
                continue
            spelled = w.text(0, n)
            for k, h in enumerate(window_hashes(w.hash, size).tolist()):
                ids = self.known.setdefault((size, h), {}).setdefault(b" ".join(spelled[k : k + size]), set())
                if item is not None:
                    ids.add(str(item))
        self.sizes = sorted({s for s, _ in self.known})
        self.hashes = {s: np.array(sorted(h for t, h in self.known if t == s), np.uint64) for s in self.sizes}
        # one bit for each value of a hash's top bits: most windows end there
        self.seen = {s: np.zeros(1 << 20, bool) for s in self.sizes}
        for s in self.sizes:
            self.seen[s][(self.hashes[s] >> np.uint64(44)).astype(np.int64)] = True

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """Per text: number of words, positions of hit words, items as sorted strings."""
        counts, hits, found = [], [], []
        for lo, hi in runs(texts):
            w = words_of(texts[lo:hi], ALNUM_WORDS)
            marked = np.zeros(len(w.hash), bool)
            items: list[set[str]] = [set() for _ in range(hi - lo)]
            owner = w.owner()
            for s in self.sizes:
                h = window_hashes(w.hash, s)
                at = np.flatnonzero(self.seen[s][(h >> np.uint64(44)).astype(np.int64)])
                at = at[owner[at] == owner[at + s - 1]]
                place = np.searchsorted(self.hashes[s], h[at])
                at = at[self.hashes[s][np.minimum(place, len(self.hashes[s]) - 1)] == h[at]]
                for k in at.tolist():
                    ids = self.known[s, int(h[k])].get(b" ".join(w.text(k, k + s)))
                    if ids is not None:
                        marked[k : k + s] = True
                        items[owner[k]] |= ids
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                counts.append(int(b - a))
                hits.append(np.flatnonzero(marked[a:b]).tolist())
                found.append(sorted(items[i]))
        return counts, hits, found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int):
    """The items, a bounded block at a time; one pass over the benchmark gives the number of blocks."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("x")).where("length(x) > 0").distinct()
    total = items.agg(F.sum(F.length("x").cast("long"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "x"), F.lit(n)) == k)
        yield [(r.i, r.x) for r in part.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         width: int = WIDTH, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, dict[str, str]]:
    """All rows with ``n_words`` (int), ``hits`` (positions of hit words) and ``items``.

    Returns also the names under which these columns stand.
    """
    names = {}
    for n in ("n_words", "hits", "items"):
        names[n] = fresh(n, [*docs.columns, *names.values()])
    fields = {names["n_words"]: "long", names["hits"]: "array<long>", names["items"]: "array<string>"}
    out = None
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        # bounded: block_chars characters of items
        shared = docs.sparkSession.sparkContext.broadcast(Windows(block, width))
        work = lambda texts, shared=shared: list(shared.value.scan(texts))
        if out is None:
            out = append(docs, fields, work, text)
            continue
        again = {k: fresh(v, out.columns) for k, v in names.items()}
        both = append(stored(out, "decontaminate"), dict(zip(again.values(), fields.values(), strict=True)), work, text)
        out = both.select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.col(names["n_words"]),
            F.array_sort(F.array_union(names["hits"], again["hits"])).alias(names["hits"]),
            F.array_sort(F.array_union(names["items"], again["items"])).alias(names["items"]),
        )
    if out is None:
        shared = docs.sparkSession.sparkContext.broadcast(Windows([], width))
        out = append(docs, fields, lambda texts: list(shared.value.scan(texts)), text)
    return out, names


def verdicts(docs: DataFrame, benchmark: DataFrame, **options) -> tuple[DataFrame, str]:
    """All rows with one column, whose name is returned: is the document contaminated?"""
    out, names = scan(docs, benchmark, **options)
    flag = fresh("contaminated", docs.columns)
    hit = F.size(names["hits"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], ((hit > 0) & (RULE * hit >= F.col(names["n_words"]))).alias(flag)), flag


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All rows, hit words cut out of the text; each gap leaves what stood between words."""
    out, names = scan(docs, benchmark, text=text, **options)
    cut = fresh("cut", out.columns)
    pairs = fresh("pair", [*out.columns, cut])
    out = out.withColumn(pairs, F.struct(F.col(text).alias("x"), F.col(names["hits"]).alias("h")))
    out = append(out, {cut: "string"}, lambda rows: [[_without(r["x"], r["h"]) for r in rows]], pairs)
    return out.select(*[F.col(cut).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _without(text: str | None, hits: list[int]) -> str | None:
    if not hits:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    w = words_of([text], ALNUM_WORDS)
    keep = np.ones(len(raw), bool)
    for k in hits:
        keep[w.start[k] : w.end[k]] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "surrogatepass")


def digest(items: list[str]) -> str:
    """sha256 of the item ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
