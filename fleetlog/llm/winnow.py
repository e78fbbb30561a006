"""Winnowing fingerprints in DataFrame functions: hashes of all k-grams, the least of each window kept.

Every run of ``k`` code points is hashed; of each ``window`` consecutive hashes the least is kept,
the rightmost of equal ones, with its position. So two texts that share ``window + k - 1`` code points
share a fingerprint, wherever the passage lies, and passages below ``k`` are never matched.

How it is done without running state: the text is laid out as four bytes a code point, so that
any k-gram is found in constant time. A hash and its position are one long number (hash in the upper 32 bits,
distance from the end of the number range below), whose minimum is the least hash and, of equal ones, the rightmost. Hashes lie in blocks of
half a window, and a window holds a whole block next to any of its places. So only hashes in the lowest quarter can
be kept, unless a block has none: then all of it and of its neighbours. And a place can only be
kept if it is not above the least of its own and both neighbouring blocks (about two places a block are left);
among these it is kept if the next smaller ones to both sides are more than a window apart. That is the
same set that sliding over all windows gives. Blocks are worked on in pieces of a fixed number, so memory
beyond text and result does not grow with the text.

Defined cases: a missing text is empty and has no fingerprint. A text below ``k`` code points is one k-gram;
one with fewer hashes than a window is one window. The likeness of two empty fingerprints is 1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.base import fresh

K = 20
WINDOW = 47
#: Blocks of half a window that are worked on at once.
PIECE = 256
#: Code points of text in one range of ids, and the most ranges.
CHUNK_CHARS = 2_000_000
MOST_CHUNKS = 1 << 15

_LOW = (1 << 32) - 1
#: A quarter of all 64-bit hashes lie below.
LOW_HASH = -(1 << 62)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside array functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def place(key: Column) -> Column:
    """Zero-based position of a packed fingerprint's k-gram."""
    return F.shiftright(F.lit(_LOW) - key.bitwiseAND(F.lit(_LOW)), 2)


def grams(text: Column, k: int = K, window: int = WINDOW, piece: int = PIECE) -> Column:
    """The kept k-grams in order of their positions, packed as array<bigint>."""
    half = (window + 1) // 2

    def hashed(codes: Column, byte: Column) -> Column:
        return F.xxhash64(F.substring(codes, byte, F.lit(4 * k)))

    def open_window(c: Column, near: Column, n: Column) -> Column:
        """Some window around a place has no smaller one."""
        at = place(c)
        smaller = F.transform(F.filter(near, lambda x: x < c), place)

        def apart(others: Column) -> Column:
            before = F.greatest(F.coalesce(F.array_max(F.filter(others, lambda p: p < at)), F.lit(-1)), at - window, F.lit(-1))
            after = F.least(F.coalesce(F.array_min(F.filter(others, lambda p: p > at)), n), at + window, n)
            return after - before > F.least(F.lit(window), n)

        return _bound(smaller, apart)

    def of_piece(codes: Column, n: Column, p: Column) -> Column:
        last = F.floor((n - 1) / half).cast("int")
        first = F.greatest(p * piece - 3, F.lit(0))
        # one-based bytes at which the k-grams of a block begin
        bytes_of = lambda b: F.sequence(b * (4 * half) + 1, F.least(b * half + half, n) * 4 - 3, F.lit(4))
        ids = F.sequence(first, F.least(p * piece + piece + 2, last))
        low = F.transform(ids, lambda b: F.filter(bytes_of(b), lambda i: hashed(codes, i) < LOW_HASH))
        own = F.sequence(p * piece - first, F.least(p * piece + piece - 1, last) - first)

        def keyed(low: Column) -> Column:
            """Next to a block without a low hash a whole block may count, elsewhere only low hashes can."""
            bare = lambda j: F.coalesce(F.size(F.get(low, j)) == 0, F.lit(False))
            return F.transform(
                ids,
                lambda b, j: F.transform(
                    F.when(bare(j - 1) | bare(j) | bare(j + 1), bytes_of(b)).otherwise(F.get(low, j)),
                    lambda i: hashed(codes, i).bitwiseAND(F.lit(-1 - _LOW)) + (F.lit(_LOW) - i),
                ),
            )

        def few(blocks: Column) -> Column:
            least = F.transform(blocks, F.array_min)
            return _bound(
                least,
                lambda m: F.transform(
                    blocks,
                    lambda block, j: _bound(F.greatest(F.get(m, j - 1), F.get(m, j), F.get(m, j + 1)), lambda top: F.filter(block, lambda x: x <= top)),
                ),
            )

        def kept(some: Column) -> Column:
            around = lambda j: F.flatten(F.slice(some, F.greatest(j - 1, F.lit(1)), F.lit(4) + F.least(j - 1, F.lit(1))))
            return F.flatten(F.transform(own, lambda j: _bound(around(j), lambda near: F.filter(F.get(some, j), lambda c: open_window(c, near, n)))))

        return _bound(_bound(_bound(low, keyed), few), kept)

    def of_codes(codes: Column) -> Column:
        n = F.greatest((F.length(codes) / 4).cast("int") - k + 1, F.lit(1))
        pieces = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / (half * piece)).cast("int"))
        return _bound(n, lambda n: F.flatten(F.transform(pieces(n), lambda p: of_piece(codes, n, p))))

    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", F.array().cast("array<bigint>")).otherwise(_bound(F.encode(whole, "UTF-32"), of_codes))


def hashes(packed: Column) -> Column:
    """The distinct hashes of packed fingerprints, 32 bits each."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 32).cast("int")))


def spelled(packed: Column) -> Column:
    """Fingerprints as text: ``hash@position`` by position, comma-joined."""
    one = lambda x: F.concat(F.lower(F.substring(F.lpad(F.hex(x), 16, "0"), 1, 8)), F.lit("@"), place(x).cast("string"))
    return F.array_join(F.transform(packed, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct hashes over all distinct hashes, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    return _bound(shared, lambda s: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(s / (F.size(a) + F.size(b) - s)))


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> tuple[DataFrame, str]:
    """Add array<struct<hash int, position bigint>> of the kept k-grams; also the new column's name."""
    name = fresh("fingerprint", docs.columns)
    return docs.withColumn(
        name, F.transform(grams(F.col(f"`{text}`"), k, window), lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("hash"), place(x).alias("position")))
    ), name


def _numbers(values: list[int]) -> Column:
    """Whole numbers as one literal array."""
    return F.lit(np.array(values, np.int64)).cast("array<bigint>") if values else F.array().cast("array<bigint>")


def followed(docs: DataFrame, carried: list[str], doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows with ``next_<c>`` of the row behind them in descending order of the id; the first follows the last.

    Rows of one id are ordered by a hash of their text, rows without an id come last. Rows are put into
    ranges of ids of about ``chunk_chars`` code points (one shuffle); the first row of a range also goes to the
    range before it, the very first to the last range, a lap later. Rows of the same id, and those without, are one range.
    """
    key = F.col(doc_id).cast("long")
    total, rows = docs.agg(F.sum(F.length(text).cast("long")), F.count(F.lit(1))).first()
    if not rows:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    chunks = max(1, min(MOST_CHUNKS, -(-(total or 0) // chunk_chars)))
    at = [i / chunks for i in range(1, chunks)]
    cuts = sorted(set(docs.agg(F.percentile_approx(key, at, 10 * chunks)).first()[0] or [])) if at else []
    points = _numbers(cuts)
    steps = len(cuts).bit_length()
    halving = F.array(*[F.lit(1 << (steps - 1 - s)) for s in range(steps)]).cast("array<int>")
    # cuts below the id, by binary search
    below = F.aggregate(halving, F.lit(0), lambda lo, step: F.when(F.get(points, lo + step - 1) < key, lo + step).otherwise(lo))
    chunk = F.when(key.isNull(), F.lit(0)).otherwise(below)
    heads = {r.c: r.h for r in docs.select(chunk.alias("c"), key.alias("k")).groupBy("c").agg(F.max("k").alias("h")).collect()}  # a row a range
    order = sorted(heads)
    above = {c: order[i + 1] if i + 1 < len(order) else order[0] for i, c in enumerate(order)}
    span = range(len(cuts) + 1)
    # a range of rows without an id has no head: theirs is null like their ids
    head_of = F.get(_numbers([heads.get(c) or 0 for c in span]), F.col("_chunk"))
    head_of = F.when(F.col("_chunk").isin([c for c in order if heads[c] is None]), F.lit(None)).otherwise(head_of)
    goes_to = F.get(_numbers([above.get(c, c) for c in span]), F.col("_chunk")).cast("int")
    placed = docs.withColumn("_chunk", chunk)
    stay = F.struct(F.col("_chunk").alias("at"), F.lit(0).alias("lap"), F.lit(True).alias("home"))
    lap = F.when(F.col("_chunk") == order[-1], 1).otherwise(0)
    copy = F.struct(goes_to.alias("at"), lap.alias("lap"), F.lit(False).alias("home"))
    spread = placed.withColumn("_to", F.explode(F.when(key.eqNullSafe(head_of), F.array(stay, copy)).otherwise(F.array(stay))))
    inside = Window.partitionBy("_to.at").orderBy("_to.lap", key.desc_nulls_last(), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return spread.select(*docs.columns, "_to", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carried]).where("_to.home").drop("_to")


def edited_pairs(docs: DataFrame, k: int = K, window: int = WINDOW, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """For ``doc_id``, ``text``: the text with its second half taken from the next document, fingerprints of both, likenesses."""
    plain = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = plain.withColumn("packed", grams(F.col("text"), k, window))
    pairs = followed(marked, ["text", "packed"], chunk_chars=chunk_chars)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = pairs.select("doc_id", "text", "packed", "next_packed", edited.alias("edited"))
    found = both.select("*", grams(F.col("edited"), k, window).alias("edited_packed"))
    sets = found.select("*", hashes(F.col("packed")).alias("own"), hashes(F.col("edited_packed")).alias("other"), hashes(F.col("next_packed")).alias("following"))
    return sets.select(
        "doc_id", "text", "edited", "packed", "edited_packed",
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
