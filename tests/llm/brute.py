"""Plain versions of the contracts, for small inputs, and a table with every odd row."""

import re
from itertools import combinations

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        *[T.StructField(n, T.StringType()) for n in ("row", "score", "rejected", "hits", "size", "key", "node", "rank", "Taken", "contaminated")],
    ]
)


def messy_docs(spark, base=()):
    """Documents with missing values in every column, empty and very long texts, copies and repeated rows."""
    long_text = " ".join(f"word{i % 977} follows number {i}" for i in range(12_000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a", 48),
        (1, "one two three four five six seven eight nine ten", "en", "a", 48),
        (2, "ONE two three four five six seven eight nine ten", "en", "b", 48),
        (3, "one two three four five six seven eight nine other", "en", None, 50),
        (4, None, "en", "a", None),
        (5, "", None, "a", 0),
        (6, " \t\n ", "de", None, 4),
        (7, "short text", "de", "b", 10),
        (8, "Short\x0btext", "de", "b", 10),
        (9, long_text, "en", "a", len(long_text)),
        (10, "12345 67890 !!! ...", None, "c", 19),
        (11, "é" * 50 + " ünïcödé \U0001f600 text   end", "fr", "c", 70),
        (None, "no id here at all but text", "en", "a", 26),
        (None, "no id here at all but text", "en", "a", 26),
        (None, None, None, None, None),
        *base,
    ]
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], DOCS)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(rows):
    """Index of each row -> smallest index linked with it."""
    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))], sets


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(text, items):
    """n_words, n_hit and the items of one text."""
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(13, len(v))
        if not size:
            continue
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)
