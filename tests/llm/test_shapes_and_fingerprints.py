"""Fill-in-middle, winnowing and whitening against plain versions."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from brute import messy_docs  # noqa: E402

from fleetlog.llm import middle, whiten, winnow  # noqa: E402

TEXTS = st.text(alphabet="ab<>PSM \né\U0001f600", max_size=40)


# ---- fill-in-middle


def middle_by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_middle_on_messy_rows_and_back(spark):
    docs = messy_docs(spark, [(100 + i, f"text {i} é\U0001f600 <{'PSM'[i % 3]} tail > " * (i % 5) + "<P>" * (i == 9), "en", "a", 0) for i in range(60)])
    docs = docs.withColumn("form", F.lit("taken")).withColumn("N", F.lit(1))
    out, names = middle.transform(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and names["form"] == "form_" and names["n"] == "n_"
    got = out.select("doc_id", "text", *names.values(), middle.restored(F.col(names["output"]), F.col(names["form"])).alias("back")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[2:7] == middle_by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r[names["form"]] for r in got} == {"plain", "psm", "spm"}
    assert middle.transform(docs.limit(0))[0].count() == 0


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_cut_texts_can_always_be_put_together(text, numbers):
    n, form, a, m, out = middle.cut(text, numbers, regex.compile(f"({middle.CODE_POINT})*+"))
    assert n == len(text)
    if form != "plain":
        _, x, y, z = regex.split("<P>|<S>|<M>", out)
        assert (x + z + y if form == "psm" else y + z + x) == text
        assert (a, m) == (len(x if form == "psm" else y), len(z))


def test_middle_cuts_between_other_units():
    words = regex.compile(r"(\w+\W*)*+")
    n, form, a, m, out = middle.cut("one two three", [1, 2, 0, 99], words)
    assert (n, form, a, m, out) == (3, "psm", 4, 4, "<P>one <S>three<M>two ")
    assert middle.cut("  leading", [1, 2, 0, 99], words) == (None, "plain", None, None, "  leading")


# ---- winnowing


def hash_of(gram):
    x = xxhash.xxh64_intdigest(gram.encode("utf-32-be", "surrogatepass"), seed=42) >> 32
    return x - (1 << 32) if x >= 1 << 31 else x


def winnow_by_hand(text, k, window):
    """Slide over all windows: the least hash, the rightmost of equal ones."""
    if not text:
        return []
    values = [hash_of(text[i : i + k]) for i in range(max(1, len(text) - k + 1))]
    kept = set()
    for lo in range(max(1, len(values) - window + 1)):
        some = values[lo : lo + window]
        kept.add(lo + max(i for i, v in enumerate(some) if v == min(some)))
    return [(values[i], i) for i in sorted(kept)]


def fingerprints(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out, name = winnow.fingerprints(docs, **how)
    return {r.i: [tuple(x) for x in r[name]] for r in out.collect()}


@pytest.mark.parametrize("k,window", [(20, 47), (5, 8), (1, 1), (3, 2), (4, 13)])
def test_winnowing_keeps_what_sliding_windows_keep(spark, k, window):
    rng = random.Random(k)
    texts = ["", None, "a", "ab" * 3, "x" * 300, "ab" * 200, "\U0001f600é" * 90, "".join(sorted(rng.choices("abcdefgh", k=400)))]
    texts += ["".join(rng.choices("ab c", k=rng.randint(1, 900))) for _ in range(25)]
    texts += ["".join(rng.choices("abcdefghijklm nopq", k=n)) for n in (k, k + 1, k + window - 2, k + window - 1, k + window, 20_000)]
    got = fingerprints(spark, texts, k=k, window=window)
    for i, t in enumerate(texts):
        assert got[i] == winnow_by_hand(t, k, window), (i, t and t[:50])


def test_a_shared_passage_shares_a_fingerprint(spark):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = say(winnow.WINDOW + winnow.K - 1)
    got = fingerprints(spark, [say(500) + passage + say(333), say(77) + passage, say(900)])
    of = [{h for h, _ in got[i]} for i in range(3)]
    assert of[0] & of[1] and not of[0] & of[2]


def edits_by_hand(rows):
    """(id, text) -> edited text, in descending order of ids; repeated ids by their texts' hash."""
    tie = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(tie(r[1]))))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + after[:half], after))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [10**9, 700, 90])
def test_edited_texts_and_likenesses(spark, chunk):
    rng = random.Random(chunk)
    base = [(i * 7 % 1009 - 300, "".join(rng.choices("abcd efg", k=rng.randint(0, 300))), "en", "a", 0) for i in range(60)]
    docs = messy_docs(spark, base).repartition(5)
    got = winnow.edited_pairs(docs, chunk_chars=chunk).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = edits_by_hand(rows)
    assert sorted(((r.doc_id, r.text, r.edited) for r in got), key=repr) == [w[:3] for w in want]
    after = {w[:3]: w[3] for w in want}
    grams = lambda t: {h for h, _ in winnow_by_hand(t, winnow.K, winnow.WINDOW)}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in got:
        if len(r.text) > 5000:
            continue
        own = grams(r.text)
        assert r.near_edited == pytest.approx(share(own, grams(r.edited)))
        assert r.near_next == pytest.approx(share(own, grams(after[r.doc_id, r.text, r.edited])))


@pytest.mark.parametrize("rows", [[], [(5, "only one")], [(None, "x" * 60), (None, "y" * 60)], [(1, None)]])
def test_winnowing_of_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = winnow.edited_pairs(docs).collect()
    assert sorted(((r.doc_id, r.text, r.edited) for r in got), key=repr) == [w[:3] for w in edits_by_hand(rows)]


# ---- whitening


def whitened_by_hand(vectors, k=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    c = (n * x - s).astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return deviation, c, values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(c.T @ c / n)


@pytest.mark.parametrize("n,d", [(400, 16), (60, 64), (50, 3)])
def test_whitening_against_numpy(spark, n, d):
    rng = np.random.default_rng(n)
    data = (rng.normal(size=(n, d)) * np.linspace(0.2, 1.5, d)).astype(np.float32)
    odd = [(None, None), (-1, []), (-2, [None] + [0.0] * (d - 1)), (-3, [float("nan")] * d), (-4, [float("inf")] + [0.0] * (d - 1)), (-5, [1.0]), (-6, [3e38] * d)]
    rows = [(i, v.tolist(), "x", "y") for i, v in enumerate(data)] + [(i, v, "x", None) for i, v in odd] + [(7, data[7].tolist(), None, "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, component string").repartition(3)
    out, model = whiten.whiten(table)
    deviation, c, values, vectors, trace = whitened_by_hand([*data, data[7]])
    k = min(8, d)
    got = out.collect()
    assert model.n == n + 1 and len(got) == (n + 1) * k
    assert np.allclose(model.values, values, rtol=1e-12)
    assert np.allclose(model.values / model.trace, values / trace, rtol=1e-10)
    assert np.abs(np.abs(np.sum(model.components * vectors, 0)) - 1).max() < 1e-12
    assert model.identity_error < 1e-10
    sign = np.sign(np.sum(model.components * vectors, 0))
    want = c @ vectors * sign / np.sqrt(values)
    for r in got:
        assert int(r.deviation) == deviation[r.vec_id]
        assert abs(r.whitened - want[r.vec_id, r.component - 1]) < 1e-9
    assert sum(r.vec_id == 7 for r in got) == 2 * k


def test_whitening_of_flat_few_and_no_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whiten.whiten(table([]))[0].count() == 0
    assert whiten.whiten(table([(1, [0.5, 0.25])]))[0].count() == 0
    assert whiten.whiten(table([(i, [0.5, 0.25]) for i in range(5)]))[0].count() == 0
    out, model = whiten.whiten(table([(i, [float(i), 2.0 * i, 1.0]) for i in range(6)]))  # rank one
    assert len(model.values) == 1 and {r.component for r in out.collect()} == {1}


@pytest.mark.parametrize("case", ["plain", "equal", "clusters", "low rank", "wide"])
def test_jacobi_davidson_reaches_double_precision(case):
    rng = np.random.default_rng(4)
    d = 150 if case == "wide" else 40
    spread = {"equal": np.full(d, 4.0), "clusters": np.repeat([9.0, 9.0 + 1e-9, 4, 1], d // 4), "low rank": np.r_[np.arange(1.0, 4), np.zeros(d - 3)]}
    values = np.sort(spread.get(case, rng.exponential(size=d)))[::-1]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors, rounds = whiten.jacobi_davidson(lambda u: a @ u, d, 8)
    assert np.abs(found - values[: len(found)]).max() < 1e-13 * values[0]
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 64 * np.finfo(float).eps * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13
    assert len(found) == 8 and rounds < whiten.MOST_ROUNDS
