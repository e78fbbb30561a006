import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

from brute import DOCS, messy_docs, near_components  # noqa: E402

from fleetlog.llm import components, mixing, preference, setsketch, topk, urlrules  # noqa: E402

# ---- near copies


def family(seed, n=12, words=80):
    """A text and copies with more and more words changed."""
    rng = random.Random(seed)
    base = [f"{seed}w{rng.randrange(500)}" for _ in range(words)]
    out = [" ".join(base)]
    for k in range(n):
        w = base[:]
        for _ in range(k % 6):
            w[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def check_near(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in setsketch.near_copies(docs).collect()}
    roots, sets = near_components(texts)
    low = defaultdict(list)
    for i, r in enumerate(roots):
        low[r].append(ids[i])
    for i, r in enumerate(roots):
        row = got[ids[i]]
        assert (row.n_shingles, row.component_id, row.kept) == (len(sets[i]), min(low[r]), ids[i] == min(low[r]))
    return got


def test_near_copies_against_brute_force(spark):
    texts = [t for seed in range(8) for t in family(seed)]
    texts += ["", None, "a b", "A B", "a b c d e", "a  B\tc d e", "e d c b a"] + [texts[3]] * 30
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    check_near(spark, texts, ids)


def test_a_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(140)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 80, 5)]
    got = check_near(spark, texts)
    assert {r.component_id for r in got.values()} == {0}


def test_keys_of_many_components_are_compared_in_blocks(spark, monkeypatch):
    """Groups that share a passage but are not linked, and links that no centre has."""
    monkeypatch.setattr(setsketch, "BLOCK_NODES", 4)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = []
    for k in range(14):
        own = " ".join(f"o{k}_{i}" for i in range(22 + k))
        texts += [f"{shared} {own}", f"{shared} {own} end{k}"]
    check_near(spark, texts)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(30):
            n = 400
            both = rng.integers(0, 2**63, int(n * share), np.uint64)
            rest = (n - len(both)) // 2
            a = np.concatenate([both, rng.integers(0, 2**63, rest, np.uint64)])
            b = np.concatenate([both, rng.integers(0, 2**63, rest, np.uint64)])
            ra, rb = setsketch.sketch(a), setsketch.sketch(b)
            true = len(both) / (len(a) + len(b) - len(both))
            errors.append(setsketch.estimate(np.array([len(a)]), np.array([len(b)]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))[0] - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045
    union = np.concatenate([a, b])
    assert (setsketch.sketch(union) == np.maximum(setsketch.sketch(a), setsketch.sketch(b))).all()


def test_near_copies_on_messy_rows(spark):
    docs = messy_docs(spark)
    got = {(r.doc_id, r.n_shingles): r for r in setsketch.near_copies(docs).collect()}
    assert setsketch.near_copies(docs).count() == docs.count()
    assert got[2, 6].component_id == 1 and not got[2, 6].kept and got[1, 6].kept
    assert got[8, 1].component_id == 7 and got[5, 0].kept and got[4, 0].component_id == 4
    assert got[None, 3].component_id is None and got[None, 0].component_id is None
    kept = setsketch.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 7), (False, 9), (False, 10), (False, 11), (True, 0), (True, 0)]
    assert setsketch.near_copies(docs.limit(0)).count() == 0 and setsketch.one_of_each(docs.limit(0)).count() == 0


def test_components_of_random_links(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


# ---- top-k


def vectors(rows):
    return [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]


def best_by_hand(rows, k=10):
    usable = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q % 100 == 0:
            scores = {}
            for c, w in usable:
                if c != q:
                    scores[c] = max(scores.get(c, -(10**30)), sum(a * b for a, b in zip(v, w)))
            order = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
            out += [(q, n, c, s) for n, (c, s) in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 4096), (2, 30)])
def test_topk_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(3)
    rows = [(i * 10, list(rng.normal(0, 0.3, 7).astype("float32"))) for i in range(120)]
    rows += [(2000 + i, [0.5] * 7) for i in range(60)]  # one very common vector
    rows += [(1, None), (100, [None] * 7), (None, [0.1] * 7), (3, [float("nan")] * 7), (4, [float("inf")] * 7), (5, []), (6, [0.2] * 3), (7, [0.9] * 9)]
    df = spark.createDataFrame(vectors(rows), T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("id") % 100 == 0).collect())
    assert got == best_by_hand(rows)


@pytest.mark.parametrize("blocks", [(1024, 4096), (2, 5)])
def test_topk_counts_repeated_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(1, 60)] + [(0, [1.0, 1.0, 1.0, 1.0]), (100, [1.0, -1.0, 0.0, 2.0]), (100, [1.0, -1.0, 0.0, 2.0]), (200, [0.0, 0.0, 1.0, 0.0])]
    rows += [(301, [9.0, 9.0, 9.0, 9.0])] * 3 + [(301, [2.0, 2.0, 2.0, 2.0])] + [(302, [8.0, -8.0, 8.0, 8.0])] * 12  # best of query 0 and more than k of queries 100 and 200
    want = []
    for q in (0, 100, 200):
        pairs = [(-sum(int(1024 * x) * int(1024 * y) for x, y in zip(v, w)), c) for i, v in rows if i == q for c, w in rows if c != q]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(pairs)[:10], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("id") % 100 == 0).collect())
    assert got == want


def test_topk_of_few_large_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1e5, 2e5]), (1, [3e5, -1e5]), (2, [1e5, 1e5])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 3 * 10**10 * 1024**2), (0, 2, 1, 10**10 * 1024**2)]
    assert topk.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


# ---- mixing


def targets_by_hand(sizes):
    """Reshare the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def mixed(docs, labels=None):
    rows, names = mixing.mix(mixing.keyed(mixing.sized(docs, carry=docs.columns), labels))
    return rows, names


def test_mixing_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 200])), rng.choice(["a", "b", "b", "b", "b", "é", None, "tiny"] if i % 9 else ["B"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 600, 3)] + [(0, 1, 0), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    out, names = mixed(docs, labels)
    got = out.collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets_by_hand(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(r.text.split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(taken[s] == int(want[s] + 1e-6) for s in sizes)
    again = mixed(docs.repartition(7), labels)[0].collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    corpus = mixing.taken_rows(out, names, docs.columns).collect()
    words = defaultdict(int)
    for r in corpus:
        words[r.source] += len(r.text.split())
    assert {s: words[s] for s in sizes} == {s: taken[s] for s in sizes}
    labelled = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").unionByName(
        spark.createDataFrame([(i, 0, 0) for i in range(300, 600)], "doc_id long, quality int, toxic int")
    )
    flat = spark.createDataFrame([(i, "one two three four", "a" if i % 2 else "b") for i in range(600)], "doc_id long, text string, source string")
    halves = mixed(flat, labelled)[0].groupBy((F.col("doc_id") < 300).alias("good"), "source").agg(F.sum("taken").alias("n")).collect()
    part = {(r.good, r.source): r.n for r in halves}
    assert part[True, "a"] > 1.3 * part[False, "a"]


def test_mixing_on_messy_rows(spark):
    docs = messy_docs(spark)
    out, names = mixed(docs)
    assert names == {"size": "size_", "source_size": "source_size", "target": "target", "taken": "taken_"}
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["size_"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    assert sorted(mixing.taken_rows(out, names, docs.columns).columns) == sorted(docs.columns)
    assert mixed(docs.limit(0))[0].count() == 0
    repeated = spark.createDataFrame([(1, "a b c d", "s")] * 50 + [(2, "x", "t")], "doc_id long, text string, source string")
    total = {r.source: r.n for r in mixed(repeated)[0].groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert total["t"] == 3 and 150 <= total["s"] <= 198


# ---- urls


def url_rows(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_rules_hosts_and_paths(spark):
    cases = [
        ("https://A.Example.NET/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/1#t", "example.net", "/de/1", "net/", "block"),
        ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
        ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
        ("http://a.org/fr/x://y", "a.org", "/fr/x://y", "org/fr/", "allow"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("no scheme net/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://É.org?x", "É.org", "", None, "allow"),
        ("a\nb://Net/q", "net", "/q", "net/", "block"),
        ("http://user@x.net:80/en/", "user@x.net:80", "/en/", None, "allow"),
    ]
    out, names = urlrules.judge(url_rows(spark, [c[0] for c in cases]))
    assert names["host"] == "host_"
    got = {r.page_id: (r.host_, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urlrules.judge(url_rows(spark, ["x"]).limit(0))[0].count() == 0


def test_tree_generalises_and_merges(spark):
    urls = [f"http://h.example.com/de/shop/{i}.html" for i in range(30)] + [f"http://h.example.com/en/{w}{v}/page" for w in "abcdefghij" for v in "klmnopq"]
    urls += [f"http://h.example.com/news/{k}/{i}" for k in ("x", "y", "z") for i in range(20)]
    out, names = urlrules.judge(url_rows(spark, urls))
    found = {r[0] for r in out.select(names["template"]).distinct().collect()}
    assert "/de/shop/*.html" in found and "/en/*/page" in found
    assert len({t for t in found if t.startswith("/news/")}) == 1
    deep = urlrules.judge(url_rows(spark, ["http://a.org/" + "/".join("abcdefgh") + "/" + "q" * 5000]))[0].first()
    assert deep.path.startswith("/a/b/c/d/e") and deep.verdict == "allow"


def test_purity_of_merged_branches_decides(spark):
    pages = lambda branch, below, n: [f"http://h.example.com/{branch}/{below.format(i)}" for i in range(n)]
    urls = pages("de", "shop/{}.html", 40)  # blocked by a rule
    urls += pages("nl", "shop/{}.html", 30)  # no rule, the same pages
    urls += pages("docs", "guide/{}", 50) + pages("help", "guide/{}", 20)  # no rule, others
    urls += ["http://h.example.com/about"]
    mixed = lambda n: [f"http://h.example.com/{n}/{x}/{i}" for x, k in (("a", 60), ("b", 40)) for i in range(k)]
    far = [f"http://h.example.com/w/{x}/{i}" for x, k in (("a", 95), ("c", 5)) for i in range(k)]
    far2 = [f"http://h.example.com/v/{x}/{i}" for x, k in (("a", 90), ("c", 5)) for i in range(k)]
    urls += mixed("u") + [f"{u}1" for u in mixed("u")] + far + far2
    rows = urlrules.judge(url_rows(spark, urls))[0].select("url", "rule", "template", "verdict").collect()
    verdict = {}
    for r in rows:
        verdict.setdefault(r.url.split("/")[3], set()).add(r.verdict)
    assert verdict["de"] == verdict["nl"] == {"block"}
    assert all(v == {"allow"} for k, v in verdict.items() if k not in ("de", "nl"))
    # v is far from u, the first leader of its kind, and joins w
    top = lambda k: {r.template.split("/")[1] for r in rows if r.url.split("/")[3] == k}
    assert top("v") == top("w") != top("u")


# ---- preference pairs


def test_longest_common_prefix_and_masks(spark):
    schema = "pair long, turn int, role string, text string"
    chosen = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "only chosen"), (None, 0, "user", "x"), (4, None, "user", "x")]
    rejected = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "go away"), (1, 3, "user", None), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (5, 0, None, "only rejected")]
    got = preference.format_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()
    sides = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.pair, r.side, r.start)):
        sides[r.pair, r.side].append(r)
    text = {k: "".join(r.segment for r in v) for k, v in sides.items()}
    assert text[1, "prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n"
    assert text[1, "chosen"] == "<|assistant|>\nhello<|end|>\n" and text[1, "rejected"] == "<|assistant|>\ngo away<|end|>\n<|user|>\n<|end|>\n"
    assert set(sides) == {(1, "prompt"), (1, "chosen"), (1, "rejected"), (2, "prompt"), (3, "chosen"), (5, "rejected")}
    assert text[5, "rejected"] == "<|unknown|>\nonly rejected<|end|>\n"
    for (pair, side), rows in sides.items():
        at = len(text[pair, "prompt"]) if side != "prompt" and (pair, "prompt") in text else 0
        whole = (text.get((pair, "prompt"), "") if side != "prompt" else "") + text[pair, side]
        for r in rows:
            assert r.start == at and whole[r.start : r.stop] == r.segment
            at = r.stop
            assert (r.loss_start is None) == (side == "prompt" or r.role != "assistant")
            if r.loss_start is not None:
                assert whole[r.loss_start : r.loss_end].endswith("<|end|>\n") and not whole[r.loss_start : r.loss_end].startswith("<|")


def test_long_conversations_run_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(preference, "CHUNK_TURNS", 5)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * (t % 7)) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = preference.format_pairs(*preference.echo_pairs(turns)).collect()
    at = 0
    for r in sorted((r for r in got if r.side == "prompt"), key=lambda r: r.turn):
        assert r.start == at
        at = r.stop
    assert {r.side: (r.turn, r.start) for r in got if r.side != "prompt"} == {"chosen": (59, at), "rejected": (59, at)}
    assert preference.format_pairs(*preference.echo_pairs(turns.limit(0))).count() == 0
