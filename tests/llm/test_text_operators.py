import random
import re
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from brute import DOCS, LOWER, contamination, messy_docs, words  # noqa: E402

from fleetlog.llm import decontaminate, language, secrets, tokens, toxicity, wordbytes  # noqa: E402
from fleetlog.llm.queries import tokenizer_path  # noqa: E402

TEXTS = st.text(alphabet="aB1 \t\n.,'\x0béß\U0001f600 -_", max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    for alphabet, pattern in ((wordbytes.SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (wordbytes.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = wordbytes.words_of(texts, alphabet)
        seen = {}
        for i, t in enumerate(texts):
            got = [b.decode() for b in w.text(w.first[i], w.first[i + 1])]
            assert got == re.findall(pattern, (t or "").translate(LOWER))
            for word, h in zip(got, w.hash[w.first[i] : w.first[i + 1]].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_a_word_hashes_alike_wherever_it_stands():
    filler = " ".join("x" * (i % 7 + 1) for i in range(5000))
    far = wordbytes.words_of([filler + " needle"], wordbytes.SPACE_WORDS)
    near = wordbytes.words_of(["needle"], wordbytes.SPACE_WORDS)
    assert far.hash[-1] == near.hash[0]


# ---- benchmark decontamination


def test_decontamination_against_brute_force():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 12, 13, 14, 40])))) for i in range(25)]
    items += [(None, "quite unique words without an item id to them"), (7, ""), (8, None), (3, items[4][1])]
    docs = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)]
    docs += [f"Start {items[6][1].upper()}, and then: {items[9][1]}!", None, "", "quite unique words without an item id to them"]
    counts, hits, found = decontaminate.Windows(items).scan(docs)
    for text, n, h, f in zip(docs, counts, hits, found, strict=True):
        assert (n, len(h), f) == contamination(text, items)


@pytest.mark.parametrize("letters", [1, 5])
def test_a_block_of_windows_fits_a_worker(letters):
    rng = random.Random(letters)
    items = [(i, " ".join("".join(rng.choices("abcdefghij", k=letters)) for _ in range(100))) for i in range(500)]
    tracemalloc.start()
    decontaminate.Windows(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / sum(len(t) for _, t in items) * decontaminate.BLOCK_CHARS < 500e6


@pytest.mark.parametrize("block", [64_000_000, 120])
def test_decontamination_on_messy_rows_in_one_and_many_blocks(spark, block):
    docs = messy_docs(spark)
    items = spark.createDataFrame([(5, "four five six seven eight nine ten"), (12, "short text"), (None, "no id here"), (9, None), (40, "number 17 word18")], "item_id long, text string")
    found, names = decontaminate.scan(docs, items, block_chars=block)
    for r in found.collect():
        n, hit, ids = contamination(r["text"], [(i.item_id, i.text) for i in items.collect()])
        assert (r[names["n_words"]], len(r[names["hits"]]), list(r[names["items"]])) == (n, hit, ids)
    kept, flag = decontaminate.verdicts(docs, items)
    assert flag == "contaminated_" and kept.columns == [*docs.columns, flag]
    clean = decontaminate.remove_spans(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert {r.text.split() and " ".join(r.text.split()) for r in clean.where("doc_id = 1").collect()} == {"one two three"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontaminate.scan(docs, items)[0].count() == 0
    assert language.identify(docs, language.fit(docs))[0].count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels))[0].count() == 0
    assert secrets.scan(docs)[0].count() == 0
    assert tokens.encode_documents(docs, tokenizer_path()).count() == 0


# ---- secrets


def spans_by_hand(text):
    out = []
    base = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    )
    for k, (kind, pattern, group, least) in enumerate(base):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


PIECES = ["password", "PassWord", "tok", "en", "token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "x", "é", "\n", "\U0001f600", "ſecret=aaaaaaaaaaaa"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=5))
def test_base_spans_are_those_of_the_patterns(texts):
    got = secrets.Scanner(secrets.BASE + secrets.MORE).spans(texts)
    for text, spans in zip(texts, got, strict=True):
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        assert base == spans_by_hand(text)


def test_trigram_queries_hold_for_every_match():
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", [b"aki", b"kia"])
    assert secrets.trigram_query(r"(abcd|xyz)?q") is None
    one = secrets.trigram_query(r"x(abc|de)y")
    assert one == ("or", [("and", [b"xab", b"abc", b"bcy"]), ("and", [b"xde", b"dey"])])
    assert secrets.trigram_query(r"[^a]b.c") is None


def test_secrets_on_messy_rows(spark):
    docs = messy_docs(spark, [(20, "key ghp_" + "Z1" * 20 + " password = 'abcdefghijklm'", "en", "a", 1)])
    found, spans = secrets.scan(docs)
    for r in found.collect():
        assert [(s["kind"], s["start"], s["stop"]) for s in r[spans] if s["kind"] in ("assign", "access", "hex")] == spans_by_hand(r["text"])
    assert {s["kind"] for r in found.where("doc_id = 20").collect() for s in r[spans]} == {"hub_token", "assign"}
    clean = secrets.redact(docs)
    assert clean.where("doc_id = 20").first().text == "key [secret] [secret]'"
    assert clean.where("doc_id = 1").count() == 2


# ---- language


def corpora():
    rng = random.Random(1)
    kinds = {"en": ["the", "thing", "with", "of", "and", "shall"], "de": ["der", "schön", "und", "nicht", "über", "zu"], "fr": ["le", "être", "que", "vous", "ça", "dans"]}
    return [(" ".join(rng.choices(v, k=rng.randint(4, 40))), k) for _ in range(120) for k, v in kinds.items()]


def test_language_learns_and_rejects():
    rows = corpora()
    model = language.train([t for t, _ in rows[:240]], [y for _, y in rows[:240]])
    names, sure, rejected = language.predict(model, [t for t, _ in rows[240:]])
    assert np.mean([a == y for a, (_, y) in zip(names, rows[240:], strict=True)]) > 0.97
    assert all(0 <= s <= 1 for s in sure) and np.mean(rejected) < 0.03
    assert language.predict(model, [None, "", "12 34 !?", " ", "\u2014 \u2026 \U0001f600 5"]) == (["und"] * 5, [0.0] * 5, [True] * 5)
    assert "und" not in language.predict(model, ["a", "\u00e9", "\u2026\u0436"])[0]
    assert language.predict(language.train([], []), ["text"]) == (["und"], [0.0], [True])


def invented(seed, n=1500):
    """Texts of 3 to 200 invented words in four languages, each with its own syllables."""
    rng = random.Random(seed)
    alphabets = {"aa": ("ptkmn", "aeiou"), "bb": ("bdgrl", "aeoäö"), "cc": ("szfvh", "iuéèa"), "dd": ("cqjñl", "aoióú")}
    syllables = {k: [random.Random(k + c + v).choice(["", "n", "s", "r"]) and c + v + "n" or c + v for c in cs for v in vs] for k, (cs, vs) in alphabets.items()}
    word = lambda k: "".join(rng.choices(syllables[k], k=rng.randint(1, 4)))
    return [(" ".join(word(k) for _ in range(rng.randint(3, 200))), k) for _ in range(n // 4) for k in alphabets]


def test_language_rejects_what_it_has_not_seen():
    rows = invented(1)
    model = language.train(*zip(*rows, strict=True))
    clean = invented(2, 800)
    names, sure, rejected = language.predict(model, [t for t, _ in clean])
    assert [y for _, y in clean] == names and np.mean(rejected) <= 0.01
    rng = random.Random(3)
    say = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))
    for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыьэюя", "的一是不了人我在有他这中大来上国个到说们", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"):
        for n in (10, 60, 400):
            assert np.mean(language.predict(model, [say(letters, n) for _ in range(100)])[2]) >= 0.95
    shuffled = ["".join(rng.sample(t, len(t))) for t, _ in clean if len(t) > 200]
    assert np.mean(language.predict(model, shuffled)[2]) >= 0.95


def test_probabilities_are_calibrated():
    rng = random.Random(5)
    # a fifth of the labels are wrong, so no text can be surer than that
    rows = [(t, y if rng.random() < 0.8 else rng.choice(["aa", "bb", "cc", "dd"])) for t, y in invented(4)]
    model = language.train(*zip(*rows, strict=True))
    held = [(t, y if rng.random() < 0.8 else rng.choice(["aa", "bb", "cc", "dd"])) for t, y in invented(6, 800)]
    names, sure, _ = language.predict(model, [t for t, _ in held])
    assert abs(np.mean(sure) - np.mean([a == y for a, (_, y) in zip(names, held, strict=True)])) < 0.05
    assert 1e-3 < model.temperature < 1e3


def test_language_of_a_long_text_does_not_depend_on_slices(monkeypatch):
    rows = corpora()
    model = language.train([t for t, _ in rows], [y for _, y in rows])
    text = " ".join(t for t, y in rows if y == "de")
    whole = language.predict(model, [text])
    bag = language.bag(text)
    monkeypatch.setattr(language, "CHUNK_BYTES", 97)
    cut = (lambda data, size=97: (data[lo : lo + size + 3] for lo in range(0, max(len(data), 1), size)))
    monkeypatch.setattr(language, "_slices", cut)
    again = language.predict(model, [text])
    assert whole[0] == again[0] and abs(whole[1][0] - again[1][0]) < 1e-9
    assert np.array_equal(bag[0], language.bag(text)[0]) and np.allclose(bag[1], language.bag(text)[1])


def test_language_on_messy_rows(spark):
    docs = messy_docs(spark, [(100 + i, t, y, "s", len(t)) for i, (t, y) in enumerate(corpora())])
    out, pred, score, rejected = language.identify(docs, language.fit(docs))
    assert score == "score_" and rejected == "rejected_"
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r[pred] == "und") == (not letters) and 0 <= r[score] <= 1


# ---- toxicity


def test_forward_backward_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(5)
    scores, trans, start = rng.normal(0, 2, 10), rng.normal(0, 1, (2, 2)), 0.4
    first = np.zeros(10, bool)
    first[[0, 3, 4]] = True

    def by_hand(s):
        total, marginal, pairs = 0.0, np.zeros(len(s)), np.zeros((2, 2))
        for z in product((0, 1), repeat=len(s)):
            w = np.exp(start * z[0] + np.dot(s, z) + sum(trans[a, b] for a, b in zip(z, z[1:])))
            total, marginal = total + w, marginal + w * np.array(z)
            for a, b in zip(z, z[1:]):
                pairs[a, b] += w
        return marginal / total, pairs / total

    parts = [by_hand(s) for s in np.split(scores, [3, 4])]
    p, pairs = toxicity.forward_backward(scores, first, trans, start)
    assert np.allclose(p, np.concatenate([m for m, _ in parts])) and np.allclose(pairs, sum(q for _, q in parts))
    many = np.tile(scores, 300)
    long_p, _ = toxicity.forward_backward(many, np.tile(first, 300), trans, start)
    assert np.allclose(long_p, np.tile(p, 300))


def insults(n=400, seed=2):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("wor", "tal", "mip", "son") for b in ("da", "li", "ken", "osa", "um")]
    rows = []
    for i in range(n):
        w = rng.choices(plain, k=rng.randint(5, 60))
        if i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["grobnak", "vilsu", "grobnix"]))
        rows.append((" ".join(w), int(i % 4 == 0)))
    return rows


def test_toxicity_finds_toxic_documents_and_spans():
    rows = insults()
    model = toxicity.train([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    scores, spans = toxicity.predict(model, [t for t, _ in rows[300:]])
    assert all((s >= 0.5) == (y == 1) for s, (_, y) in zip(scores, rows[300:], strict=True))
    for (text, y), found in zip(rows[300:], spans, strict=True):
        words_found = " ".join(text[s["start"] : s["stop"]] for s in found).split()
        assert words_found == [w for w in text.split() if w.startswith(("grob", "vil"))]
    unicode_text = "é\U0001f600 grobnak worda"
    (span,) = toxicity.predict(model, [unicode_text])[1][0]
    assert unicode_text[span["start"] : span["stop"]] == "grobnak"
    assert len(set(toxicity.predict(model, [None, "", "..."])[0])) == 1


def test_toxicity_on_messy_rows_and_odd_labels(spark):
    docs = messy_docs(spark, [(100 + i, t, "en", "s", len(t)) for i, (t, _) in enumerate(insults())])
    labels = [(100 + i, 1, y) for i, (_, y) in enumerate(insults())] + [(None, 1, 1), (104, 0, None), (104, 1, 0), (1, None, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out, score, spans = toxicity.score(docs, toxicity.fit(docs, table))
    assert score == "score_" and out.count() == docs.count()
    wrong = [r for r in out.where("doc_id >= 100").collect() if (r[score] >= 0.5) != ((r["doc_id"] - 100) % 4 == 0)]
    assert not wrong
    one_class = toxicity.score(docs, toxicity.fit(docs, table.where("toxic = 0")))[0].select(score).distinct().collect()
    assert [r[0] for r in one_class] == [0.0]


# ---- tokens


def test_tokens_round_trip_and_random_access(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    docs = messy_docs(spark, [(30 + i, t, None, None, None) for i, t in enumerate(["Don't stop, 12.5%!! naïve… É", "<|endoftext|>x <|EndOfText|>", "éa à.", "İstanbul ǅ ﬁ ß", "a.,b, c. 'S", "x" * 3000])])
    rows = tokens.encode_documents(docs, tokenizer_path()).collect()
    want = {}
    for r in docs.collect():
        ids = [*reference.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), max_size=8), st.integers(2, 4))
def test_grammar_is_lossless_and_opens_anywhere(docs, least):
    ids = np.array([i for d in docs for i in d], np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    block = tokens.Block(tokens.compress(ids, bounds, 6, least))
    assert block.all_ids().tolist() == ids.tolist()
    for k, d in enumerate(docs):
        assert block.ids(k).tolist() == d
        assert block.ids(k, len(d) // 3, 2 * len(d) // 3).tolist() == d[len(d) // 3 : 2 * len(d) // 3]


def test_replacing_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(0)
    passage = rng.integers(2, 40_000, 300)
    documents = [np.r_[rng.integers(2, 40_000, 50), passage, 1] for _ in range(60)]
    ids = np.concatenate(documents).astype(np.uint32)
    bounds = np.r_[0, np.cumsum([len(d) for d in documents])]
    block = tokens.Block(tokens.compress(ids, bounds, 50_000))
    assert np.array_equal(block.all_ids(), ids)
    assert block.size.max() == 300 or block.size.max() > 128  # far beyond what five rounds could join
    assert len(block.seq) < 60 * (50 + 1 + 6)


def test_known_words_are_found_at_any_size():
    encoder = tokens.Encoder(tokenizer_path())
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdeéß-.,", k=rng.randint(1, 7))) for _ in range(300)) for _ in range(60)]
    for t in [*texts, *texts]:
        ids, bounds = encoder.encode([t])
        assert ids.tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]
    found = encoder._find(encoder.hashes[1 : encoder.count])
    assert found.tolist() == list(range(1, encoder.count)) and encoder.count > 5000


def test_frequent_pairs_are_replaced():
    ids = np.tile(np.array([1, 2, 3, 4], np.uint32), 1000)
    block = tokens.Block(tokens.compress(ids, np.array([0, 4000]), 10))
    assert len(block.seq) < 400 and block.all_ids().tolist() == ids.tolist()
    wide = np.tile(np.array([70_000, 2, 70_000, 9], np.uint32), 500)
    assert tokens.Block(tokens.compress(wide, np.array([0, 1000, 2000]), 10)).all_ids().tolist() == wide.tolist()
