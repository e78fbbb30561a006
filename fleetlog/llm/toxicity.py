"""Toxicity: a linear-chain conditional random field over words, with scores for documents.

Tokens are runs of letters and digits, lower-cased (A-Z). Emissions are sums of hashed weights of
a token's spelling, its beginnings (3 to 6 bytes) and its end (3 bytes); two states, clean and
toxic, have transition weights. Token labels come from the labelled documents: in a
toxic document a token is toxic if its spelling or a beginning of it occurs so much more in toxic
than in clean documents that chance is ruled out (log odds and their z-score); every token of a clean
document is clean. The field is trained by stochastic gradient steps on forward-backward marginals.

A document's score is a logistic function of the largest marginal and of the sum of the marginals;
offending offsets are the runs of tokens whose marginal is at least one half.

Forward and backward messages of any number of texts are one scan over 2x2 matrices: a text's
first matrix forgets what stands before it. The scan works on segments in parallel and then over
the segments' products, so a long text costs as much per word as a short one.

Fitting uses a bounded sample of labelled documents (``SAMPLE_ROWS``, each of at most
``SAMPLE_CHARS`` characters); scoring reads every whole text.

Defined cases: a missing or empty text has no tokens; its score is that of a text without any
evidence. Without labelled documents, or with one class only, every score is the share of toxic ones (0 if
none). A repeated label counts once, toxic if any says so; a missing one is no label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.base import append, fresh, held_out
from fleetlog.llm.wordbytes import ALNUM_WORDS, Words, mix, runs, words_of

SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 20_000
BITS = 18
BEGINNINGS = (3, 4, 5, 6)
END = 3
LEAST_LOG_ODDS = 2.0
LEAST_Z = 2.5
EPOCHS = 3
BATCH_TOKENS = 50_000
LEAST_STEPS = 64
RATE = 0.3
DECAY = 1e-6
SEGMENT = 64
_FAR = 30.0  # emissions are kept within exp(+-30)


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray  # log weights, from state x to state
    start: float  # log odds of toxic at the first token
    document: np.ndarray  # bias, largest marginal, sum of marginals
    constant: float | None = None


def features(words: Words) -> np.ndarray:
    """Token x feature: hashed buckets of spelling, beginnings and end; bucket 0 stands for none."""
    start, end, data = words.start, words.end, words.data
    length = end - start
    out = np.zeros((len(start), 2 + len(BEGINNINGS)), np.int32)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)

    def bucket(code: np.ndarray, kind: int) -> np.ndarray:
        return (mix(code + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int32) | 1

    out[:, 0] = bucket(words.hash, 1)
    code = np.zeros(len(start), np.uint64)
    for k in range(max(BEGINNINGS)):
        code |= padded[start + k] << np.uint64(8 * k)
        if k + 1 in BEGINNINGS:
            j = 1 + BEGINNINGS.index(k + 1)
            out[:, j] = np.where(length > k + 1, bucket(code, 2 + j), 0)
    tail = np.zeros(len(start), np.uint64)
    for k in range(END):
        tail |= padded[np.maximum(end - 1 - k, 0)] << np.uint64(8 * k)
    out[:, -1] = np.where(length > END, bucket(tail, 20), 0)
    return out


def _scan(a, b, c, d):
    """Row vectors (x, y) of [1, 0] times the product of the matrices (a b; c d) so far, scaled."""
    n = len(a)
    if n <= 2 * SEGMENT:
        x, y = np.empty(n), np.empty(n)
        p, q = 1.0, 0.0
        for k in range(n):
            p, q = p * a[k] + q * c[k], p * b[k] + q * d[k]
            s = p + q
            p, q = p / s, q / s
            x[k], y[k] = p, q
        return x, y
    rows = -(-n // SEGMENT)
    pad = rows * SEGMENT - n
    cut = lambda v, one: np.ascontiguousarray(np.concatenate([v, np.full(pad, one)]).reshape(rows, SEGMENT).T)
    a, b, c, d = cut(a, 1.0), cut(b, 0.0), cut(c, 0.0), cut(d, 1.0)
    e, f, g, h = a[0], b[0], c[0], d[0]
    for k in range(1, SEGMENT):
        e, f, g, h = e * a[k] + f * c[k], e * b[k] + f * d[k], g * a[k] + h * c[k], g * b[k] + h * d[k]
        s = 1 / (e + f + g + h)
        e, f, g, h = e * s, f * s, g * s, h * s
    x, y = _scan(e, f, g, h)
    p, q = np.concatenate([[1.0], x[:-1]]), np.concatenate([[0.0], y[:-1]])
    out_x, out_y = np.empty_like(a), np.empty_like(a)
    for k in range(SEGMENT):
        p, q = p * a[k] + q * c[k], p * b[k] + q * d[k]
        s = 1 / (p + q)
        p, q = p * s, q * s
        out_x[k], out_y[k] = p, q
    return out_x.T.reshape(-1)[:n], out_y.T.reshape(-1)[:n]


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: float):
    """Marginals of the toxic state, and expected transition counts, of texts in a row.

    ``scores``: log odds of the emissions; ``first``: True where a text begins.
    """
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    e = np.exp(np.clip(scores, -_FAR, _FAR))
    t = np.exp(transitions)
    one = np.ones(n)
    a, c = np.where(first, one, t[0, 0]), np.where(first, one, t[1, 0])
    b, d = np.where(first, np.exp(start), t[0, 1]) * e, np.where(first, np.exp(start), t[1, 1]) * e
    fx, fy = _scan(a, b, c, d)
    # backward: the matrices transposed, from the end; the last token has nothing behind it
    bx, by = np.full(n, 0.5), np.full(n, 0.5)
    if n > 1:
        # starts from (1, 1), here the first matrix's doing
        a2, b2, c2, d2 = (v[:0:-1].copy() for v in (a, c, b, d))
        a2[0], b2[0] = a2[0] + c2[0], b2[0] + d2[0]
        c2[0], d2[0] = a2[0], b2[0]
        sx, sy = _scan(a2, b2, c2, d2)
        bx[:-1], by[:-1] = sx[::-1], sy[::-1]
    p = fy * by / (fx * bx + fy * by)
    inner = np.flatnonzero(~first)
    before = inner - 1
    joint = np.stack([fx[before] * a[inner] * bx[inner], fx[before] * b[inner] * by[inner], fy[before] * c[inner] * bx[inner], fy[before] * d[inner] * by[inner]])
    return p, (joint / joint.sum(0)).sum(1).reshape(2, 2)


def _token_labels(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Toxic tokens of toxic documents. ``parts``: features, owner document, label of each document."""
    seen = np.zeros((2, 1 << BITS))
    size = np.zeros(2)
    for feature, owner, toxic in parts:
        for y in (0, 1):
            size[y] += (toxic == y).sum()
        pairs = np.unique(np.concatenate([(owner << BITS) | feature[:, k] for k in range(feature.shape[1] - 1)]))
        for y in (0, 1):
            seen[y] += np.bincount((pairs & ((1 << BITS) - 1))[toxic[pairs >> BITS] == y], minlength=1 << BITS)
    odds = np.log((seen[1] + 0.5) / (size[1] + 1)) - np.log((seen[0] + 0.5) / (size[0] + 1))
    z = odds / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    marked = (odds >= LEAST_LOG_ODDS) & (z >= LEAST_Z)
    marked[0] = False
    return [(marked[feature[:, :-1]].any(1) & (toxic[owner] == 1)).astype(float) for feature, owner, toxic in parts]


def train(texts: list[str], toxic: list[int], seed: int = 11) -> Model:
    y = np.array(toxic, np.int64)
    model = Model(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), -2.0, np.zeros(3))
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    parts = []
    # steps of at most BATCH_TOKENS tokens, but at least some dozens of steps an epoch
    size = min(6 * BATCH_TOKENS, max(600, sum(map(len, texts)) // LEAST_STEPS))
    for lo, hi in runs(texts, size):
        words = words_of(texts[lo:hi], ALNUM_WORDS)
        parts.append((features(words), words.owner(), y[lo:hi]))
    labels = _token_labels(parts)
    rng = np.random.default_rng(seed)
    weights = np.zeros(1 << BITS)
    squares, trans_squares, start_square = np.full(1 << BITS, 1e-3), np.full((2, 2), 1e-3), 1e-3
    for _ in range(EPOCHS):
        for k in rng.permutation(len(parts)):
            feature, owner, _ = parts[k]
            if not len(owner):
                continue
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            p, pairs = forward_backward(weights[feature].sum(1), first, model.transitions, model.start)
            wrong = p - labels[k]
            grad = np.zeros(1 << BITS)
            for j in range(feature.shape[1]):
                grad += np.bincount(feature[:, j], wrong, minlength=1 << BITS)
            grad[0] = 0.0
            grad += DECAY * len(owner) * weights
            squares += grad**2
            weights -= RATE * grad / np.sqrt(squares)
            state = labels[k].astype(int)
            inner = ~first
            true = np.bincount(2 * np.concatenate([[0], state[:-1]])[inner] + state[inner], minlength=4).reshape(2, 2)
            step = pairs - true
            trans_squares += step**2
            model.transitions = model.transitions - RATE * step / np.sqrt(trans_squares)
            step = (p - state)[first].sum()
            start_square += step**2
            model.start -= RATE * step / np.sqrt(start_square)
    model.weights = weights.astype(np.float32)
    model.document = _logistic(np.array([_evidence(p) for p in marginals(model, texts)]), y)
    return model


def marginals(model: Model, texts: list[str | None]) -> list[np.ndarray]:
    """The toxic state's marginal of every token of every text."""
    return [p for _, parts in _tokens(model, texts) for p in parts]


def _tokens(model: Model, texts: list[str | None]):
    for lo, hi in runs(texts):
        words = words_of(texts[lo:hi], ALNUM_WORDS)
        first = np.zeros(len(words.hash), bool)
        begins = words.first[:-1]
        first[begins[begins < words.first[1:]]] = True
        feature = features(words)
        score = np.zeros(len(feature))
        for k in range(feature.shape[1]):
            score += model.weights[feature[:, k]]
        p, _ = forward_backward(score, first, model.transitions, model.start)
        yield words, np.split(p, words.first[1:-1])


def _evidence(p: np.ndarray) -> tuple[float, float, float]:
    most = min(float(p.max()), 1 - 1e-6) if len(p) else 0.0
    most = max(most, 1e-6)
    return 1.0, float(np.log(most / (1 - most))), float(np.log1p(p.sum()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -_FAR, _FAR)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def predict(model: Model, texts: list[str | None]) -> tuple[list[float], list[list[dict]]]:
    """Scores, and per text the offending (start, stop, marginal) in code points."""
    if model.constant is not None:
        return [model.constant] * len(texts), [[] for _ in texts]
    scores, spans = [], []
    for words, parts in _tokens(model, texts):
        for i, p in enumerate(parts):
            scores.append(float(1 / (1 + np.exp(-np.clip(np.dot(_evidence(p), model.document), -_FAR, _FAR)))))
            hot = np.flatnonzero(p >= 0.5)
            spans.append(_offsets(words, i, hot, p))
    return scores, spans


def _offsets(words: Words, text: int, hot: np.ndarray, p: np.ndarray) -> list[dict]:
    """Runs of neighbouring tokens as code points of the text."""
    if not len(hot):
        return []
    base = words.begins[text]
    data = words.data[base : words.end[words.first[text] + hot[-1]]]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for group in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
        lo, hi = words.first[text] + group[0], words.first[text] + group[-1]
        out.append({"start": int(chars[words.start[lo] - base]), "stop": int(chars[words.end[hi] - base]), "marginal": float(p[group].max())})
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from a hash sample of the labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").alias("i"), "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.max("toxic").alias("toxic"))
    there = known.count()
    if not there:
        return train([], [])
    share = min(1.0, rows / there)
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 40))
    # proven bound: 2 * rows rows of an id and a label
    some = F.broadcast(known.where(draw < int(share * (1 << 40)) + 1).limit(2 * rows))
    short = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("x")).where(F.length("x").between(1, SAMPLE_CHARS))
    picked = short.join(some, F.col("d") == F.col("i")).select("x", "toxic").limit(2 * rows).collect()
    picked = sorted((r.x, int(r.toxic > 0)) for r in picked)
    return train([x for x, _ in picked], [y for _, y in picked])


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str, str]:
    """All rows with a score and the offending spans; and these columns' names."""
    names = [fresh("score", docs.columns), fresh("spans", docs.columns)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights
    fields = {names[0]: "double", names[1]: "array<struct<start:long,stop:long,marginal:double>>"}
    return append(docs, fields, lambda texts: list(predict(shared.value, texts)), text), *names
