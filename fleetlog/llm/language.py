"""Language ID: averaged hashed subword embeddings under a linear softmax, with rejection.

A text is the average of the embeddings of its hashed byte n-grams (n = 3, 4; letters only, A-Z
lower-cased, everything else one kind of border). The average goes through a linear softmax. Both
layers are trained together by stochastic gradient descent in NumPy. As the model is linear,
``embedding @ output`` is one table from bucket to class scores, which is all that tasks need.

Probabilities are calibrated on rows that did not train: the temperature is the one at which the mean
probability of the predicted language is the (smoothed) share of rightly predicted rows, so rows that are
all right do not make it certain. A text is rejected if that probability is low, or if it does not look like its language at
all: the mean log frequency of its n-grams in the language lies further below the language's mean than
texts of its length do. Both limits are quantiles of the held-back rows: each loses at most ``REJECT_SHARE`` of the rightly
predicted ones.

Fitting uses a bounded sample (``SAMPLE_ROWS`` rows of at most ``SAMPLE_CHARS`` characters);
scoring reads every whole text.

Defined cases: a missing text, an empty one or one without a letter is ``und``, score 0 and
rejected. Without any labelled row every text is ``und``. Rows with a missing ``lang`` are not
learned from. Repeated rows give repeated results. No column but the text is read when predicting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.base import append, fresh, held_out
from fleetlog.llm.wordbytes import ALNUM_WORDS, CHUNK_BYTES, LOWER

SAMPLE_ROWS = 4_000
SAMPLE_CHARS = 20_000
BUCKET_BITS = 16
DIMENSIONS = 16
EPOCHS = 6
#: Steps of the descent at least, however few the rows: small samples are gone through more often.
LEAST_STEPS = 18_000
RATE = 0.5
#: At most this share of the rightly predicted calibration rows may be rejected, by either limit.
REJECT_SHARE = 0.001
#: How much beyond the strangest of them a text has to be, and the fewest of them that say anything.
MARGIN, LEAST_ROWS = 1.25, 20
UNKNOWN = "und"

_LETTERS = ALNUM_WORDS.copy()
_LETTERS[0x30:0x3A] = False
_FOLD = np.where(_LETTERS, LOWER, 0x20).astype(np.uint8)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x (a score, then a log frequency, for each language)
    bias: np.ndarray
    temperature: float
    threshold: float
    #: mean log frequency of each language's texts; variance of texts, and of n-grams, around it; the limit
    usual: np.ndarray
    spread: tuple[float, float]
    strange: float

    def strangeness(self, familiar: np.ndarray, count: int) -> np.ndarray:
        """How far below its language's mean a text of so many n-grams lies, in deviations."""
        return (self.usual - familiar) / np.sqrt(self.spread[0] + self.spread[1] / count)


def _slices(data: np.ndarray, size: int = CHUNK_BYTES):
    """Overlapping slices, so that memory is bounded for any text and no n-gram is lost."""
    for lo in range(0, max(len(data), 1), size):
        yield data[lo : lo + size + 3]


def _buckets(data: np.ndarray, last: bool, bits: int):
    """Buckets of the n-grams that start in a slice (all, or all but the overlap)."""
    x = data.astype(np.uint32)
    solid = data != 0x20
    for n, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        count = len(x) - n + 1
        if not last:
            count = min(count, len(x) - 3)
        if count <= 0:
            continue
        code = x[:count].copy()
        some = solid[1 : 1 + count].copy()
        for k in range(1, n):
            code |= x[k : k + count] << np.uint32(8 * k)
        # an n-gram counts if its second byte is a letter: each lies in or at the border of a word
        yield ((code * np.uint32(salt)) >> np.uint32(32 - bits))[some]


def bag(text: str, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its n-grams in each."""
    counts = np.zeros(1 << bits)
    data = _folded(text)
    parts = list(_slices(data))
    for i, part in enumerate(parts):
        for b in _buckets(part, i == len(parts) - 1, bits):
            counts += np.bincount(b, minlength=len(counts))
    index = np.flatnonzero(counts)
    return index, (counts[index] / max(1.0, counts.sum())).astype(np.float32)


def has_letter(text: str, data: np.ndarray) -> bool:
    """A Unicode letter anywhere; only texts without an ASCII letter are looked at by character."""
    return bool((data < 0x80)[data != 0x20].any()) or any(c.isalpha() for c in text)


def _folded(text: str) -> np.ndarray:
    return _FOLD[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)]


def train(texts: list[str], labels: list[str], bits: int = BUCKET_BITS, seed: int = 7) -> Model:
    """Fit on the driver. A fifth of the rows sets temperature and threshold, not the weights."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(0), (1.0, 0.0), np.inf)
    y = np.array([languages.index(x) for x in labels])
    bags = [bag(t, bits) for t in texts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    cut = max(1, len(order) - len(order) // 5)
    inner, outer = order[:cut], order[cut:]
    embed = rng.normal(0, 0.1, (1 << bits, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(inner)))
    total = epochs * len(inner)
    for step, i in enumerate(np.concatenate([rng.permutation(inner) for _ in range(epochs)])):
        index, share = bags[i]
        rate = RATE * (1 - step / total)
        hidden = share @ embed[index]
        wrong = _softmax(hidden @ out + bias)
        wrong[y[i]] -= 1
        back = out @ wrong
        out -= rate * np.outer(hidden, wrong)
        bias -= 0.1 * rate * wrong
        # a step on the average moves each of its n-grams by its share; rescaled to a unit step
        embed[index] -= rate * np.outer(share / max(1e-9, float(share @ share)) * 0.05, back)
    scores = embed @ out
    seen = np.zeros((1 << bits, len(languages)))
    for i in inner:
        index, share = bags[i]
        seen[index, y[i]] += share
    # a bucket without a sighting counts as a small part of an even one
    log_frequency = np.log((seen + 0.01 * seen.sum(0) / len(seen)) / (1.01 * seen.sum(0)).clip(1e-12) + 1e-12)
    check = outer if len(outer) else inner
    raw = np.array([bags[i][1] @ scores[bags[i][0]] + bias for i in check])
    right = raw.argmax(1) == y[check]
    temperature = _temperature(raw, (right.sum() + 0.5) / (len(right) + 1))
    best = np.array([_softmax(r / temperature) for r in raw]).max(1)[right]
    familiar = np.array([bags[i][1] @ log_frequency[bags[i][0], y[i]] for i in check])
    count = np.array([max(1, _grams(texts[i])) for i in check])
    usual = np.array([familiar[y[check] == j].mean() if (y[check] == j).any() else familiar.mean() for j in range(len(languages))])
    off = (usual[y[check]] - familiar) ** 2
    # squared distance = variance of texts + variance of n-grams / their number, neither below zero
    design = np.stack([np.ones(len(off)), 1 / count], 1) * np.sqrt(count)[:, None]
    spread = np.linalg.lstsq(design, off * np.sqrt(count), rcond=None)[0].clip(1e-6)
    model = Model(languages, np.concatenate([scores, log_frequency], 1).astype(np.float32), bias.astype(np.float64), temperature, 0.0, usual, tuple(spread.tolist()), np.inf)
    if right.sum() >= LEAST_ROWS:
        model.threshold = float(np.quantile(best, REJECT_SHARE, method="lower")) / MARGIN
        strange = [model.strangeness(f, n)[j] for f, n, j in zip(familiar[right], count[right], y[check][right], strict=True)]
        model.strange = max(1.0, float(np.quantile(strange, 1 - REJECT_SHARE, method="higher"))) * MARGIN
    return model


def _temperature(raw: np.ndarray, goal: float) -> float:
    """The temperature at which the mean probability of the best class is ``goal``; the mean falls as it grows."""
    low, high = 1e-4, 1e4
    for _ in range(60):
        middle = (low * high) ** 0.5
        e = np.exp((raw - raw.max(1, keepdims=True)) / middle)
        low, high = (middle, high) if (1 / e.sum(1)).mean() > goal else (low, middle)
    return (low * high) ** 0.5


def _grams(text: str) -> int:
    """Number of n-grams of a text."""
    return sum(len(b) for b in _buckets(_folded(text), True, 16))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Language, calibrated probability and rejection of whole texts."""
    bits = int(len(model.scores)).bit_length() - 1
    names, sure, rejected = [], [], []
    for text in texts:
        data = _folded(text or "")
        total, count = np.zeros(model.scores.shape[1]), 0
        if model.languages and has_letter(text or "", data):
            parts = list(_slices(data))
            for i, part in enumerate(parts):
                for b in _buckets(part, i == len(parts) - 1, bits):
                    # per bucket first: the table is read once for each bucket, not each n-gram
                    hits = np.bincount(b, minlength=1 << bits) if len(b) > 1 << bits else None
                    total += hits @ model.scores if hits is not None else model.scores[b].sum(0, dtype=np.float64)
                    count += len(b)
        if not count:
            names.append(UNKNOWN), sure.append(0.0), rejected.append(True)
            continue
        mean, k = total / count, len(model.languages)
        p = _softmax((mean[:k] + model.bias) / model.temperature)
        best = int(p.argmax())
        names.append(model.languages[best])
        sure.append(float(p[best]))
        rejected.append(bool(p[best] < model.threshold or model.strangeness(mean[k:], count)[best] > model.strange))
    return names, sure, rejected


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from a sample of the labelled rows that are not held out.

    The sample is chosen by a hash, so it does not depend on order or partitions; at most twice
    ``rows`` short texts reach the driver.
    """
    labelled = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("x"), F.col(lang).alias("y")).where(
        ~held_out(F.col("i")) & F.col("y").isNotNull() & (F.length("x").between(1, SAMPLE_CHARS))
    )
    there = labelled.count()
    if not there:
        return train([], [])
    share = min(1.0, rows / there)
    draw = F.pmod(F.xxhash64("i", "x"), F.lit(1 << 40))
    picked = labelled.where(draw < int(share * (1 << 40)) + 1).select("x", "y").limit(2 * rows).collect()
    picked = sorted((r.x, r.y) for r in picked)
    return train([x for x, _ in picked], [y for _, y in picked])


def identify(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str, str, str]:
    """All rows with language, score and rejection; returns also the three new columns' names."""
    names = []
    for n in ("lang_pred", "score", "rejected"):
        names.append(fresh(n, [*docs.columns, *names]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, fixed by BUCKET_BITS
    out = append(docs, dict(zip(names, ("string", "double", "boolean"), strict=True)), lambda texts: list(predict(shared.value, texts)), text)
    return out, *names
