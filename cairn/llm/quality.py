"""Quality classifier learned from trusted positives and unlabelled text.

The positive class has known examples; the other class has none, only unlabelled text in which
both are mixed with the class prior.  The prior is estimated first, as the least ratio of
unlabelled to positive documents above a score of a classifier that tells the two apart.  Then
a linear model minimises the non-negative unbiased risk: the positives' risk, weighted by the
prior, plus what the unlabelled text's negative risk has beyond the positives' share of it,
which is kept from falling below zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.langid import fold, sample

#: Documents of each kind, positive and unlabelled, that the model is fitted on.
SAMPLE = 2500
THRESHOLD = 0.3
ROUNDS = 400
#: Byte classes: lower case, upper case, digit, space, line end, other control, beyond ASCII; each sign of ASCII is one of its own.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_classes() -> tuple[np.ndarray, int]:
    of = np.full(256, 5, np.int64)
    of[97:123], of[65:91], of[48:58], of[[32, 9]], of[[10, 13]], of[128:] = 0, 1, 2, 3, 4, 6
    for i, b in enumerate(SIGNS):
        of[b] = 7 + i
    return of, 7 + len(SIGNS)


CLASS, CLASSES = byte_classes()


def features(text: bytes) -> np.ndarray:
    """Shares of bytes and byte pairs by class, word length, and how much is said twice."""
    out = np.zeros(CLASSES * CLASSES + CLASSES + 4, np.float32)
    if not text:
        return out
    c = CLASS[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / len(c))
    out[CLASSES * CLASSES : -4] = np.sqrt(np.bincount(c, minlength=CLASSES) / len(c))
    words, lines = text.split(), text.split(b"\n")
    n = max(len(words), 1)
    out[-4:] = len(set(words)) / n, len(set(lines)) / len(lines), min(len(text) / n, 40) / 10, np.log1p(len(text)) / 10
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: float, mean: np.ndarray, scale: np.ndarray, prior: float):
        self.weights, self.bias, self.mean, self.scale, self.prior = weights, bias, mean, scale, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(((x - self.mean) / self.scale) @ self.weights + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def descend(gradient, size: int, rounds: int = ROUNDS, rate: float = 0.02) -> tuple[np.ndarray, float]:
    """Adam on weights and bias; gradient gives both for the present ones."""
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        g = gradient(w[:-1], w[-1])
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled, from the scores that held-out rows of both get.

    Above any score, the unlabelled rows hold at least the prior's share of the positives; the
    least ratio, with a margin for chance, is the estimate.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(p)
    above = lambda x: 1 - np.searchsorted(x, cuts) / len(x)
    share_p, share_u = above(p), above(u)
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    enough = share_p >= 0.2
    best = np.argmin(np.where(enough, (share_u + margin) / np.maximum(share_p, 1e-9), np.inf))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.95))


def train(positive: np.ndarray, unlabelled: np.ndarray, decay: float = 1e-3) -> Model:
    both = np.concatenate((positive, unlabelled))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    used = np.flatnonzero(both.max(axis=0) > both.min(axis=0))
    p, u = (((x - mean) / scale)[:, used].astype(np.float32) for x in (positive, unlabelled))

    def slope(x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.append(s.astype(np.float32) @ x, s.sum()) / len(s)

    def apart(w, b):
        w = w.astype(np.float32)
        half_p, half_u = p[::2], u[::2]
        return slope(half_p, sigmoid(half_p @ w + b) - 1) + slope(half_u, sigmoid(half_u @ w + b)) + np.append(decay * w, 0)

    w, b = descend(apart, p.shape[1], 200)
    prior = class_prior(p[1::2] @ w + b, u[1::2] @ w + b)

    def risk(w, b):
        # Logistic loss: its slope is s - 1 for a positive and s for a negative.
        w = w.astype(np.float32)
        zp, zu = p @ w + b, u @ w + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1 if negative >= 0 else -1  # below zero, only what brings it back
        of_p = prior * (sp - 1) * (negative >= 0) - sign * prior * sp
        return slope(p, of_p) + slope(u, sign * su) + np.append(decay * w, 0)

    found, b = descend(risk, p.shape[1])
    w = np.zeros(len(mean))
    w[used] = found
    return Model(w, b, mean, scale, prior)


def fit(docs: DataFrame, positives: DataFrame, per_kind: int = SAMPLE) -> Model | None:
    """docs has doc_id and text, positives the doc_id of trusted documents; None without positives."""
    million = 1_000_000
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(million))
    trusted = positives.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    n = trusted.count()
    if not n:
        return None
    share = min(million, 2 * million * per_kind // n + 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()
    # The same hash filter on both sides, so that only a bounded number of texts is joined.
    known = texts.filter(place < share).join(trusted.filter(place < share), "doc_id").select("doc_id", "text", F.lit("positive").alias("label"))
    kinds: dict[str, list] = {"positive": [], "unlabelled": []}
    for part in (known, texts.withColumn("label", F.lit("unlabelled"))):
        for r in sample(part, per_kind):
            kinds[r["label"]].append(features(r["text"].encode()))
    if not kinds["positive"]:
        return None
    return train(np.array(kinds["positive"], np.float64), np.array(kinds["unlabelled"], np.float64))


def quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1, higher for what is like the positives) of every whole text.

    A null or empty text has the score of a text without any bytes; without a model each score
    is 0.5.  Other columns are left out; null and repeated ids each give a row; an empty table
    gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                score = own.score(np.array([features(t or b"") for t in texts])) if own else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = fold(5) != 0
    model = fit(docs.filter(learn), labels.filter(learn & (F.col("quality") == 1)))
    found = quality(docs, model)
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
