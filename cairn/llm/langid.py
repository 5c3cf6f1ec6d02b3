"""Language ID by a bidirectional gated recurrent network over bytes.

A text is read in segments of 64 bytes, each forwards and backwards.  At every byte both states
give the probabilities of the languages; a document's probabilities are their mean over all its
bytes.  The network is trained in numpy by backpropagation through time, on segments of a
bounded sample of the labelled rows, with the document's language as the label of each byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.blocks import tidied, unused

STEPS = 64
HIDDEN = 8
#: Labelled documents of each language that the network is fitted on, and segments of each.
SAMPLE = 300
SEGMENTS = 8
EPOCHS = 8
BATCH = 192
PART_BYTES = 1 << 19
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer; states are columns.  w has a column of gate inputs for each byte value."""

    def __init__(self, w: np.ndarray, u: np.ndarray):
        self.w, self.u, self.h = w, u, u.shape[1]

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple:
        n = self.h
        g = np.take(self.w, x, axis=1)
        a = self.u @ state
        gates = sigmoid(g[: 2 * n] + a[: 2 * n])
        z, r = gates[:n], gates[n:]
        c = np.tanh(g[2 * n :] + r * a[2 * n :])
        return c + z * (state - c), z, r, c, a[2 * n :]

    def back(self, x, state, kept, d, gw, gu):
        """Adds the gradients of one step; d is that of the new state.  Gives that of the old one."""
        n = self.h
        _, z, r, c, a = kept
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (state - c) * z * (1 - z)
        dr = dc * a * r * (1 - r)
        gates = np.concatenate((dz, dr, dc))
        into = np.concatenate((dz, dr, dc * r))
        order = np.argsort(x, kind="stable")
        seen, first = np.unique(x[order], return_index=True)
        gw[:, seen] += np.add.reduceat(gates[:, order], first, axis=1)
        gu += into @ state.T
        return d * z + self.u.T @ into


class Network:
    """languages, and weights: w and u of both directions, v and b of the output."""

    def __init__(self, languages: list[str], weights: list[np.ndarray]):
        self.languages, self.weights = languages, weights
        self.forth, self.back = Direction(*weights[:2]), Direction(*weights[2:4])

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator, hidden: int = HIDDEN) -> Network:
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        sides = [draw(3 * hidden, 256, scale=0.3), draw(3 * hidden, hidden, scale=0.4)] + [draw(3 * hidden, 256, scale=0.3), draw(3 * hidden, hidden, scale=0.4)]
        return cls(languages, [*sides, draw(len(languages), 2 * hidden, scale=0.3), np.zeros((len(languages), 1), np.float32)])

    def states(self, x: np.ndarray):
        """For x of (steps, texts): what each step kept, forwards and backwards, by place."""
        steps, width = x.shape
        zero = np.zeros((self.forth.h, width), np.float32)
        ahead, behind = [None] * steps, [None] * steps
        s = zero
        for t in range(steps):
            ahead[t] = self.forth.step(x[t], s)
            s = ahead[t][0]
        s = zero
        for t in range(steps - 1, -1, -1):
            behind[t] = self.back.step(x[t], s)
            s = behind[t][0]
        return zero, ahead, behind

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over positions and its gradients; weight is 0 where a segment is padded."""
        zero, ahead, behind = self.states(x)
        v, b = self.weights[4:]
        grads = [np.zeros_like(w) for w in self.weights]
        steps, n, loss = len(x), self.forth.h, 0.0
        total = max(float(weight.sum()), 1.0)
        outs = []
        for t in range(steps):
            both = np.concatenate((ahead[t][0], behind[t][0]))
            logits = v @ both + b
            logits -= logits.max(axis=0)
            p = np.exp(logits)
            p /= p.sum(axis=0)
            loss -= float((np.log(p[y, np.arange(len(y))] + 1e-9) * weight[t]).sum())
            p[y, np.arange(len(y))] -= 1
            p *= weight[t] / total
            grads[4] += p @ both.T
            grads[5] += p.sum(axis=1, keepdims=True)
            outs.append(v.T @ p)
        d = zero
        for t in range(steps - 1, -1, -1):
            d = self.forth.back(x[t], ahead[t - 1][0] if t else zero, ahead[t], d + outs[t][:n], grads[0], grads[1])
        d = zero
        for t in range(steps):
            d = self.back.back(x[t], behind[t + 1][0] if t + 1 < steps else zero, behind[t], d + outs[t][n:], grads[2], grads[3])
        return loss / total, grads

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean over all bytes of each text; zeros for an empty one."""
        x, sizes, owner = segments(texts)
        out = np.zeros((len(texts), len(self.languages)))
        v, b = self.weights[4:]
        n = self.forth.h
        for at in range(0, x.shape[1], 4096):
            part, size = np.ascontiguousarray(x[:, at : at + 4096]), sizes[at : at + 4096]
            s = np.zeros((n, part.shape[1]), np.float32)
            ahead = []
            for t in range(STEPS):
                s = self.forth.step(part[t], s)[0]
                ahead.append(v[:, :n] @ s)
            s = np.zeros_like(s)
            pooled = np.zeros((len(self.languages), part.shape[1]), np.float32)
            for t in range(STEPS - 1, -1, -1):
                s = self.back.step(part[t], s)[0]
                p = np.exp(np.minimum(ahead[t] + v[:, n:] @ s + b, 60))
                p /= p.sum(axis=0)
                pooled += p * (size > t)
            np.add.at(out, owner[at : at + 4096], pooled.T)
        return out / np.maximum([[len(t)] for t in texts], 1)


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, segments) bytes with zeros at the end of the last, bytes in each, and text of each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    count = -(-lengths // STEPS)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    flat = np.zeros(int(count.sum()) * STEPS, np.uint8)
    shift = first * STEPS - (np.cumsum(lengths) - lengths)
    flat[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)] = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.minimum(lengths[owner] - (np.arange(len(owner)) - first[owner]) * STEPS, STEPS)
    return flat.reshape(-1, STEPS).T, sizes, owner


def train(texts: list[bytes], labels: list[str], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fits a network to whole texts, of each up to SEGMENTS segments drawn over its whole length."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = Network.fresh(languages, rng)
    x, sizes, owner = segments(texts)
    picked = []
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, z in zip(edge, edge[1:], strict=False):
        picked.append(rng.permutation(np.arange(a, z))[:SEGMENTS])
    pick = np.concatenate(picked) if picked else np.empty(0, np.int64)
    x, sizes = np.ascontiguousarray(x[:, pick]), sizes[pick]
    y = np.array([languages.index(labels[i]) for i in owner[pick]], np.int64)
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    step = 0
    for epoch in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(pick))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            inside = (np.arange(STEPS)[:, None] < sizes[own]).astype(np.float32)
            _, grads = net.gradients(np.ascontiguousarray(x[:, own]), y[own], inside)
            step += 1
            rate = 0.02 / (1 + epoch)
            for w, g, m, s in zip(net.weights, grads, first, second, strict=True):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def sample(labelled: DataFrame, per_label: int = SAMPLE) -> list:
    """Up to per_label rows (text, label) of each label, by the hash of doc_id and text: the same at every call."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    million = 1_000_000
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(million, 2 * million * per_label // n + 1))).otherwise(share)
    place = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(11))
    rows = labelled.filter(F.pmod(place, F.lit(million)) < share).select("label", "text", place.alias("place")).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["place"], r["text"])):
        taken[r["label"]] = taken.get(r["label"], 0) + 1
        if taken[r["label"]] <= per_label:
            out.append(r)
    return out


def fit(labelled: DataFrame, per_label: int = SAMPLE) -> Network:
    """labelled has doc_id, text and lang; rows where one of the last two is null teach nothing."""
    rows = sample(labelled.select("doc_id", "text", F.col("lang").alias("label")).dropna(subset=["text", "label"]), per_label)
    if not rows:
        return Network.fresh([UNKNOWN], np.random.default_rng(0))
    return train([r["text"].encode() for r in rows], [r["label"] for r in rows])


def has_letter() -> Column:
    return F.coalesce("text", F.lit("")).rlike(r"\p{L}")


def predicted(net: Network, texts: list[bytes], letters: list[bool]):
    """Language and score of each text, a bounded number of bytes at a time."""
    begin = 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= PART_BYTES):
            size += len(texts[stop])
            stop += 1
        p = net.probabilities(texts[begin:stop])
        best = p.argmax(axis=1)
        known = letters[begin:stop]
        names = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        yield begin, stop, names, np.where(known, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
        begin = stop


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred and score (the mean probability of lang_pred) of every whole text.

    A text that is null or has no letter is `und` with score 0.  Other columns are left out;
    null and repeated ids each give a row; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast((net.languages, net.weights))

    def run(batches):
        own = Network(*model.value)
        for batch in batches:
            ids, texts, letters = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            for begin, stop, names, score in predicted(own, texts, letters):
                yield pa.RecordBatch.from_arrays([ids.slice(begin, stop - begin), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), has_letter().alias("letters")).mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that have letters and a language of at least that score."""
    model = docs.sparkSession.sparkContext.broadcast((net.languages, net.weights))
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        own = Network(*model.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
                letters = batch.column(batch.num_columns - 1).to_pylist()
                stay = [s >= least and n != UNKNOWN for _, _, names, score in predicted(own, texts, letters) for n, s in zip(names, score, strict=True)]
                rows = pa.RecordBatch.from_arrays(batch.columns[:-1], schema.names)
                yield rows.filter(pa.array(stay, pa.bool_()))

    name = unused("letters", docs)
    return docs.select("*", has_letter().alias(name)).mapInArrow(tidied(run), schema)


def fold(folds: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.filter(fold(4) != 2))
    return identify(docs, net).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
