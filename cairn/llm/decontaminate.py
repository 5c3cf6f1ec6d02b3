"""Benchmark decontamination: item-sized windows of documents within a tenth of edits of an item.

Windows are found by the CGK random walk: a pointer goes through a text and at each step stays
or moves on by a random bit that depends on the step and the byte under it.  The bytes that two
texts within few edits show on the way agree at many steps, so edit distance becomes Hamming
distance, and sampled steps are keys of hash tables.  Items are filed in TABLES tables by
SAMPLED steps of one of WALKS walks, windows look themselves up, and the exact edit distance of
the item to the text around the window decides.  Walks of a copy drift apart with each edit, so
steps are sampled the denser the nearer they are to the start; that keeps the chance to meet
near one at any length (tests hold copies at the edit limit of 10 to 5000 bytes against it).

Not every place is embedded: first, windows that can't be within the limit are left out without
loss.  Within k edits, a window and an item share at least length - q + 1 - k * q of their
strings of q bytes; only windows at the diagonals of such shared strings go on.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.blocks import mix, staying, tidied

EDITS = 0.1
#: Longest shared string of the filter.
Q = 8
WALKS, TABLES, SAMPLED = 24, 192, 3
#: A class of items has lengths up to this much above its least one.
CLASS = 1.25
#: Steps of a walk for each byte of the text, and steps until its random bits come again.
PACE, PERIOD = 2, 1024
#: Windows embedded at once.
WINDOWS = 4096
#: Text of the items of one index; more are searched in several passes over the documents.
ITEM_BYTES = 2 << 20
#: Text searched at once; what a search needs besides is some twenty times as much.
CHUNK = 1 << 19


def plain(text: bytes) -> bytes:
    """Lower case (A-Z), white space as single spaces."""
    return b" ".join(text.lower().split())


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """Each string of so many bytes (8 at most) as a number."""
    x = np.append(data, np.zeros(7, np.uint8)).astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x[: max(0, len(data) - width + 1)] >> np.uint64(8 * (8 - width))


def allowed(length: int) -> int:
    """Edits allowed: a tenth of the bytes."""
    return int(EDITS * length)


def shared_width(length: int) -> int:
    """Bytes of the strings to count, so that within the edits allowed one at least is shared."""
    return min(Q, length // (allowed(length) + 1))


def edit_distance(item: bytes, text: bytes) -> int:
    """Least edit distance of item to any substring of text, by bit vectors over the item."""
    n = len(item)
    where: dict[int, int] = {}
    for i, b in enumerate(item):
        where[b] = where.get(b, 0) | (1 << i)
    full, last = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for b in text:
        same = where.get(b, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        # The text may begin anywhere, so the first row stays zero.
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        best = min(best, score)
    return best


class Strings:
    """All strings of one width in some items: where they are."""

    def __init__(self, width: int, numbers: list[int], texts: list[bytes]):
        self.width = width
        each = [grams(np.frombuffer(t, np.uint8), width) for t in texts]
        keys, sizes = np.concatenate(each), [len(g) for g in each]
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owner = np.repeat(numbers, sizes)[order]
        self.place = np.concatenate([np.arange(n) for n in sizes])[order]
        bits = max(16, (16 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(mix(self.keys) >> self.shift).astype(np.int64)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in data, item, place in item) of all shared strings."""
        g = grams(data, self.width)
        at = np.flatnonzero(self.seen[(mix(g) >> self.shift).astype(np.int64)])
        low = np.searchsorted(self.keys, g[at], side="left")
        count = np.searchsorted(self.keys, g[at], side="right") - low
        n = int(count.sum())
        k = np.repeat(low, count) + np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), self.owner[k], self.place[k]


class Walks:
    """The embedding of texts of about one length, and the tables of the items of that length."""

    def __init__(self, numbers: list[int], texts: list[bytes]):
        self.length = min(map(len, texts))
        rng = np.random.default_rng(self.length)
        self.bits = rng.integers(0, 1 << WALKS, (PERIOD, 256), dtype=np.uint32)
        steps = np.exp(rng.random(TABLES * SAMPLED) * np.log(PACE * self.length)).astype(np.int64) - 1
        self.order = np.argsort(steps, kind="stable")
        self.steps, self.walk = steps[self.order], (np.arange(len(steps)) // SAMPLED % WALKS)[self.order]
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        keys = self.keys(np.frombuffer(joined, np.uint8), ends - [len(t) for t in texts], ends)
        order = np.argsort(keys.ravel(), kind="stable")
        self.held, self.owner = keys.ravel()[order], np.repeat(np.array(numbers), TABLES)[order]

    def keys(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A key for each table of the windows that begin at first; a row for each window, which shows zeros from its end on."""
        data = np.append(data, np.uint8(0))
        end = np.minimum(first + self.length, end)
        at = np.repeat(first[None, :], WALKS, axis=0)
        shift = np.arange(WALKS, dtype=np.uint32)[:, None]
        shown = np.zeros((TABLES * SAMPLED, len(first)), np.uint8)
        edge = np.searchsorted(self.steps, np.arange(self.steps[-1] + 2))
        for step in range(self.steps[-1] + 1):
            byte = np.where(at < end, data[np.minimum(at, end)], 0)
            if edge[step] < edge[step + 1]:
                own = slice(edge[step], edge[step + 1])
                shown[self.order[own]] = byte[self.walk[own]]
            at += (self.bits[step % PERIOD][byte] >> shift) & 1
        out = np.repeat(mix(np.arange(1, TABLES + 1, dtype=np.uint64))[None, :], len(first), axis=0)
        for k in range(SAMPLED):
            out = mix(out * np.uint64(257) + shown[k::SAMPLED].T + np.uint64(1))
        return out

    def look_up(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the window, item) of all that meet in a table."""
        found = [np.empty((0, 2), np.int64)]
        for begin in range(0, len(first), WINDOWS):
            own = slice(begin, begin + WINDOWS)
            keys = self.keys(data, first[own], end[own]).ravel()
            low = np.searchsorted(self.held, keys, side="left")
            count = np.searchsorted(self.held, keys, side="right") - low
            n = int(count.sum())
            k = np.repeat(low, count) + np.arange(n) - np.repeat(np.cumsum(count) - count, count)
            window = np.repeat(np.arange(len(keys)) // TABLES + begin, count)
            found.append(np.unique(np.column_stack((window, self.owner[k])), axis=0))
        out = np.concatenate(found)
        return out[:, 0], out[:, 1]


class Index:
    """Items with what the search needs; items that are empty when plain are left out."""

    def __init__(self, items: list[tuple[int, bytes]]):
        kept = sorted(((len(t), i, t) for i, t in ((i, plain(t)) for i, t in items) if t))
        self.ids, self.texts = [i for _, i, _ in kept], [t for _, _, t in kept]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([allowed(len(t)) for t in self.texts], np.int64)
        self.width = np.array([shared_width(len(t)) for t in self.texts], np.int64)
        self.least = self.lengths - self.width + 1 - self.edits * self.width
        self.strings = [Strings(w, own, [self.texts[n] for n in own]) for w in sorted(set(self.width.tolist())) if (own := np.flatnonzero(self.width == w).tolist())]
        self.walks, self.kind = [], np.zeros(len(self.texts), np.int64)
        at = 0
        while at < len(self.texts):
            stop = int(np.searchsorted(self.lengths, CLASS * self.lengths[at], side="right"))
            self.kind[at:stop] = len(self.walks)
            self.walks.append(Walks(list(range(at, stop)), self.texts[at:stop]))
            at = stop

    def close(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, start) of the windows that share enough strings with an item: no window within the limit is missing."""
        none = np.empty(0, np.int64)
        if not len(self.ids):
            return none, none, none
        at, item, place = (np.concatenate(x) for x in zip(*(s.hits(data) for s in self.strings), strict=True))
        doc = np.searchsorted(ends, at, side="right")
        order = np.lexsort((at, item, doc))
        at, item, place, doc = at[order], item[order], place[order], doc[order]
        # Places that have a string of the item, each once.
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (item[1:] != item[:-1])))[: len(at)]
        head = np.flatnonzero(new)
        far = np.arange(len(head)) + self.least[item[head]] - 1
        good = far < len(head)
        i, j = head[good], head[far[good]]
        fits = (item[i] == item[j]) & (doc[i] == doc[j]) & (at[j] - at[i] <= self.lengths[item[i]] + self.edits[item[i]] - self.width[item[i]])
        step = np.zeros(len(head) + 1, np.int64)
        np.add.at(step, np.flatnonzero(good)[fits], 1)
        np.subtract.at(step, far[good][fits] + 1, 1)
        enough = (np.cumsum(step[:-1]) > 0)[np.cumsum(new) - 1] if len(head) else np.empty(0, bool)
        if not enough.any():
            return none, none, none
        # Of such a stretch, as many different strings of the item are asked for: one that a text repeats counts once.
        edge = enough & np.concatenate(([True], ~enough[:-1] | (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])))
        stretch = (np.cumsum(edge) - 1)[enough]
        doc, item, place, at = doc[enough], item[enough], place[enough], at[enough]
        own = np.unique(stretch * (int(self.lengths.max()) + 1) + place) // (int(self.lengths.max()) + 1)
        good = np.bincount(own)[stretch] >= self.least[item]
        doc, item, start = doc[good], item[good], (at - place)[good]
        if not len(doc):
            return none, none, none
        found = np.unique(np.column_stack((doc, item, start)), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def windows(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the windows that meet the item in a table."""
        doc, item, start = self.close(data, ends)
        begin = np.concatenate(([0], ends))
        met = np.zeros(len(doc), bool)
        for k in np.unique(self.kind[item]).tolist():
            own = np.flatnonzero(self.kind[item] == k)
            first = np.maximum(start[own], begin[doc[own]])
            # Windows of several items at one place are embedded once.
            places, back = np.unique(first, return_inverse=True)
            last = np.zeros(len(places), np.int64)
            last[back] = ends[doc[own]] - 1
            window, other = self.walks[k].look_up(data, places, last)
            pairs = window * len(self.ids) + other
            met[own] = np.isin(back * len(self.ids) + item[own], pairs)
        return doc[met], item[met], start[met]

    def parts(self, texts: list[bytes]):
        """(number of the text, plain text and an end): long texts in pieces, of which one has each window whole."""
        over = 2 * int((self.lengths + self.edits).max(initial=1))
        step = max(CHUNK, over)
        for n, t in enumerate(texts):
            t = plain(t)
            for at in range(0, max(1, len(t) - over), step):
                yield n, t[at : at + step + over] + b"\n"

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(number of the text, item id, edit distance) of all texts that hold an item."""
        out: dict[tuple[int, int], int] = {}
        some: list[tuple[int, bytes]] = []
        size = 0
        for n, t in self.parts(texts):
            if some and size + len(t) > CHUNK:
                self.search(some, out)
                some, size = [], 0
            some.append((n, t))
            size += len(t)
        if some:
            self.search(some, out)
        return sorted((d, i, x) for (d, i), x in out.items())

    def search(self, some: list[tuple[int, bytes]], out: dict[tuple[int, int], int]) -> None:
        """Adds the items that the texts hold to out."""
        joined = b"".join(t for _, t in some)
        ends = np.cumsum([len(t) for _, t in some])
        doc, item, start = self.windows(np.frombuffer(joined, np.uint8), ends)
        # Windows of one document and item that overlap are looked at together.
        near = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (start[1:] - start[:-1] <= self.lengths[item[1:]])
        head = np.flatnonzero(np.concatenate(([True], ~near)))[: len(doc)]
        tail = np.append(head[1:], len(doc)) - 1
        for d, n, s, e in zip(doc[head].tolist(), item[head].tolist(), start[head].tolist(), start[tail].tolist() if len(head) else [], strict=True):
            key, k = (some[d][0], self.ids[n]), int(self.edits[n])
            a, z = max(s - k, int(ends[d]) - len(some[d][1])), min(e + len(self.texts[n]) + k, int(ends[d]) - 1)
            distance = edit_distance(self.texts[n], joined[a:z])
            if distance <= k:
                out[key] = min(distance, out.get(key, distance))


def index(held) -> Index:
    """The worker's index of the items sent, kept between tasks that search for them."""
    name, items = held.value
    return staying(name, lambda: Index(items))


def sent(benchmark: DataFrame, item_bytes: int = ITEM_BYTES):
    """Broadcasts of the items, of about item_bytes of text each, one after another; null texts and ids are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    total = int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(1, -(-total // item_bytes))
    for p in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        yield benchmark.sparkSession.sparkContext.broadcast((uuid4().hex, sorted((r["item_id"], r["text"].encode()) for r in own)))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and distance of each document and item of which it holds a copy.

    Texts are compared in lower case (A-Z) with white space as single spaces; a copy may differ
    by a tenth of the item's bytes, rounded down.  A document that is null, empty or shorter than
    all items gives no rows, nor does an item that is null or blank.  A null doc_id stays null and
    repeated rows each give their rows; several texts of one item_id are all searched and the least
    distance of each is given.  An empty table on either side gives an empty one.  Other columns
    are left out.  A very long text is searched in pieces of CHUNK bytes that overlap by twice the
    longest item.
    """
    out = None
    for held in sent(benchmark):

        def run(batches, held=held):
            for batch in batches:
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                found = index(held).leaks(texts)
                rows, items, distances = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(distances, pa.int32())], ["doc_id", "item_id", "distance"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run, keeps=True), "doc_id long, item_id long, distance int")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item.

    A row with a null or empty text stays, as does each of repeated rows.
    """
    for held in sent(benchmark):

        def run(batches, held=held):
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                    drop = {d for d, _, _ in index(held).leaks(texts)}
                    yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in drop], pa.int64()))

        docs = docs.mapInArrow(tidied(run, keeps=True), docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
