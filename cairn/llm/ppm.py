"""LM scoring: prediction by partial matching over bytes, against a word unigram base.

Counts of what byte follows which five bytes are gathered over all training documents; those of
shorter contexts are their sums.  They form a trie of contexts of 0 to 5 bytes.  A byte that
its longest context has not seen is coded by an escape (one count for each different byte seen
there) and looked up in the context one byte shorter, where what the longer one has
seen is excluded; last come all byte values alike.

Nothing is left out of the counts, so they don't go to one place.  The score of a byte depends
only on itself and the five bytes before it: each block of documents asks for its different
six-byte strings, in buckets by the two bytes before the last.  A bucket so holds all contexts
of two bytes and more of its strings; those of none and one byte (at most 2**16 counts) are
known everywhere.  Words go the same way, in buckets by their hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.blocks import bucket_count, bucket_edges, grouped, in_blocks, mix, text_bytes, tidied, tidy, tidy_pair
from cairn.llm.langid import fold

ORDER = 5
PIECE = 1 << 20
#: Bytes of text for one bucket of six-byte strings.
PAIR_BYTES = 4 << 20
#: Contexts shorter than this are counted in one place.
LOW = 2

COUNTS = "key long, n long"
ASKED = "bucket int, block int, hashes binary, counts binary"
ANSWERS = "block int, bucket int, counts binary, tokens long, kinds long"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def normal(text: bytes) -> bytes:
    return text.lower()


def pairs_of(texts: list[bytes]) -> np.ndarray:
    """For each byte, and for an end after each text, the ORDER bytes before it and itself in one number; zeros before the start."""
    zeros = bytes(ORDER)
    data = np.frombuffer(zeros + b"".join(t + b"\0" + zeros for t in texts), np.uint8).astype(np.uint64)
    out = data[ORDER:].copy()
    for back in range(1, ORDER + 1):
        out |= data[ORDER - back : len(data) - back] << np.uint64(8 * back)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    keep = np.ones(len(out), bool)
    ends = np.cumsum(lengths + ORDER)
    for k in range(1, ORDER + 1):
        keep[ends - k] = False
    return out[keep]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[start], np.add.reduceat(n, start)


def pieces(texts: list[bytes]):
    """Texts in lists of about a megabyte."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= PIECE):
            size += len(texts[stop])
            stop += 1
        yield texts[at:stop]
        at = stop


def count_low(texts: DataFrame) -> np.ndarray:
    """How often each byte (low 8 bits of the place) follows each other (high 8 bits) over all rows of column text."""

    def run(batches):
        n = np.zeros(1 << (8 * LOW), np.int64)
        for batch in batches:
            for some in pieces([normal(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]):
                n += np.bincount((pairs_of(some) & np.uint64(len(n) - 1)).astype(np.int64), minlength=len(n))
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["key", "n"])

    out = np.zeros(1 << (8 * LOW), np.int64)
    found = texts.select("text").mapInArrow(tidied(run), COUNTS).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out


class Table:
    """Finds the places of keys in a sorted array, through a hash table of open addressing."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.full(1 << bits, self.FREE), np.zeros(1 << bits, np.int32)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at] == self.FREE)
            slots, who = np.unique(at[free], return_index=True)
            who = free[who]
            self.keys[slots], self.places[slots] = keys[left[who]], left[who]
            rest = np.ones(len(left), bool)
            rest[who] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys + np.uint64(1)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for one that isn't there."""
        at = self.slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.places[at], -1)
        going = np.flatnonzero((held != keys) & (held != self.FREE))
        at = at[going]
        while len(going):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[going]
            out[going[hit]] = self.places[at[hit]]
            on = ~hit & (held != self.FREE)
            going, at = going[on], at[on]
        return out


class Trie:
    """Log10 probabilities of bytes after contexts of up to ORDER bytes.

    orders[k] has the keys (context of k bytes, then the byte) in order, and their counts.
    """

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        self.successors, self.contexts = [], []
        shorter = None
        self.none = -np.log10(256)
        for k, (key, count) in enumerate(orders):
            context = key >> np.uint64(8)
            start = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))[: len(key)]
            seen, kinds = (np.add.reduceat(count, start), np.diff(np.append(start, len(key)))) if len(key) else (count, count)
            if k and len(key):
                key0, count0, context0, seen0, kinds0 = shorter
            whole, owner = np.log10(seen + kinds), np.repeat(np.arange(len(start)), kinds)
            # Log of the count, alone and over all: the probability where no longer context has been escaped from.
            log = np.log10(count)
            self.successors.append((Table(key), np.column_stack((log - whole[owner], log)).astype(np.float32)))
            # Escape from here; then the divisor and the escape one byte shorter, without what was seen here.
            figures = np.zeros((len(start), 3))
            figures[:, 0] = np.log10(kinds) - whole
            if k and len(key):
                at = np.searchsorted(key0, key & np.uint64((1 << (8 * k)) - 1))
                under = np.searchsorted(context0, context[start] & np.uint64((1 << (8 * (k - 1))) - 1))
                left, rest = seen0[under] - np.add.reduceat(count0[at], start), kinds0[under] - kinds
                divisor = np.log10(np.maximum(left + rest, 1))
                figures[:, 1] = divisor
                # With nothing left there, the code goes on at no cost.
                figures[:, 2] = np.where(rest > 0, np.log10(np.maximum(rest, 1)) - divisor, 0)
            elif len(key) and len(key) < 256:
                self.none = -np.log10(256 - len(key))
            self.contexts.append((Table(context[start]), figures.astype(np.float32)))
            shorter = key, count, context[start], seen, kinds

    def score(self, pairs: np.ndarray) -> np.ndarray:
        """Log10 probability of each byte after its context."""
        out, todo = np.zeros(len(pairs)), np.arange(len(pairs))
        escaped, divisor, escape = (np.zeros(len(pairs), kind) for kind in (bool, np.float32, np.float32))
        for k in range(len(self.successors) - 1, -1, -1):
            key = pairs[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            table, logs = self.successors[k]
            at = table.find(key)
            hit = at >= 0
            own = escaped[hit]
            out[todo[hit]] += np.where(own, logs[at[hit], 1] - divisor[hit], logs[at[hit], 0])
            todo, key, escaped, divisor, escape = (x[~hit] for x in (todo, key, escaped, divisor, escape))
            table, figures = self.contexts[k]
            at = table.find(key >> np.uint64(8))
            # A context that the trie hasn't costs nothing: the code enters one byte shorter.
            there = at >= 0
            new = figures[at[there]]
            out[todo[there]] += np.where(escaped[there], escape[there], new[:, 0])
            escaped[there], divisor[there], escape[there] = True, new[:, 1], new[:, 2]
        out[todo] += self.none
        return out


def trained(low: np.ndarray, pairs: np.ndarray, counts: np.ndarray, order: int) -> Trie:
    """The trie of one bucket: what it has of contexts of LOW bytes and more, over the shorter ones of all."""
    orders = []
    for k in range(min(LOW, order + 1)):
        n = low.reshape(-1, 1 << (8 * (k + 1))).sum(axis=0)
        key = np.flatnonzero(n)
        orders.append((key.astype(np.uint64), n[key]))
    for k in range(LOW, order + 1):
        orders.append(merged([pairs & np.uint64((1 << (8 * (k + 1))) - 1)], [counts]) if len(pairs) else (pairs, counts))
    return Trie(orders)


END = np.uint64(xxhash.xxh64_intdigest(b""))


def words_of(table: pa.Table):
    """ids, normal texts, word hashes with an end after each text, and number of words with the end."""
    ids = table.column("doc_id")
    texts = [normal(t) for t in table.column("text").cast(pa.binary()).to_pylist()]
    parts = []
    for t in texts:
        w = t.split()
        parts.append(np.append(np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), END))
    return ids, texts, np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def packed(x: np.ndarray) -> bytes:
    """An array's bytes by place in the number, compressed, after its size."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def packed_keys(x: np.ndarray) -> bytes:
    """The same for keys in order, as the steps between them."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def pair_buckets(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair, by the two bytes before its last."""
    spread = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) >> np.uint64(32)
    own = (spread * np.uint64(buckets)) >> np.uint64(32)
    return own[((pairs >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64)


def pairs_asked(texts: list[bytes], learn: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's different pairs, in order of bucket and pair, how often its training texts have each, and where the buckets end."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for trains in (True, False):
        for some in pieces([t for t, x in zip(texts, learn, strict=True) if x == trains]):
            k, n = np.unique(pairs_of(some), return_counts=True)
            keys.append(k)
            counts.append(n if trains else np.zeros(len(k), np.int64))
    k, n = merged(keys, counts)
    own = pair_buckets(k, buckets)
    order = np.argsort(own, kind="stable")
    return k[order], n[order], np.concatenate(([0], np.cumsum(np.bincount(own, minlength=buckets))))


def asked_of(buckets: int, pair_buckets: int):
    """A block's different words in order of hash, and its different pairs, with how often its training texts have each.

    The buckets of pairs have the numbers after those of words.  Each block asks in all buckets
    of words, since their answers have the totals.
    """

    def asked(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, texts, words, sizes = words_of(table)
        learns = ~np.array(table.column("held_out").to_pylist(), bool)
        once, back = np.unique(words, return_inverse=True)
        counts = np.bincount(back, weights=np.repeat(learns, sizes), minlength=len(once)).astype(np.int64)
        edge = bucket_edges(once, buckets)
        pairs, n, ends = pairs_asked(texts, learns, pair_buckets)
        fully = [b for b in range(pair_buckets) if ends[b] < ends[b + 1]]
        cut = lambda f, x, y: pa.array([f(x[edge[b] : edge[b + 1]]) for b in range(buckets)] + [f(y[ends[b] : ends[b + 1]]) for b in fully], pa.binary())
        numbers = [*range(buckets), *(buckets + b for b in fully)]
        return pa.table({"bucket": pa.array(numbers, pa.int32()), "block": pa.array([block] * len(numbers), pa.int32()), "hashes": cut(packed_keys, once, pairs), "counts": cut(packed, counts, n.astype(np.uint32))})

    return tidy(asked)


def answered_of(buckets: int, low, order: int):
    """For each block the counts over all blocks of the words it asked for, or the scores of its pairs; and the totals of the bucket's words."""

    def answered(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        hashes = [unpacked_keys(x) for x in table.column("hashes").to_pylist()]
        words = table.column("bucket")[0].as_py() < buckets
        n = np.concatenate([unpacked(x, np.int64 if words else np.uint32) for x in table.column("counts").to_pylist()])
        h, back = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(back, weights=n, minlength=len(h)).astype(np.int64)
        if words:
            out = n
        else:
            out = trained(low.value, h[n > 0], n[n > 0], order).score(h).astype(np.float32)
        edge = np.concatenate(([0], np.cumsum([len(x) for x in hashes])))
        tokens, kinds = (int(n.sum()), int((n > 0).sum())) if words else (0, 0)
        return pa.table({
            "block": pa.array(blocks, pa.int32()), "bucket": table.column("bucket"), "counts": pa.array([packed(out[back[a:z]]) for a, z in zip(edge, edge[1:], strict=False)], pa.binary()),
            "tokens": pa.array([tokens] * len(blocks), pa.int64()), "kinds": pa.array([kinds] * len(blocks), pa.int64()),
        })

    return tidy(answered)


def scored_of(buckets: int, pair_buckets: int):
    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
        ids, texts, words, sizes = words_of(table)
        rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        counts = np.concatenate([unpacked(x, np.int64) for b, x in rows if b < buckets])
        count = counts[np.unique(words, return_inverse=True)[1]]
        first = np.cumsum(sizes) - sizes
        tokens, kinds = (sum(answers.column(c).to_pylist()) for c in ("tokens", "kinds"))
        base = np.add.reduceat(np.log10(count + 1.0), first) - sizes * np.log10(tokens + kinds + 1)
        pairs, _, _ = pairs_asked(texts, np.ones(len(texts), bool), pair_buckets)
        own, logs = Table(pairs), np.concatenate([unpacked(x, np.float32) for b, x in rows if b >= buckets])
        score = []
        for some in pieces(texts):
            lengths = np.array([len(t) + 1 for t in some], np.int64)
            score.append(np.add.reduceat(logs[own.find(pairs_of(some))].astype(np.float64), np.cumsum(lengths) - lengths))
        return pa.table({
            "doc_id": ids, "held_out": table.column("held_out"), "n_tokens": pa.array(sizes), "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
            "train_tokens": pa.array(np.full(len(sizes), tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(np.concatenate(score)),
        })

    return tidy_pair(scored)


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores all texts by a model learned from the rows whose column held_out is false.

    docs has doc_id, text and held_out (null: false); other columns are left out.  Returns
    doc_id, held_out, n_tokens (words and one end), n_known (tokens that training has),
    train_tokens, base_score (log10 of the add-one unigram probability) and score (log10 of the
    byte model's probability of the lower-cased text and its end).

    A null text counts as empty: one token, the end.  Null and repeated ids each give a row.
    Without training rows, each byte is one of 256 alike.  An empty table gives an empty one.
    A very long text is one block by itself, read in pieces of whole texts.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.col("held_out"), F.lit(False))
    low = spark.sparkContext.broadcast(count_low(docs.filter(~held).select(F.coalesce("text", F.lit("")).alias("text"))))
    total = text_bytes(docs)
    blocks = in_blocks(docs, total, keep=[held.alias("held_out")])
    by_block = grouped(blocks, "block", total)
    buckets, of_pairs = bucket_count(total // 2), bucket_count(total, PAIR_BYTES)
    asked = by_block.applyInArrow(asked_of(buckets, of_pairs), ASKED)
    answers = grouped(asked, "bucket", 2 * total).applyInArrow(answered_of(buckets, low, order), ANSWERS)
    # One plan, so that the exchange of texts by block is made once.
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(scored_of(buckets, of_pairs), OUT)


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs.withColumn("held_out", fold(7) == 2))
