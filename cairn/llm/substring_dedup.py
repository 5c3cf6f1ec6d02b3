"""Substring dedup: Rabin-Karp hashes of every window of 13 words, counted in Spark.

Each block of documents reduces its windows to one entry per hash, with the smallest doc_id
that has it.  Hash-range buckets join the entries of all blocks and tell each block which of
its hashes a smaller doc_id elsewhere has.  The block then marks the covered words, in
maximal intervals.

Windows count as equal if their 64-bit hashes are: a word's XXH64 enters a polynomial with an
odd multiplier, so two different windows meet with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.blocks import bucket_count, bucket_edges, grouped, id_array, in_blocks, in_sorted, mix, read_block, runs, text_bytes, tidy, tidy_pair

WINDOW = 13
BASE = np.uint64(0x9E3779B97F4A7C15)

OUT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"
ENTRIES = "bucket int, block int, hashes binary, docs binary, counts binary"
TAKEN = "block int, hashes binary"


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A rolling polynomial hash of each window of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * BASE + h[j : j + n]
    return mix(out)


def hashed(table: pa.Table, width: int):
    """ids, words of each document, all window hashes, and the document each belongs to."""
    ids, texts, _ = read_block(table)
    words = [t.split() for t in texts]
    parts = [window_hashes(w, width) for w in words]
    owner = np.repeat(np.arange(len(ids)), [len(p) for p in parts])
    return ids, words, np.concatenate(parts or [np.empty(0, np.uint64)]), owner


def entries_of(width: int, buckets: int):
    def entries(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids, _, hashes, owner = hashed(table, width)
        once, first = np.unique(hashes, return_index=True)
        doc = owner[first]
        rows: dict[str, list] = {k: [] for k in ("bucket", "block", "hashes", "docs", "counts")}
        edges = bucket_edges(once, buckets)
        for b in range(buckets):
            part = slice(edges[b], edges[b + 1])
            if edges[b] == edges[b + 1]:
                continue
            order = np.argsort(doc[part], kind="stable")
            held, counts = np.unique(doc[part], return_counts=True)
            rows["bucket"].append(b)
            rows["block"].append(block)
            rows["hashes"].append(once[part][order].tobytes())
            rows["docs"].append(ids[held].tobytes())
            rows["counts"].append(counts.astype(np.uint32).tobytes())
        return pa.table({k: pa.array(v, pa.int32() if k in ("bucket", "block") else pa.binary()) for k, v in rows.items()})

    return entries


def taken(table: pa.Table) -> pa.Table:
    """For each block of a bucket the hashes that a smaller doc_id of another block has."""
    blocks = table.column("block").to_pylist()
    hashes, docs, lens = [], [], []
    for h, d, c in zip(*(table.column(k).to_pylist() for k in ("hashes", "docs", "counts")), strict=True):
        hashes.append(np.frombuffer(h, np.uint64))
        docs.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)))
        lens.append(len(hashes[-1]))
    h, d = np.concatenate(hashes), np.concatenate(docs)
    piece = np.repeat(np.arange(len(blocks), dtype=np.int32), lens)
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    h, order = h[shared], order[shared]
    out: list[tuple[int, bytes]] = []
    if len(h):
        d, piece = d[order], piece[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.append(start, len(h))))
        lost = d > least
        h, piece = h[lost], piece[lost]
        order = np.argsort(piece, kind="stable")
        h, piece = h[order], piece[order]
        at = np.searchsorted(piece, np.arange(len(blocks) + 1))
        out = [(blocks[i], h[at[i] : at[i + 1]].tobytes()) for i in range(len(blocks)) if at[i] < at[i + 1]]
    return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "hashes": pa.array([x for _, x in out], pa.binary())})


def kept_of(width: int):
    def kept(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, words, hashes, owner = hashed(table, width)
        lost = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in replies.column("hashes").to_pylist()] or [np.empty(0, np.uint64)]))
        once, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        gone = in_sorted(once, lost)[back] | (ids[owner] > ids[owner[first]][back])
        sizes = np.array([len(w) for w in words], np.int64)
        base = np.concatenate(([0], np.cumsum(sizes)))
        windows = np.maximum(sizes - width + 1, 0)
        at = np.arange(len(hashes)) - np.repeat(np.cumsum(windows) - windows, windows) + base[owner]
        step = np.zeros(base[-1] + 1, np.int32)
        np.add.at(step, at[gone], 1)
        np.add.at(step, at[gone] + width, -1)
        covered = np.cumsum(step[:-1]) > 0
        removed, texts, spans = [], [], []
        for i, w in enumerate(words):
            mine = covered[base[i] : base[i + 1]]
            n = int(mine.sum())
            removed.append(n)
            if n:
                a, z = runs(mine)
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, z, strict=True)])
                w = [w[k] for k in np.flatnonzero(~mine)]
            else:
                spans.append([])
            texts.append(b" ".join(w))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": id_array(ids), "n_words": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "spans": pa.array(spans, kind)})

    return kept


def empty_safe(f, schema: pa.Schema):
    """A block that has replies but no documents can't be; one that has no documents gives nothing."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        return f(table, replies) if table.num_rows else schema.empty_table()

    return run


def substring_dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Removes each word covered by a window of width words that starts in a smaller doc_id too.

    docs has doc_id and text; other columns are left out.  Returns doc_id, n_words, n_removed,
    kept_text (kept words joined by one space) and spans (maximal removed intervals of word
    numbers, end excluded).

    A null text has no words and an empty kept_text; so has an empty one.  A null doc_id counts
    as larger than any other and stays null.  Rows with one doc_id don't remove each other's
    words, and each gives a row.  An empty table gives an empty one.  A very long text is one
    block by itself, with all its words in memory.
    """
    total = text_bytes(docs)
    blocks = in_blocks(docs, total)
    by_block = grouped(blocks, "block", total)
    entries = by_block.applyInArrow(tidy(entries_of(width, bucket_count(total + total // 4))), ENTRIES)
    replies = grouped(entries, "bucket", 2 * total).applyInArrow(tidy(taken), TAKEN)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", kind)])
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(tidy_pair(empty_safe(kept_of(width), schema)), OUT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, w[i:i + 12] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
lost AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM s) WHERE least < doc_id),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM lost),
words AS (SELECT doc_id, w[k] AS word, k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS body, count(*) AS n FROM words ANTI JOIN cut USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
