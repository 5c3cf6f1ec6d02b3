"""SimHash near-dedup: fingerprints of 4-word shingles, linked by multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints with at most `distance` differing bits
have a segment with at most distance // segments of them, so each fingerprint looks up the
small Hamming ball around each of its segments in a table of all segments, and complete
distances decide.  Equal fingerprints are one node.  In each bucket of the table, the
fingerprint of most documents stands for those close to it: pairs that are both close to it
are connected already and are never formed, so a group of copies gives links in proportion to
its size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.session import kept
from cairn.llm.blocks import NO_ID, tidied
from cairn.operators.components import connected_components

SHINGLE = 4
DISTANCE = 4
#: Three tables of 21 or 22 bits suit up to about 2**24 fingerprints; two of 32 bits more.
SEGMENTS = 3
SEED = 42


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64 bits: each is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = (end - [len(w) for w in words]).tolist()
    stop = end[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:z], SEED) for a, z in zip(start, stop, strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return sum(1 << j for j in np.flatnonzero(2 * ones > len(h)).tolist())


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id long, fingerprint long (the same 64 bits, signed)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, fingerprint long")


def cuts(segments: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    edge = [64 * i // segments for i in range(segments + 1)]
    return [(a, z - a) for a, z in zip(edge, edge[1:], strict=False)]


def segment_key(number: int, first: int, width: int):
    """A segment's bits below the segment's number."""
    bits = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
    return bits.bitwiseOR(F.lit(number << 40))


def ball(number: int, first: int, width: int, radius: int):
    """Keys with at most radius other bits; of two neighbours the one with the smaller key asks."""
    own = segment_key(number, first, width)
    flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    keys = F.transform(F.array(*map(F.lit, flips)).cast("array<bigint>"), lambda x: own.bitwiseXOR(x))
    return F.filter(keys, lambda k: k >= own)


def close(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(u, v) fingerprint pairs within distance: not all of them, but enough to connect all.

    nodes has different fingerprints fp and n, the number of documents of each.
    """
    keys = F.array(*(segment_key(i, a, w) for i, (a, w) in enumerate(cuts(segments))))
    table = nodes.select("fp", "n", F.explode(keys).alias("key"))
    heads = table.groupBy("key").agg(F.max(F.struct("n", "fp"))["fp"].alias("head"))
    balls = [ball(i, a, w, distance // segments) for i, (a, w) in enumerate(cuts(segments))]
    asked = nodes.select("fp", F.explode(F.concat(*balls)).alias("key")).join(heads, "key")
    asked = kept(asked.withColumn("near", close("fp", "head", distance)))
    held = table.select("key", F.col("fp").alias("other")).join(heads, "key").withColumn("by_head", close("other", "head", distance)).drop("head")
    to_head = asked.filter("near and fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))
    far = asked.filter("not near").join(held, "key")
    mixed = asked.filter("near").join(held.filter("not by_head"), "key")
    rest = far.unionByName(mixed).filter((F.col("fp") != F.col("other")) & close("fp", "other", distance))
    return to_head.unionAll(rest.select(F.col("fp").alias("u"), F.col("other").alias("v"))).distinct()


def simhash_dedup(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id linked by any chain.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space.  A text of fewer than
    width words is one shingle; a null, empty or blank text has fingerprint zero, which links
    like any other.  A null doc_id counts as larger than any other and stays null.  Repeated
    rows each give a row.  An empty table gives an empty one; other columns are left out.
    """
    found = kept(fingerprints(docs, width).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))))
    nodes = kept(found.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    pairs = links(nodes.select("fp", "n"), distance, segments)
    ids = nodes.select("fp", "least")
    edges = pairs.join(ids.toDF("u", "a"), "u").join(ids.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = connected_components(edges).toDF("least", "component")
    named = ids.join(parts, "least", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("component", "least").alias("component_id"))
    null_again = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.join(named, "fingerprint").select(null_again("doc_id"), "fingerprint", null_again("component_id"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
