"""Near copies by word shingles: candidates by min-hash bands, links by exact similarity.

Rows of the same set of shingles are one node.  Nodes that agree in a band meet in its bucket;
BANDS bands of ROWS least hashes bring a pair of similarity 0.8 together with a chance of
1 - (1 - 0.8**4)**16 = 0.9998, and closer ones more surely.  A few bits of each least hash rule out
most pairs that are far apart.  For the others, the exact Jaccard similarity of the sets decides:
the one node's text goes to the other's.

Each node is first held against the central node of one of its buckets: the one whose buckets hold
most nodes in all, so that the buckets of a group name the same node.  What that has connected is
never compared again.  Pairs that op6's fingerprints link (over these shingles) are verified in the
same way, whether or not they share a bucket.  All other pairs of a bucket are held against each
other where the bucket's nodes meet, by a second sketch of a thousand places and then exactly, each
pair in the first bucket that it shares; pairs are no rows, only the links that connect more are.
Texts go to the buckets in which their nodes have a pair to verify.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.session import kept
from cairn.llm import simhash
from cairn.llm.blocks import mix, tidied
from cairn.operators.components import connected_components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
#: Bits of each least hash in a sketch, and differing least hashes of BANDS * ROWS up to which a pair goes on: at 0.8, three in ten thousand have more.
BITS, FAR = 4, 23
#: The second sketch: TURNS orders of the set, in each the first member after each of PLACES points, FINE bits of each.
TURNS, PLACES, FINE = 8, 128, 2
#: Deviations of the second sketch's estimate that a pair of similarity 0.8 may have: two in ten thousand have more.
DEVIATIONS = 3.5
#: Pairs of one node that are looked at in a task.
FAN = 256
#: Bytes of the nodes of a bucket (sketches, or texts as packed) that a task holds against all its others, what is added to a node's own, and words of two sketches compared at once.
TILE_BYTES, NODE_BYTES, AT_ONCE = 4 << 20, 512, 1 << 20
#: Shingles of the sets that a task keeps unpacked.
UNPACKED = 1 << 21
#: Rows that name who is compared to whom which go to all tasks, some 8 MB; more are joined by a shuffle of the texts.
SENT = 1 << 18
SEEDS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
ORDERS = np.random.default_rng(23).integers(0, 1 << 63, TURNS, dtype=np.uint64)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Different hashes, in order, of all runs of width words; a shorter text is one run."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = (end - [len(w) for w in words]).tolist()
    stop = end[min(width, len(words)) - 1 :].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:z]) for a, z in zip(start, stop, strict=False)], np.uint64))


def least_hashes(own: np.ndarray) -> np.ndarray:
    """The least hash of the set for each of BANDS * ROWS hash functions."""
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1 << 12):
        least = np.minimum(least, mix(own[None, at : at + (1 << 12)] ^ SEEDS[:, None]).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band: its number and a hash of its least hashes."""
    least = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key ^ least[:, r]) + np.uint64(r + 1)
    return key.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """BITS numbers of 64 bits, one bit of each least hash in each."""
    bits = (least[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]).astype(np.uint8) & 1
    return np.packbits(bits, axis=1).view(np.int64).ravel()


def fine_sketch(own: np.ndarray) -> np.ndarray:
    """FINE times TURNS * PLACES bits as numbers of 64: what comes next in each order after evenly spaced points, round the end."""
    if not len(own):
        return np.zeros(FINE * TURNS * PLACES // 64, np.int64)
    points = np.arange(PLACES, dtype=np.uint64) << np.uint64(64 - PLACES.bit_length() + 1)
    found = np.empty((TURNS, PLACES), np.uint64)
    for turn, seed in enumerate(ORDERS):
        order = np.sort(mix(own ^ seed))
        at = np.searchsorted(order, points)
        found[turn] = order[np.where(at < len(order), at, 0)]
    found = mix(found + np.arange(PLACES, dtype=np.uint64))
    bits = (found.ravel()[None, :] >> np.arange(FINE, dtype=np.uint64)[:, None]).astype(np.uint8) & 1
    return np.packbits(bits, axis=1).view(np.int64).ravel()


def allowed(size: int, similar: float) -> int:
    """Differing places of two second sketches, the smaller set of size members, up to which they may be of that similarity.

    The estimate varies by the places that are drawn, by the members that TURNS orders weigh, and
    by places that differ but agree in their bits.
    """
    places, seen = TURNS * PLACES, 1 - 2.0**-FINE
    spread = similar * (1 - similar) * (1 / places + 1 / (TURNS * max(size, 1))) + (1 - similar) * (1 - seen) / seen / places
    return int(places * seen * min(1.0, 1 - similar + DEVIATIONS * spread**0.5)) + 1


def signed(docs: DataFrame, width: int, similar: float) -> DataFrame:
    """doc_id, row (a hash of the text), place (a hash of id and text), node (a hash of the set), keys, both sketches, what the second allows and the packed text; a set without shingles has no keys."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            node, keys, sketches, fine, far, packed = [], [], [], [], [], []
            for t in batch.column(2).cast(pa.binary()):
                text = t.as_py() or b""
                own = shingles(text, width)
                least = least_hashes(own)
                node.append(xxhash.xxh64_intdigest(own.tobytes()))
                keys.append(bands(least) if len(own) else np.empty(0, np.int64))
                sketches.append(sketch(least))
                fine.append(fine_sketch(own))
                far.append(allowed(len(own), similar))
                packed.append(len(text).to_bytes(8, "little") + codec.compress(text, asbytes=True))
            lists = lambda xs: pa.array(xs, pa.list_(pa.int64()))
            columns = [*batch.columns[:2], batch.column(3), pa.array(node, pa.uint64()).view(pa.int64()), lists(keys), lists(sketches), lists(fine), pa.array(far, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "place", "node", "keys", "sketch", "fine", "far", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").withColumn("place", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(tidied(run), "doc_id long, row long, place long, node long, keys array<long>, sketch array<long>, fine array<long>, far int, packed binary")


def differing(a: str, b: str) -> Column:
    """In how many places two sketches differ."""
    bits = F.col(a)[0].bitwiseXOR(F.col(b)[0])
    for i in range(1, BITS):
        bits = bits.bitwiseOR(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return F.bit_count(bits)


def unpacked(packed: bytes, width: int) -> np.ndarray:
    """The shingles of a text that signed() has packed."""
    return shingles(pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), width)


def alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, similar: float) -> DataFrame:
    """The (u, v) of pairs whose sets are similar; the text of each u goes to that of its v, and a v of many pairs is dealt over many tasks.

    In a partition, the rows of one v are together, its own text first.
    """
    pairs = kept(pairs)
    counted = pairs.groupBy("v").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts"))
    of_u = pairs.join(counted, "v").select(F.col("u").alias("node"), "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("turn"))
    of_v = counted.select(F.col("v").alias("node"), "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"))
    asked = kept(of_u.unionAll(of_v).join(nodes.select("node", "place"), "node"))
    if asked.count() <= SENT:
        asked = F.broadcast(asked)
    dealt = rows.select("place", "packed").join(asked, "place").repartition("v", "part").sortWithinPartitions("v", "part", "turn").select("v", "part", "turn", F.col("node").alias("u"), "packed")

    def run(batches):
        now, held = None, np.empty(0, np.uint64)
        for batch in batches:
            v, part, turn, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            good = []
            for i, t in enumerate(batch.column(4)):
                if turn[i] == 0 and now == (v[i], part[i]):
                    continue
                own = unpacked(t.as_py(), width)
                if turn[i] == 0:
                    now, held = (v[i], part[i]), own
                    continue
                both = len(np.intersect1d(own, held, assume_unique=True))
                if both >= similar * (len(own) + len(held) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], ["u", "v"])

    return dealt.mapInArrow(tidied(run), "u long, v long")


@dataclass
class Side:
    """Nodes of a bucket that meet others, by column; fine as (node, bit, word)."""

    node: np.ndarray
    part: np.ndarray
    far: np.ndarray
    fine: np.ndarray
    keys: np.ndarray
    packed: pa.Array | None


def side(rows: pa.RecordBatch) -> Side:
    node, part, far = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "part", "far"))
    fine, keys = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("fine", "keys"))
    return Side(node, part, far, fine.view(np.uint64).reshape(len(node), FINE, -1), keys.reshape(len(node), BANDS), rows.column("packed") if "packed" in rows.schema.names else None)


def met_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, Side, Side]]:
    """(key, task, mine, others) from rows in order of key, task and turn: those of turn 0, and of the others as many as a batch has."""
    now, held, mine = None, [], None
    for batch in batches:
        if not len(batch):
            continue
        key, task, turn = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "task", "turn"))
        cuts = (np.flatnonzero(np.diff(key) | np.diff(task) | np.diff(turn)) + 1).tolist()
        for a, z in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if now != (key[a], task[a]):
                now, held, mine = (key[a], task[a]), [], None
            if turn[a] == 0:
                held.append(batch.slice(a, z - a))
                continue
            if mine is None:
                if not held:
                    continue
                mine = side(pa.concat_batches(held))
            yield int(key[a]), int(task[a]), mine, side(batch.slice(a, z - a))


def near_pairs(key: int, mine: Side, others: Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in mine and others of the pairs that are of different parts, may be similar and share no bucket before this one; and how far their second sketches differ."""
    step = max(1, AT_ONCE // (len(others.node) * mine.fine[0].size))
    for at in range(0, len(mine.node), step):
        here = slice(at, at + step)
        far = np.bitwise_count(np.bitwise_or.reduce(mine.fine[here, None] ^ others.fine[None], axis=2)).sum(axis=2, dtype=np.int32)
        good = (far <= np.maximum(mine.far[here, None], others.far[None])) & (mine.part[here, None] != others.part[None]) & (mine.node[here, None] > others.node[None])
        i, j = np.nonzero(good)
        far, i = far[i, j], i + at
        first = (mine.keys[i] == others.keys[j]).argmax(axis=1)
        here = mine.keys[i, first] == key
        yield i[here], j[here], far[here]


def with_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of the nodes that have a pair to verify in a bucket."""
    for key, _, mine, others in met_in(batches):
        i, j, _ = (np.concatenate(x) for x in zip(*near_pairs(key, mine, others), strict=True))
        found = np.union1d(mine.node[i], others.node[j])
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], ["key", "node"])


def linking(width: int, similar: float):
    """(u, v) of the pairs of a bucket that are similar, the nearest first, but those that are connected by then."""

    def run(batches):
        sets: dict[int, np.ndarray] = {}
        size, now, top = 0, None, {}

        def root(x: int) -> int:
            while (y := top.get(x, x)) != x:
                top[x] = top.get(y, y)
                x = y
            return x

        def members(own: Side, at: int) -> np.ndarray:
            nonlocal size
            if (found := sets.get(node := int(own.node[at]))) is None:
                if size > UNPACKED:
                    sets.clear()
                    size = 0
                found = sets[node] = unpacked(own.packed[at].as_py(), width)
                size += len(found)
            return found

        for key, task, mine, others in met_in(batches):
            if now != (key, task):
                now, top = (key, task), {}
            u, v = [], []
            i, j, far = (np.concatenate(x) for x in zip(*near_pairs(key, mine, others), strict=True))
            for k in np.argsort(far, kind="stable").tolist():
                a, b = root(int(mine.part[i[k]])), root(int(others.part[j[k]]))
                if a == b:
                    continue
                one, other = members(mine, i[k]), members(others, j[k])
                both = len(np.intersect1d(one, other, assume_unique=True))
                if both >= similar * (len(one) + len(other) - both):
                    top[a] = b
                    u.append(int(mine.node[i[k]]))
                    v.append(int(others.node[j[k]]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def meeting(members: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of held by bucket, for members (key, node): each bucket in as many tasks as its nodes' bytes ask for, some of them (turn 0) held against all (turn 1) in each."""
    sized = members.join(held.select("node", "bytes"), "node")
    tasks = sized.groupBy("key").agg(F.ceil(F.sum(F.col("bytes") + NODE_BYTES) / TILE_BYTES).cast("int").alias("tasks"))
    dealt = members.join(tasks, "key")
    mine = dealt.select("key", "node", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int").alias("task"), F.lit(0).alias("turn"))
    others = dealt.select("key", "node", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(1).alias("turn"))
    return mine.unionAll(others).join(held.drop("bytes"), "node").repartition("key", "task").sortWithinPartitions("key", "task", "turn")


def rows_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows at the places of wanted (place, node), which go to all tasks where they are few."""
    wanted = kept(wanted)
    return rows.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "place")


def met_links(left: DataFrame, parts: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, similar: float) -> DataFrame:
    """(u, v): similar nodes of different parts that share a bucket; not all of them, but enough to connect all."""
    own = left.select("node").distinct().join(nodes.select("node", "place"), "node")
    first = lambda *columns: [F.first(c).alias(c) for c in columns]
    sketched = rows_of(rows.select("place", "fine", "far", "keys"), own).groupBy("node").agg(*first("fine", "far", "keys"))
    sketched = kept(sketched.join(parts, "node"))
    chosen = kept(meeting(left, sketched.withColumn("bytes", F.lit(NODE_BYTES))).mapInArrow(tidied(with_pairs), "key long, node long").distinct())
    texts = rows_of(rows.select("place", "packed"), chosen.select("node").distinct().join(nodes.select("node", "place"), "node")).groupBy("node").agg(*first("packed"))
    return meeting(chosen, kept(sketched.join(texts, "node").withColumn("bytes", F.length("packed")))).mapInArrow(tidied(linking(width, similar)), "u long, v long")


def fingerprinted(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(u, v) nodes that op6 links: one node of each fingerprint for those close to it, and it with the others of its own."""
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("doc_id"), "text")
    found = simhash.fingerprints(rows, width).toDF("place", "fp").distinct().join(nodes.select("place", "node"), "place").select("node", "fp")
    found = kept(found)
    prints = kept(found.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    first = prints.select("fp", "least")
    linked = simhash.links(prints.select("fp", "n")).toDF("fu", "fv").join(first.toDF("fu", "u"), "fu").join(first.toDF("fv", "v"), "fv").select("u", "v")
    own = found.join(first, "fp").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return linked.unionAll(own).distinct()


def near_copies(docs: DataFrame, width: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """doc_id, row and component: equal for rows linked by any chain of texts whose sets of shingles have a similarity of 0.8 or more.

    row is xxhash64 of the text.  Texts are lower-cased (A-Z) and cut at ASCII white space; one
    of fewer than width words is one shingle, and all without words (null, empty, blank) are one
    component.  Repeated rows and null ids each give a row; an empty table gives an empty one,
    and other columns are left out.  The work on a long text is in proportion to its words.
    """
    rows = kept(signed(docs, width, similar))
    nodes = kept(rows.groupBy("node").agg(F.min("place").alias("place"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    sketches = nodes.select("node", "sketch")
    table = nodes.select("node", F.explode("keys").alias("key"))
    sizes = table.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = kept(table.join(sizes, "key"))
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    central = met.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("head"))
    heads = met.join(central, "key").filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    heads = heads.join(sketches.toDF("u", "us"), "u").join(sketches.toDF("v", "vs"), "v").withColumn("far", differing("us", "vs")).filter(F.col("far") <= FAR)
    first = heads.groupBy("u").agg(F.min(F.struct("far", "v"))["v"].alias("v"))
    links = kept(alike(first.unionAll(fingerprinted(docs, nodes.filter("size(keys) > 0"), width)).distinct(), nodes, rows, width, similar))
    # All other pairs of a bucket that are not connected by now.
    part = connected_components(links).toDF("node", "part")
    parts = kept(met.select("node").distinct().join(part, "node", "left").select("node", F.coalesce("part", "node").alias("part")))
    apart = met.join(parts, "node").groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("key")
    left = kept(met.select("key", "node").join(apart, "key"))
    links = links.unionAll(met_links(left, parts, nodes, rows, width, similar))
    named = connected_components(links).toDF("node", "component")
    return rows.select("doc_id", "row", "node").join(named, "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))
