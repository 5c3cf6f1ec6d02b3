"""Suffix-array dedup: every string of 100 bytes that starts earlier elsewhere is removed.

A window of 100 bytes is filed under its anchor, the string of 24 bytes in it with the least
hash; equal windows have equal anchors at the same place, so equal windows meet in one shard
whatever documents they come from.  First the anchors of all blocks are counted, by hash, and
only text around repeated ones goes on: the windows of one anchor in one document form a
snippet.  Each block sends a snippet once, with its first place.  An anchor of very many
places has its snippets cut into parts by the distance of the windows from the anchor; all windows
of a part hold one stretch of text around it, which then decides the shard, so that a passage that
a third of all documents share is dealt over all shards.  A shard sorts the suffixes
of its different snippets (suffixes.py), finds windows that agree in 100 bytes by the permuted
common prefixes, and answers which windows start earlier elsewhere.  The blocks then mark the
covered bytes.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.llm.blocks import bucket_count, bucket_edges, grouped, id_array, in_blocks, in_sorted, mix, read_block, runs, text_bytes, tidy, tidy_pair
from cairn.llm.suffixes import common_prefixes, suffix_ranks

WIDTH = 100
ANCHOR = 24
CHUNK = 1 << 18
SHARD_BYTES = 4 << 20
#: Snippets are sorted in batches of whole anchors of about this size.
BATCH = 1 << 18
#: Places from which on an anchor is cut into parts, and windows of a part.
HOT = 256
PART = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
SEPARATOR = 0xFF  # in no UTF-8 text

ENTRIES = "bucket int, block int, hashes binary, counts binary"
REPLIES = "block int, kind int, shard int, data binary"
SNIPPETS = "shard int, block int, anchors binary, places binary, bytes binary, lengths binary, docs binary, starts binary"
OUT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"
REPEATED, OFTEN, LOST, CUT = 0, 1, 2, 3
#: Bits of an anchor's hash that give way to its place.  A fixed number, so that windows choose alike wherever they are.
PLACE = np.uint64(32)


def anchors(data: np.ndarray, ends: np.ndarray, width: int):
    """For each maximal range of windows with one anchor: its hash and place, first and last start.

    data holds whole texts that end at ends; no window crosses an end.
    """
    empty = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    n = len(data) - width + 1
    if n <= 0:
        return empty
    h, length, power = BYTE[data], 1, int(BASE)
    eight = None
    while length < 16:
        h = h[:-length] * np.uint64(power) + h[length:]
        length, power = 2 * length, power * power % (1 << 64)
        if length == 8:
            eight, power8 = h, power
    h = mix(h[: len(h) - 8] * np.uint64(power8) + eight[16 : 16 + len(h) - 8])
    least = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    span, have = width - ANCHOR + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    at = (least[:n] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    start = np.concatenate(([0], ends[:-1]))
    valid = np.zeros(n + 1, np.int8)
    long = ends - start >= width
    valid[start[long]] += 1
    np.subtract.at(valid, ends[long] - width + 1, 1)
    valid = np.cumsum(valid[:n]) > 0
    at[~valid] = -1
    edge = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [n]))
    first, last = edge[:-1], edge[1:] - 1
    # two texts can meet without a gap only if no window ends there, so a range is in one text
    good = at[first] >= 0
    first, last = first[good], last[good]
    # An anchor's hash is a least one; mixed again it is spread over all buckets and shards.
    return mix(h[at[first]] + np.uint64(1)), at[first], first, last


def chunks(texts: list[bytes]):
    """Number of the first text, and texts of about CHUNK bytes joined, with their ends."""
    begin = 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        ends = np.cumsum([len(t) for t in texts[begin:stop]])
        yield begin, np.frombuffer(b"".join(texts[begin:stop]), np.uint8), ends
        begin = stop


def ranges(texts: list[bytes], width: int):
    """Hash, document number, first and last start (within the document) of all ranges, and the anchor's place from the first."""
    parts = []
    for begin, data, ends in chunks(texts):
        h, at, first, last = anchors(data, ends, width)
        doc = np.searchsorted(ends, first, side="right")
        base = np.concatenate(([0], ends))[doc]
        parts.append((h, doc + begin, first - base, last - base, at - first))
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def entries_of(width: int, buckets: int):
    def entries(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        once, counts = np.unique(ranges(read_block(table)[1], width)[0], return_counts=True)
        counts = np.minimum(counts, 255).astype(np.uint8)
        edges = bucket_edges(once, buckets)
        full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()), **{k: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()) for k, x in (("hashes", once), ("counts", counts))}})

    return entries


def reply(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table({k: pa.array(v, kind) for k, v, kind in zip(("block", "kind", "shard", "data"), cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)})


def repeated_of(hot: int):
    """For each block of a bucket, its anchors that other blocks have too, and those of hot places (a block counts for 255 at most)."""

    def repeated(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")
        h = h[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        several = np.diff(np.append(start, len(h))) > 1
        often = several & (np.add.reduceat(counts[order].astype(np.int64), start) >= hot)
        rows = []
        for kind, same in ((REPEATED, h[start[several & ~often]]), (OFTEN, h[start[often]])):
            for block, part in zip(blocks, parts, strict=True):
                shared = part[in_sorted(part, same)]
                if len(shared):
                    rows.append((block, kind, 0, shared.tobytes()))
        return reply(rows)

    return repeated


def cut_apart(text: bytes, first: int, last: int, anchor: int, place: int, width: int):
    """The windows first to last of one anchor in parts: (first, last, key, the anchor's place from the first)."""
    at = first + place
    for part in range((at - last) // PART, place // PART + 1):
        low, high = at - part * PART - PART + 1, at - part * PART
        a, z = max(first, low), min(last, high)
        yield a, z, xxhash.xxh64_intdigest(text[high : low + width], anchor ^ part), at - a


def snippets(texts: list[bytes], replies: pa.Table, width: int, shards: int):
    """The block's different snippets by shard, each with its places, the first one first.

    Gives for each shard a list of (text, [(document number, first start, last start, anchor, its place from the first), ...]).
    """
    h, doc, first, last, place = ranges(texts, width)
    told = list(zip(replies.column("kind").to_pylist(), replies.column("data").to_pylist(), strict=True))
    known, often = (np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(d, np.uint64) for k, d in told if k == kind)])) for kind in (REPEATED, OFTEN))
    ordered = np.sort(h)
    own = ordered[1:][ordered[1:] == ordered[:-1]]
    hot = in_sorted(h, often)
    pick = np.flatnonzero(hot | in_sorted(h, known) | in_sorted(h, own))
    found: dict[int, dict[bytes, list]] = {}
    for d, a, z, k, p, many in zip(*(x[pick].tolist() for x in (doc, first, last, h, place, hot)), strict=True):
        for cut in cut_apart(texts[d], a, z, k, p, width) if many else ((a, z, k, p),):
            s = (cut[2] >> 32) * shards >> 32
            found.setdefault(s, {}).setdefault(texts[d][cut[0] : cut[1] + width], []).append((d, *cut))
    return {s: list(x.items()) for s, x in sorted(found.items())}


def snippets_of(width: int, shards: int):
    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("shard", "block", "anchors", "places", "bytes", "lengths", "docs", "starts")}
        if table.num_rows:
            block = table.column("block")[0].as_py()
            ids, texts, _ = read_block(table)
            for s, items in snippets(texts, replies, width, shards).items():
                rows["shard"].append(s)
                rows["block"].append(block)
                rows["anchors"].append(np.array([p[0][3] for _, p in items], np.uint64).tobytes())
                rows["places"].append(np.array([p[0][4] for _, p in items], np.uint16).tobytes())
                rows["bytes"].append(b"".join(t for t, _ in items))
                rows["lengths"].append(np.array([len(t) for t, _ in items], np.uint32).tobytes())
                rows["docs"].append(ids[[p[0][0] for _, p in items]].tobytes())
                rows["starts"].append(np.array([p[0][1] for _, p in items], np.int64).tobytes())
        return pa.table({k: pa.array(v, pa.int32() if k in ("shard", "block") else pa.binary()) for k, v in rows.items()})

    return send


def earlier_windows(texts: list[bytes], place: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(text number, first, end) of window starts of texts that a text of smaller place has too."""
    data = np.frombuffer(b"".join(t + bytes([SEPARATOR]) for t in texts), np.uint8)
    n = len(data)
    order = np.empty(n + 1, np.int64)
    order[suffix_ranks(np.append(data.astype(np.int64) + 1, 0))] = np.arange(n + 1)
    order = order[1:]
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(lengths + 1) - lengths - 1
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    agree = common_prefixes(data, before) >= width
    window = np.arange(n) - base[text] + width <= lengths[text]
    at = order[window[order]]
    joined = (agree & window)[at]
    joined[:1] = False
    group = np.cumsum(~joined) - 1
    start = np.flatnonzero(~joined)
    where = place[text[at]]
    lost = np.zeros(n, bool)
    lost[at] = where > np.minimum.reduceat(where, start)[group] if len(at) else False
    a, z = runs(lost)
    return [(int(t), int(x - base[t]), int(y - base[t])) for t, x, y in zip(text[a], a, z, strict=True)]


def windows_apart(members: list[int], texts: list[bytes], at: list[int], place: np.ndarray, low: int, high: int, width: int, lost: list):
    """Splits the snippets of a common anchor into lists that can share windows; gives lists of (number, start, cut).

    Takes the windows that begin low to high bytes from the anchor (at: its place in each
    text).  All of them hold the same stretch of text around the anchor, so only snippets equal
    in that stretch can share one; where too many are, each half of the range has a longer
    stretch.  Of equal cuts the first stays and the others' windows are lost.
    """
    alike: dict[bytes, list] = {}
    for n in members:
        a, z = max(low, -at[n]), min(high, len(texts[n]) - width - at[n])
        if a <= z:
            alike.setdefault(texts[n][at[n] + high : at[n] + low + width], []).append((n, at[n] + a, at[n] + z))
    for same in alike.values():
        if len(same) < 2:
            continue
        first: dict[tuple, int] = {}
        for n, a, z in sorted(same, key=lambda x: place[x[0]]):
            if first.setdefault((texts[n][a : z + width], at[n] - a), n) != n:
                lost.append((n, a, z + 1))
        if len(first) < 2:
            continue
        if low == high or sum(len(cut) for cut, _ in first) <= BATCH:
            yield [(n, at[n] - back, cut) for (cut, back), n in first.items()]
        else:
            middle = (low + high) // 2
            for half in ((low, middle), (middle + 1, high)):
                yield from windows_apart(list(first.values()), texts, at, place, *half, width, lost)


def shared_windows(texts: list[bytes], anchor: list[int], at: list[int], place: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(text number, first, end) of window starts of texts that a text of smaller place has too.

    Texts are sorted in batches of whole anchors; an anchor of more than a batch is split first.
    """
    lost: list[tuple[int, int, int]] = []

    def look(batch: list[tuple[int, int, bytes]]) -> None:
        found = earlier_windows([cut for _, _, cut in batch], place[[n for n, _, _ in batch]], width)
        lost.extend((batch[i][0], batch[i][1] + a, batch[i][1] + z) for i, a, z in found)

    batch: list[tuple[int, int, bytes]] = []
    size = 0
    for _, own in groupby(sorted(range(len(texts)), key=anchor.__getitem__), key=anchor.__getitem__):
        members = list(own)
        # A text shares no window with itself: in each, the anchor has another place.
        if len(members) == 1:
            continue
        mine = sum(len(texts[n]) for n in members)
        if mine > BATCH:
            for part in windows_apart(members, texts, at, place, ANCHOR - width, 0, width, lost):
                look(part)
            continue
        batch += [(n, 0, texts[n]) for n in members]
        size += mine
        if size > BATCH:
            look(batch)
            batch, size = [], 0
    if batch:
        look(batch)
    return lost


def sorted_of(width: int):
    def answers(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        number: dict[bytes, int] = {}
        first: list[tuple] = []
        anchor: list[int] = []
        at: list[int] = []
        sent: list[list[int]] = []
        for k in range(len(blocks)):
            row = {c: table.column(c)[k].as_py() for c in ("anchors", "places", "bytes", "lengths", "docs", "starts")}
            end = np.cumsum(np.frombuffer(row["lengths"], np.uint32)).tolist()
            columns = [np.frombuffer(row[c], kind).tolist() for c, kind in (("docs", np.int64), ("starts", np.int64), ("anchors", np.uint64), ("places", np.uint16))]
            own = []
            for i, (a, z, d, s, h, p) in enumerate(zip([0, *end[:-1]], end, *columns, strict=True)):
                n = number.setdefault(row["bytes"][a:z], len(first))
                if n == len(first):
                    first.append((d, s, blocks[k], i, k))
                    anchor.append(h)
                    at.append(p)
                elif (d, s, blocks[k], i, k) < first[n]:
                    first[n] = (d, s, blocks[k], i, k)
                own.append(n)
            sent.append(own)
        place = np.empty(len(first), np.int64)
        place[sorted(range(len(first)), key=first.__getitem__)] = np.arange(len(first))
        cut: list[list[tuple]] = [[] for _ in blocks]
        for n, a, z in shared_windows(list(number), anchor, at, place, width):
            *_, i, k = first[n]
            cut[k].append((i, a, z))
        rows = []
        for k, block in enumerate(blocks):
            gone = [i for i, n in enumerate(sent[k]) if first[n][3:] != (i, k)]
            if gone:
                rows.append((block, LOST, shard, np.array(gone, np.int64).tobytes()))
            if cut[k]:
                rows.append((block, CUT, shard, np.array(cut[k], np.int64).tobytes()))
        return reply(rows)

    return answers


def kept_of(width: int, shards: int, whole: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    def kept(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", kind)])
            return schema.append(table.schema.field("rest")).empty_table()
        ids, texts, order = read_block(table)
        base = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        step = np.zeros(base[-1] + 1, np.int32)
        found = snippets(texts, replies, width, shards)
        lost = {(s, i) for k, s, d in zip(*(replies.column(c).to_pylist() for c in ("kind", "shard", "data")), strict=True) if k == LOST for i in np.frombuffer(d, np.int64).tolist()}
        starts, stops = [], []
        for s, items in found.items():
            for i, (_, places) in enumerate(items):
                for d, a, z, *_ in places if (s, i) in lost else places[1:]:
                    starts.append(base[d] + a)
                    stops.append(base[d] + z + width)
        for k, s, d in zip(*(replies.column(c).to_pylist() for c in ("kind", "shard", "data")), strict=True):
            if k == CUT:
                for i, a, z in np.frombuffer(d, np.int64).reshape(-1, 3).tolist():
                    doc, begin = found[s][i][1][0][:2]
                    starts.append(base[doc] + begin + a)
                    stops.append(base[doc] + begin + z - 1 + width)
        np.add.at(step, np.array(starts, np.int64), 1)
        np.subtract.at(step, np.array(stops, np.int64), 1)
        covered = np.cumsum(step[:-1]) > 0
        removed, left, spans = [], [], []
        for i, t in enumerate(texts):
            mine = covered[base[i] : base[i + 1]]
            n = int(np.count_nonzero(mine))
            removed.append(n)
            a, z = runs(mine) if n else ((), ())
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, z, strict=True)])
            stays = np.frombuffer(t, np.uint8)[~mine].tobytes() if n else t
            left.append(stays.decode("utf-8", "ignore").encode() if whole and n else stays)
        return pa.table({"doc_id": id_array(ids), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(left, pa.binary()), "spans": pa.array(spans, kind), "rest": table.column("rest").take(pa.array(order))})

    return kept


def suffix_dedup(docs: DataFrame, width: int = WIDTH, hot: int = HOT, keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Removes each byte covered by a string of width bytes that starts earlier too.

    Earlier is in a smaller doc_id, or in the same document at a smaller place; overlapping
    strings count, and all are judged on the input.  docs has doc_id and text; of other
    columns, those named in keep come back as they were, and the rest are left out.  width is 64
    at least, and an anchor of hot places is cut into parts.  Returns doc_id, n_bytes, n_removed,
    kept (the bytes that stay; a cut can fall inside a character, and with whole what it leaves of
    one goes too) and spans (maximal removed runs of bytes, end excluded).

    A null text counts as empty and keeps nothing.  A null doc_id counts as larger than any
    other and stays null; of several rows with one doc_id each gives a row, and of the places of
    a string in them the earliest keeps it (at one start, one of them).  An empty table gives an
    empty one.  A very long text is one block by itself and takes some 60 bytes for each of its own.
    """
    total = text_bytes(docs)
    names = keep or []
    # A struct can't be without fields.
    blocks = in_blocks(docs, total, keep=[F.struct(*(F.col(f"`{c}`") for c in names), *([] if names else [F.lit(0).alias("none")])).alias("rest")])
    out = StructType.fromDDL(OUT).add("rest", blocks.schema["rest"].dataType)
    shards = bucket_count(total, SHARD_BYTES)
    by_block = grouped(blocks, "block", total)
    entries = by_block.applyInArrow(tidy(entries_of(width, bucket_count(total // 4))), ENTRIES)
    known = grouped(entries, "bucket", total // 2).applyInArrow(tidy(repeated_of(hot)), REPLIES)
    sent = by_block.cogroup(known.groupBy("block")).applyInArrow(tidy_pair(snippets_of(width, shards)), SNIPPETS)
    answers = grouped(sent, "shard", total).applyInArrow(tidy(sorted_of(width)), REPLIES)
    return by_block.cogroup(known.unionAll(answers).groupBy("block")).applyInArrow(tidy_pair(kept_of(width, shards, whole)), out).select("doc_id", "n_bytes", "n_removed", "kept", "spans", *(F.col("rest")[c].alias(c) for c in names))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
