"""Alignment of two tokenizers by inverted pair bitmaps.

A token of one tokenizer and a token of the other are linked where they share bytes of a text.
For each pair of tokens, a compressed bitmap says which documents hold the pair linked, and
planes of further bits say how often.  Documents are numbered within a block of a few megabytes;
a block reduces its own repeats, and the population counts of all blocks, whose documents are
different bits, add up to the number of documents of a pair.  The counts then go back to the
blocks, whose postings turn them into scores of documents.

Texts are cut before single spaces that stand between a character other than a space and one
other than white space.  Neither tokenizer joins what such a place parts, so a stretch of text
between two of them has the same tokens in all documents, and is encoded and aligned once; the
bitmap of a pair is what the bitmaps of all stretches that hold it give when merged.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.session import shared_folder
from cairn.llm.blocks import staying, tidied, tidy_pair
from cairn.llm.bpe import parts

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of a block, and documents of one, so that a number of a document takes two bytes.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 16
#: Text that is cut at once, and different stretches that a worker remembers when a block ends.
PART_BYTES, PART_DOCS, STRETCHES = 1 << 20, 512, 1 << 18
#: Documents of a block for each of a pair's from which a list of two-byte numbers is shorter than a bitmap.
SPARSE = 16
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
DOCUMENT = pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string())])
INDEX = "block long, pair long, size int, documents array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>>, bits binary"


def byte_level(tokens: list[str]) -> list[bytes]:
    """What byte-level tokens stand for: printable bytes are their own characters, the others those from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    to = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
    return [bytes(to[c] for c in t) if all(c in to for c in t) else t.encode() for t in tokens]


def pieces(tokens: list[str]) -> list[bytes]:
    """What pieces stand for: U+2581 is a space, <0xHH> a byte."""
    return [bytes([int(t[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", t) else t.replace("▁", " ").encode() for t in tokens]


class Stretches:
    """Tokens, groups and links of stretches of text, by number, in arrays."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes = byte_level([self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())])
        self.b_bytes = pieces([self.b.id_to_piece(i) for i in range(self.b.get_piece_size())])
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # A token's decimal number and what follows it: a comma, or the end of its side of the group.
        sides = [(len(self.a_bytes), b",|"), (len(self.b_bytes), b",;")]
        self.written = [b"%d%c" % (i, end) for n, ends in sides for i in range(n) for end in ends]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.sums = np.empty((4, 0), np.int64)
        self.good = np.empty(0, bool)
        self.pairs = np.empty(0, np.int64)
        self.start = np.zeros(1, np.int64)

    def numbers(self, found: list[str]) -> np.ndarray:
        new = [s for s in dict.fromkeys(found) if s not in self.number]
        if new:
            self.learn(new)
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))

    def learn(self, new: list[str]) -> None:
        """Encodes and aligns all new stretches as one row of bytes; one that a tokenizer does not give back has no tokens."""
        whole = [(" " + s).encode() for s in new]
        a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in new], add_special_tokens=False)]
        b = self.b.encode(new, num_threads=1)
        same = [w == b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) for w, x, y in zip(whole, a, b, strict=True)]
        a, b = ([x if s else () for x, s in zip(ids, same, strict=True)] for ids in (a, b))
        n_a, n_b = (np.array(list(map(len, ids)), np.int64) for ids in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
        end = np.cumsum([len(w) if s else 0 for w, s in zip(whole, same, strict=True)])
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        # Each link is a run of bytes between two neighbouring ends, of either side.
        ends = np.union1d(end_a, end_b)
        links = (flat_a[np.searchsorted(end_a, ends)] << 32) | flat_b[np.searchsorted(end_b, ends)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        n_groups = np.diff(np.searchsorted(both, end, side="right"), prepend=0)
        n_links = np.diff(np.searchsorted(ends, end, side="right"), prepend=0)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        codes = np.empty(len(flat_a) + len(flat_b), np.int64)
        codes[np.arange(len(flat_a)) + np.searchsorted(group_b, group_a)] = 2 * flat_a + (both[group_a] == end_a)
        codes[np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * (len(self.a_bytes) + flat_b) + (both[group_b] == end_b)
        written = list(map(self.written.__getitem__, codes.tolist()))
        stop = np.cumsum(n_a + n_b).tolist()
        self.groups += [b"".join(written[x:y]) for x, y in zip([0, *stop], stop, strict=False)]
        self.number.update(zip(new, range(len(self.good), len(self.good) + len(new)), strict=True))
        self.sums = np.concatenate((self.sums, (n_a, n_b, n_groups, n_links)), axis=1)
        self.good = np.concatenate((self.good, same))
        self.pairs = np.concatenate((self.pairs, links))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(n_links)))


def long_parts(text: str, size: int = PART_BYTES):
    """The text in parts that begin and end where it may be cut, each of some more than size characters."""
    at = 0
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class PairBitmaps:
    """For each pair of tokens, in order, the documents that hold it linked, and how often.

    pairs and sizes have an entry for each pair; docs and times one for each pair and document.
    """

    def __init__(self, pairs: np.ndarray, sizes: np.ndarray, docs: np.ndarray, times: np.ndarray):
        self.pairs, self.sizes, self.docs, self.times = pairs, sizes, docs, times

    @classmethod
    def merged(cls, pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> PairBitmaps:
        """Of postings in any order: those of one pair and document are one bit, and their times are added."""
        pairs, number = np.unique(pair, return_inverse=True)
        key = (number.astype(np.int64) << 16) | doc
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        added = np.add.reduceat(times[order], first) if len(first) else times[:0]
        key = key[first]
        return cls(pairs, np.bincount(key >> 16, minlength=len(pairs)), key & 0xFFFF, added)

    def pack(self, docs: int) -> bytes:
        """Bitmaps, or lists of numbers where these are shorter, then the planes of the times less one; compressed."""
        listed = self.sizes * SPARSE < docs
        each = np.repeat(listed, self.sizes)
        row = np.repeat(np.cumsum(~listed) - 1, self.sizes)[~each]
        bits = np.zeros((int((~listed).sum()), docs), bool)
        bits[row, self.docs[~each]] = True
        more = self.times - 1
        planes = [np.packbits((more >> k) & 1 > 0) for k in range(int(more.max(initial=0)).bit_length())]
        head = np.array([docs, len(self.pairs), len(self.docs), len(planes)], np.int64)
        raw = b"".join(x.tobytes() for x in (head, self.pairs.astype(np.int64), self.sizes.astype(np.int32), self.docs[each].astype(np.uint16), np.packbits(bits, axis=1), *planes))
        return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)

    @classmethod
    def unpack(cls, packed: bytes) -> PairBitmaps:
        raw = memoryview(pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True))
        at = 0

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        docs, n_pairs, n, n_planes = take(4, np.int64).tolist()
        pairs, sizes = take(n_pairs, np.int64), take(n_pairs, np.int32).astype(np.int64)
        listed = sizes * SPARSE < docs
        each = np.repeat(listed, sizes)
        own = np.empty(n, np.int64)
        own[each] = take(int(sizes[listed].sum()), np.uint16)
        wide = -(-docs // 8)
        rows = int((~listed).sum())
        bits = take(rows * wide, np.uint8).reshape(rows, wide)
        own[~each] = np.nonzero(np.unpackbits(bits, axis=1, count=docs))[1]
        times = np.ones(n, np.int64)
        for k in range(n_planes):
            times += np.unpackbits(take(-(-n // 8), np.uint8), count=n).astype(np.int64) << k
        return cls(pairs, sizes, own, times)

    def links(self) -> np.ndarray:
        """How often each pair is linked: a population count of each plane, weighted."""
        edge = np.concatenate(([0], np.cumsum(self.sizes)))
        return np.diff(np.concatenate(([0], np.cumsum(self.times)))[edge])


class Block:
    """Documents being aligned, and the postings of their stretches."""

    def __init__(self, known: Stretches):
        self.known, self.size, self.rows, self.postings = known, 0, [], []

    def add(self, ids: list, texts: list[str | None]) -> None:
        """Aligns texts, a part of them at a time."""
        at = len(self.rows)
        self.rows += [[i, 0, 0, 0, 0, ""] for i in ids]
        for k, text in enumerate(texts):
            if text and len(text) > PART_BYTES:
                hashed, good = hashlib.sha256(), True
                for n, part in enumerate(long_parts(text)):
                    (written,) = self.part([at + k], [part])
                    good = good and written is not None
                    hashed.update(b";" * (n > 0) + (written or b""))
                self.end(at + k, hashed if good else None)
        short = [k for k, text in enumerate(texts) if text and len(text) <= PART_BYTES]
        for k, written in zip(short, self.part([at + k for k in short], [texts[k] for k in short]), strict=True):
            self.end(at + k, None if written is None else hashlib.sha256(written))

    def end(self, row: int, hashed) -> None:
        self.rows[row][5] = hashed and hashed.hexdigest()
        if hashed is None:
            self.rows[row][1:] = [0, 0, 0, 0, ""]
            self.postings = [(doc[keep], s[keep], n[keep]) for doc, s, n in self.postings for keep in [doc != row]]

    def part(self, rows: list[int], texts: list[str]) -> list[bytes | None]:
        """Counts the tokens of parts of documents, and gives their groups; None for one that a tokenizer does not give back."""
        each = list(map(CUT.split, texts))
        self.size += sum(map(len, texts))
        found = self.known.numbers(list(chain.from_iterable(each)))
        edge = np.cumsum([0, *map(len, each)]).tolist()
        out = []
        for row, x, y in zip(rows, edge, edge[1:], strict=False):
            own = found[x:y]
            if not self.known.good[own].all():
                out.append(None)
                continue
            for c, n in enumerate(self.known.sums[:, own].sum(axis=1).tolist()):
                self.rows[row][1 + c] += n
            out.append(b"".join(map(self.known.groups.__getitem__, own.tolist()))[:-1])
            stretch, times = np.unique(own, return_counts=True)
            self.postings.append((np.full(len(stretch), row), stretch, times))
        return out

    def bitmaps(self) -> PairBitmaps:
        doc, stretch, times = (np.concatenate(x) if self.postings else np.empty(0, np.int64) for x in (list(zip(*self.postings, strict=True)) or [()] * 3))
        first, n = self.known.start[stretch], self.known.sums[3, stretch]
        each = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        return PairBitmaps.merged(self.known.pairs[each], np.repeat(doc, n), np.repeat(times, n))

    def batch(self, number: int) -> pa.RecordBatch:
        """A row for each pair, and one with the documents and all bitmaps."""
        b = self.bitmaps()
        n = len(b.pairs)
        listed = pa.array([[dict(zip(["doc_id", *COUNTS, "groups_sha256"], r, strict=True)) for r in self.rows]], pa.list_(DOCUMENT))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, number, np.int64)),
                pa.concat_arrays([pa.array(b.pairs), pa.nulls(1, pa.int64())]),
                pa.concat_arrays([pa.array(b.sizes.astype(np.int32)), pa.nulls(1, pa.int32())]),
                pa.concat_arrays([pa.nulls(n, listed.type), listed]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([b.pack(len(self.rows))], pa.binary())]),
            ],
            ["block", "pair", "size", "documents", "bits"],
        )


def pair_index(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The inverted index: for each block, a row (block, pair, size) for each pair, and one with documents and bits.

    pair is the first tokenizer's number times 2**32 plus the second's, and size the documents of
    the block that hold it linked.  The two vocabulary files, some two megabytes, go to all tasks.
    """
    with open(a_path or public_tokenizers.path(A_FILE), encoding="utf-8") as f:
        a = json.dumps(json.load(f))
    with open(b_path or public_tokenizers.path(B_FILE), "rb") as f:
        b = f.read()
    held = docs.sparkSession.sparkContext.broadcast((uuid4().hex, a, b))

    def run(batches):
        name, a_json, b_model = held.value
        known = staying(name, lambda: Stretches(a_json, b_model))
        base, count, block = TaskContext.get().partitionId() << 32, 0, Block(known)
        for batch in batches:
            for part in parts(batch, PART_DOCS, PART_BYTES):
                if block.size >= BLOCK_BYTES or len(block.rows) + part.num_rows > BLOCK_DOCS:
                    yield block.batch(base + count)
                    if len(known.good) > STRETCHES:
                        known.clear()
                    count, block = count + 1, Block(known)
                block.add(part.column(0).to_pylist(), part.column(1).to_pylist())
        if block.rows:
            yield block.batch(base + count)
        if len(known.good) > STRETCHES:
            known.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run, keeps=True), INDEX)


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, n_docs, best): documents of all blocks that hold the pair linked, and whether no other pair of its first token has more."""
    counted = index.filter("pair is not null").groupBy("pair").agg(F.sum("size").alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy(F.expr("pair div 4294967296")))
    return counted.select("pair", "n_docs", (F.col("n_docs") == most).alias("best"))


@tidy_pair
def scored(own: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, with the sums of what the counts of its pairs are to their postings."""
    documents = own.column("documents")[0].values
    b = PairBitmaps.unpack(own.column("bits")[0].as_py())
    order = np.argsort(counts.column("pair").to_numpy(), kind="stable")
    n_docs, best = counts.column("n_docs").to_numpy()[order], counts.column("best").to_numpy()[order].astype(np.int64)
    sums = np.zeros((2, len(documents)), np.int64)
    for k, of_pair in enumerate((best, n_docs)):
        np.add.at(sums[k], b.docs, np.repeat(of_pair, b.sizes) * b.times)
    columns = [*documents.flatten()[:5], pa.array(sums[0]), pa.array(sums[1]), documents.flatten()[5]]
    return pa.Table.from_arrays(columns, ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text.

    docs has doc_id and text; other columns are left out.  A text that is null, empty, or not
    given back byte for byte by one of the tokenizers has no tokens: zeros, and an empty string
    for a hash.  Repeated rows and null ids each give a row and count as documents of their own;
    an empty table gives an empty one.  A very long text is aligned in parts of about PART_BYTES,
    or as long as it goes without a place to cut.

    The index is written to the shared folder once and read twice.
    """
    folder = f"{shared_folder(docs.sparkSession)}/alignment-{uuid4().hex}"
    pair_index(docs, a_path, b_path).write.parquet(folder)
    index = docs.sparkSession.read.parquet(folder)
    counts = pair_counts(index)
    asked = index.filter("pair is not null").select("block", "pair").join(counts, "pair").select(F.col("block").alias("of"), "pair", "n_docs", "best")
    own = index.filter("documents is not null").select("block", "documents", "bits")
    return own.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
