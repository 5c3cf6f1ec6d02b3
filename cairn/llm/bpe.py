"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

A vocabulary's tokens, their bytes read as Latin-1 characters, form an Aho-Corasick automaton
that finds all tokens in a piece of text in one pass.  A sequence of tokens is what the merges
by rank give if and only if each two neighbours are what the merges give for the two alone.
The encoder goes from left to right with the longest token that is compatible with the one
before it, and on a dead end takes the last one back and tries its next shorter prefix; ends
that have failed are not tried again, so the steps are linear in the text.  Compatibility of
two tokens is worked out once and remembered.
"""

from __future__ import annotations

import base64
from uuid import uuid4

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.blocks import staying, tidied

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Memory of one generation of remembered pieces, what one costs beside its text, and pairs of tokens remembered.
PIECE_BYTES = 48 << 20
PIECE_COST = 200
PAIRS = 1 << 18
#: Text that a task encodes at once.
PART_BYTES = 8 << 20
PATTERN = public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [found[i] for i in range(len(found))]


class Pieces(dict):
    """Tokens of pieces seen before, four bytes each; works out the others.

    There are two generations of at most PIECE_BYTES each.  When the young one is full it
    becomes the old one, and what is asked for again comes back from there.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.size = encoder, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.encoder.piece(word.encode()), np.int32).tobytes()
        self.size += PIECE_COST + len(word) + len(ids)
        if self.size > PIECE_BYTES:
            self.old = dict(self)
            self.clear()
            self.size = PIECE_COST + len(word) + len(ids)
        self[word] = ids
        return ids


class Encoder:
    """Encodes pieces of text; tokens has all single bytes, and a token's number is its rank."""

    def __init__(self, tokens: list[bytes], halves: list[tuple[int, int]] | None = None, pattern: str = PATTERN):
        self.tokens = tokens
        self.sizes = list(map(len, tokens))
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.matches = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.matches.add_word(t.decode("latin-1"), (i, len(t)))
        self.matches.make_automaton()
        self.prefixes: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = dict(enumerate(halves or ()))
        self.fits: dict[int, bool] = {}
        self.known = Pieces(self)

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one (a byte: itself twice)."""
        found = self.halves.get(token)
        if found is None:
            text, found = self.tokens[token], (token, token)
            for at in range(1, len(text)):
                left, right = self.rank.get(text[:at], token), self.rank.get(text[at:], token)
                if left < token and right < token and self.compatible(left, right, token):
                    found = left, right
                    break
            self.halves[token] = found
        return found

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merges, of ranks less than below, leave the two tokens side by side.

        The merges inside each token happen in order of rank; the two would be joined across
        their border if, at some time, the parts that touch there make a token of lower rank
        than the next merge inside.
        """
        pair = left * len(self.tokens) + right
        if below is None and (found := self.fits.get(pair)) is not None:
            return found
        a, b, limit = left, right, len(self.tokens) if below is None else below
        fits = True
        while True:
            joined = self.rank.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit:
                fits = False
                break
            # Undo the later of the two last merges; the left token's comes first on a tie.
            inner_a, inner_b = self.split(a), self.split(b)
            if inner_a[0] == a and inner_b[0] == b:
                break
            if inner_b[0] == b or (inner_a[0] != a and a > b):
                limit, a = a, inner_a[1]
            else:
                limit, b = b + 1, inner_b[0]
        if below is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[pair] = fits
        return fits

    def piece(self, data: bytes) -> list[int]:
        """Token numbers of one piece."""
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        n, sizes, fits, kinds = len(data), self.sizes, self.fits, len(self.tokens)
        # Matches come in order of their ends, so the last one from a start is its longest; a byte always has one.
        longest = [0] * n
        for end, (number, size) in self.matches.iter(data.decode("latin-1")):
            longest[end - size + 1] = number
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            size = sizes[token]
            if not dead[at + size]:
                good = not out or fits.get(out[-1] * kinds + token)
                if good is None:
                    good = self.compatible(out[-1], token)
            else:
                good = False
            if good:
                out.append(token)
                at += size
                if at == n:
                    return out
                token = longest[at]
                continue
            shorter = self.shorter(token)
            if shorter >= 0:
                token = shorter
                continue
            dead[at] = 1
            token = out.pop()
            at -= sizes[token]

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 for a byte."""
        found = self.prefixes.get(token)
        if found is None:
            text = self.tokens[token]
            found = next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), -1)
            self.prefixes[token] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Token numbers of a text, each match of the pattern by itself."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.find(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Tokens, and the two that each is merged of, worked out once for all tasks."""
    own = Encoder(read_ranks(path))
    return own.tokens, [own.split(i) for i in range(len(own.tokens))]


def load(spark: SparkSession, path: str):
    """A name and the vocabulary on all executors: a fixed file of under a megabyte."""
    return spark.sparkContext.broadcast((uuid4().hex, *vocabulary(path)))


def encoder(held) -> Encoder:
    """The worker's encoder of a loaded vocabulary, kept with what it remembers between tasks that encode."""
    name, tokens, halves = held.value
    return staying(name, lambda: Encoder(tokens, halves))


def bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary, the bytes that the ids stand for).

    docs has doc_id and text; other columns are left out.  path is a rank file.  A null or
    empty text gives no ids and no bytes; ids in doc_id may be null or repeat, and each row
    gives a row.  An empty table gives an empty one.  A very long text takes memory in
    proportion to its length: rows go in parts of PART_BYTES of text, or one text.

    A worker keeps one encoder between tasks that encode: at most twice PIECE_BYTES of pieces, and
    PAIRS pairs of tokens.
    """
    held = load(docs.sparkSession, path or public_tokenizers.path(VOCABULARY))

    def run(batches):
        code = encoder(held)
        for batch in batches:
            for part in parts(batch):
                ids = [code.encode(t or "") for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), listed, pa.array(map(code.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run, keeps=True), "doc_id long, ids array<int>, decoded binary")


def parts(batch: pa.RecordBatch, rows: int = 256, part_bytes: int = PART_BYTES):
    """The batch in parts of at most so many rows and bytes of column text (one row at least), which bounds what a task holds at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(sizes, before + part_bytes, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
