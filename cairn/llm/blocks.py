"""Documents dealt into blocks of a few megabytes, the unit in which the text operators work.

A block is a hash class of doc_id and text, so it can be recomputed on any executor, and its size
does not grow with the input: more text makes more blocks, and rows without doc_id or with a
repeated one are spread like others.  What blocks have to tell each other
travels through hash-range buckets as packed arrays, after each block has reduced its own
repeats, so that a key held by a third of all rows costs one entry per block.
"""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
#: Data of one task beyond which an exchange gets more partitions than the session sets.
TASK_BYTES = 64 << 20
#: Stands for a null doc_id inside tasks; it sorts after every other id.
NO_ID = 2**63 - 1


def unused(name: str, docs: DataFrame) -> str:
    """The name, made longer until no column of docs has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of the text column over all rows."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def in_blocks(docs: DataFrame, total: int, block_bytes: int = BLOCK_BYTES, keep: list[Column] | None = None) -> DataFrame:
    """block int, doc_id long, text string (null: empty), and what keep names; other columns are left out."""
    n = max(1, -(-total // block_bytes))
    return docs.select(
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")), F.lit(n)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *(keep or []),
    )


def grouped(df: DataFrame, key: str, nbytes: int) -> GroupedData:
    """df by key, in as many partitions as nbytes of data ask for: the session's number, or more."""
    n = -(-nbytes // TASK_BYTES)
    if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(n, key)
    return df.groupBy(key)


def bucket_count(nbytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-nbytes // bucket_bytes))


def read_block(table: pa.Table) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Ids and UTF-8 texts in the order of doc_id, repeated ids in the order of their texts; and the rows they are from."""
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)
    texts = table.column("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order], order


def id_array(ids: np.ndarray) -> pa.Array:
    """ids with NO_ID as null again."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Positions at which the hash ranges of the buckets begin and end in a sorted array."""
    step = (1 << 64) // buckets + 1
    cuts = np.array([min(step * b, (1 << 64) - 1) for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, cuts), [len(sorted_hashes)])).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on between tasks, and glibc keeps what numpy has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_STAYS: dict[str, object] = {}


def staying(name: str, make):
    """What make gives, kept by the worker for its next tasks until another name is asked for or a task runs that keeps nothing."""
    if name not in _STAYS:
        let_go()
        _STAYS[name] = make()
    return _STAYS[name]


def let_go() -> None:
    """Drops what the worker keeps: any idle worker may take any task, so each would else hold it for good."""
    if _STAYS:
        _STAYS.clear()
        give_back()


def tidy(f):
    """f for one group of rows, without what the worker kept, giving memory back after it."""

    @wraps(f)
    def one(table: pa.Table) -> pa.Table:
        let_go()
        try:
            return f(table)
        finally:
            give_back()

    return one


def tidy_pair(f):
    """The same for the two sides of a cogroup."""

    @wraps(f)
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        let_go()
        try:
            return f(left, right)
        finally:
            give_back()

    return both


def tidied(f, keeps: bool = False):
    """The same for a function from batches to batches, after the last one; one that keeps something says so."""

    @wraps(f)
    def run(batches):
        if not keeps:
            let_go()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run
