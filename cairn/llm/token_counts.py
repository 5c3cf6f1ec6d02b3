"""Token counts: documents of flat token files, found by their end-of-document identifiers.

A token file is token identifiers of two bytes each, one document after another, each followed
by an end-of-document identifier; nothing says where a document begins.  Files are scanned in
blocks: each finds its separators by one comparison of the whole array, and reports the lengths
between them and what lies before the first and after the last.  A prefix scan over the block
summaries of a file then numbers the documents and carries the open length of each block to the
next separator, in however distant a block it is.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.session import shared_folder

END = 65535
BLOCK_BYTES = 1 << 20

BLOCKS = "file long, block long, content binary, doc_ids array<long>"
SUMMARY = "file long, block long, lengths array<long>, tail long"


def token_file_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, content) of whole files given as (file, content), such as Spark's binaryFile source reads."""
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / block_bytes)).cast("long")
    each = files.select("file", "content", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    return each.select("file", "block", F.expr(f"substring(content, cast(block * {block_bytes} + 1 as int), {block_bytes})").alias("content"))


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """Per block: the length up to each separator, and the tokens after the last one."""

    def run(batches):
        for batch in batches:
            lengths, tails = [], []
            for content in batch.column(2).to_pylist():
                tokens = np.frombuffer(content or b"", "<u2")
                at = np.flatnonzero(tokens == end)
                lengths.append(np.diff(np.concatenate(([-1], at))) - 1)
                tails.append(len(tokens) - (at[-1] + 1 if len(at) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.list_(pa.int64())), pa.array(tails, pa.int64())], ["file", "block", "lengths", "tail"])

    return blocks.select("file", "block", "content").mapInArrow(run, SUMMARY)


def token_counts(blocks: DataFrame, end: int = END) -> DataFrame:
    """file, ordinal (from 0 in its file) and n_tokens of every document, separators not counted.

    blocks has file and block (numbers from 0, in order of the file) and content, two bytes a
    token, low byte first; a block ends between tokens.  Other columns are left out.  Tokens
    after a file's last separator are a last document without an end; an empty tail is none.
    A null or empty content has no tokens, empty documents count with 0, and an empty table
    gives an empty result.
    """
    s = scan(blocks, end)
    over = Window.partitionBy("file").orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("lengths")
    s = s.withColumn("done", F.coalesce(F.sum(n).over(before), F.lit(0)))
    # What is open when a block begins: the tails since the last block that has a separator.
    s = s.withColumn("tails", F.sum("tail").over(over))
    base = F.coalesce(F.last(F.when(n > 0, F.col("tails") - F.col("tail")), ignorenulls=True).over(before), F.lit(0))
    s = s.withColumn("open", F.col("tails") - F.col("tail") - base)
    s = s.withColumn("last", F.lead("block").over(over).isNull())
    closed = s.select("file", "done", "open", F.posexplode("lengths").alias("i", "size")).select("file", (F.col("done") + F.col("i")).alias("ordinal"), (F.col("size") + F.when(F.col("i") == 0, F.col("open")).otherwise(0)).alias("n_tokens"))
    rest = F.when(n > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail"))
    unended = s.filter(F.col("last")).select("file", (F.col("done") + n).alias("ordinal"), rest.alias("n_tokens")).filter("n_tokens > 0")
    return closed.unionAll(unended)


def word_tokens(text: bytes, vocabulary: int = END) -> np.ndarray:
    """A token for each word: its hash below the separator's number."""
    words = text.split()
    return (np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % vocabulary).astype("<u2")


def write_tokens(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Token files of docs, one for each partition, as blocks in a Parquet folder, with the ids of the documents that end in each."""

    def run(batches):
        file = TaskContext.get().partitionId()
        held, size, ids, block = [], 0, [], 0

        def row(content, done):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([content], pa.binary()), pa.array([done], pa.list_(pa.int64()))], ["file", "block", "content", "doc_ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.append(word_tokens(text or b"").tobytes() + END.to_bytes(2, "little"))
                size += len(held[-1])
                while size > block_bytes:
                    whole = b"".join(held)
                    yield row(whole[:block_bytes], ids)
                    held, size, ids, block = [whole[block_bytes:]], size - block_bytes, [], block + 1
                ids.append(doc)
        if size or ids:
            yield row(b"".join(held), ids)

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS).write.mode("overwrite").parquet(path)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as token files to the shared folder, scans those, and names the documents by the writer's list."""
    path = f"{shared_folder(spark)}/op5-tokens-{uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    blocks = spark.read.parquet(path)
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    listed = blocks.select("file", "block", "doc_ids").withColumn("done", F.coalesce(F.sum(F.size("doc_ids")).over(over), F.lit(0)))
    names = listed.select("file", "done", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("done") + F.col("i")).alias("ordinal"), "doc_id")
    return names.join(token_counts(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")


ORACLE = r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
"""
