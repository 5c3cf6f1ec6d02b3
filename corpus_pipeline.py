"""From raw documents to token ids: language, near copies, repeated passages, benchmark copies, encoding."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.session import kept, shared_folder
from cairn.llm.blocks import unused
from cairn.llm.bpe import bpe
from cairn.llm.decontaminate import clean
from cairn.llm.langid import accepted, fit
from cairn.llm.near_copies import SENT, near_copies
from cairn.llm.suffix_dedup import suffix_dedup


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts that are null, have no letter, or are in no language with a score of 0.5; and rows without doc_id."""
    named = docs.filter(F.col("doc_id").isNotNull())
    return accepted(named, fit(named))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row least by doc_id, then by a hash of its text.

    Rows that share a doc_id but no near text each stay.  Texts without words are one group.
    """
    near = kept(near_copies(docs))
    stay = kept(near.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("m.doc_id", "m.row"))
    if stay.count() <= SENT:
        stay = F.broadcast(stay)
    name = unused("row", docs)
    rows = docs.withColumn(name, F.xxhash64("text"))
    same = F.col("s.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("s.row") == F.col(f"d.{name}"))
    rows = rows.alias("d").join(stay.alias("s"), same, "left_semi")
    if near.groupBy("doc_id", "row").count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", name])
    return rows.select([F.col(f"`{c}`") for c in docs.columns])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that an earlier place has; what a cut leaves of a character goes too.

    n_chars, where there is one, becomes that of the new text.  A null text becomes an empty one.
    """
    others = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    numbered = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in others.items()))
    kept = suffix_dedup(numbered, keep=list(others.values()), whole=True)
    own = {"text": F.col("kept").cast("string").alias("text"), "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")}
    kept = kept.select(*(own[c] if c in own else F.col(others[c]).alias(c) for c in docs.columns))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold an item of the benchmark."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the bytes that they decode to."""
    return bpe(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("near copies", one_of_each),
    ("repeated passages", without_repeats),
    ("benchmark copies", without_benchmark),
    ("encoding", encoded),
]

#: Training a network, walking links and encoding are not for SQL; tests/llm holds near copies and repeats against brute force, the whole run by properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
