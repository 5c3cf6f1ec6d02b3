"""Exact top-k search by inner product over an impact-ordered index.

Candidates are dealt into shards of a bounded size.  A shard's index has, for each dimension,
posting segments of vectors whose component falls in one step of its range.  A query takes the
segments of all dimensions in descending order of the impact they can have over the least
possible one, adds up exact contributions, and stops only when at most a few vectors can still
be among the best k: their sum so far, with the most that the segments not yet read can add,
has to reach the k-th best sum that is certain.  Those few get their exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.session import kept

K = 10
SHARD = 16384
QUERIES = 256
LEVELS = 4
#: Segments between two looks at the bounds, and vectors that may be left for exact scores beside k.
EVERY = 32
FEW = 64

PACKED = "part long, ids binary, rows binary, data binary, width int"
FOUND = "query_row long, query_id long, vec_id long, row long, score long"


def packed(table: pa.Table) -> pa.Table:
    """One row for each group: ids, row numbers and components, shorter vectors filled with zeros."""
    ids, rows = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "row"))
    vectors = table.column("v").to_pylist()
    width = max(map(len, vectors))
    data = np.zeros((len(ids), width), np.int64)
    for i, v in enumerate(vectors):
        data[i, : len(v)] = v
    order = np.lexsort((rows, ids))
    binary = lambda x: pa.array([x[order].tobytes()], pa.binary())
    return pa.table({"part": table.column("part")[:1], "ids": binary(ids), "rows": binary(rows), "data": binary(data), "width": pa.array([width], pa.int32())})


class Index:
    """Posting segments of a shard: for each dimension and level the vectors and the range of their components."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, data: np.ndarray, levels: int = LEVELS):
        self.ids, self.numbers, self.data = ids, numbers, data
        low, high = data.min(axis=0), data.max(axis=0)
        level = (data - low) * levels // (high - low + 1)
        self.dim, self.rows, self.values, self.low, self.high = [], [], [], [], []
        for d in range(data.shape[1]):
            order = np.argsort(level[:, d], kind="stable")
            edge = np.searchsorted(level[order, d], np.arange(levels + 1))
            for a, z in zip(edge, edge[1:], strict=False):
                if a < z:
                    rows = np.sort(order[a:z])
                    self.dim.append(d)
                    self.rows.append(rows)
                    self.values.append(data[rows, d])
                    self.low.append(int(self.values[-1].min()))
                    self.high.append(int(self.values[-1].max()))
        self.dim, self.low, self.high = (np.array(x, np.int64) for x in (self.dim, self.low, self.high))
        self.least, self.most = low, high

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best but the row numbered own, ties to the smaller id, then row number; all exact."""
        n, dims = self.data.shape
        width = min(dims, len(query))
        q = np.zeros(dims, np.int64)
        q[:width] = query[:width]
        base = np.where(q > 0, q * self.least, q * self.most)
        impact = np.maximum(q[self.dim] * self.low, q[self.dim] * self.high) - base[self.dim]
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        total, unseen = np.zeros(n, np.int64), np.ones((dims, n), np.float32)
        # The impact of each dimension's next segment; nothing is added where all are alike.
        coming = np.zeros(dims, np.int64)
        np.maximum.at(coming, self.dim, impact)
        candidates = np.arange(n)
        out = self.numbers == own
        for at in range(0, len(order), EVERY):
            for s in order[at : at + EVERY].tolist():
                d, rows = self.dim[s], self.rows[s]
                total[rows] += q[d] * self.values[s] - base[d]
                unseen[d, rows] = 0
            coming[:] = 0
            np.maximum.at(coming, self.dim[order[at + EVERY :]], impact[order[at + EVERY :]])
            certain = np.where(out, -1, total)
            if n - out.sum() > k:
                kth = np.partition(certain, n - k)[n - k]
                # Rounded up, so that single precision keeps the proof.
                more = (coming * 1.001 + (coming > 0)).astype(np.float32) @ unseen
                candidates = np.flatnonzero(~out & (total + more >= kth))
                if len(candidates) <= k + FEW:
                    break
        candidates = candidates[~out[candidates]]
        score = self.data[candidates] @ q
        best = np.lexsort((self.numbers[candidates], self.ids[candidates], -score))[:k]
        return candidates[best], score[best]


def searched(k: int):
    def run(batches):
        last, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if last != row["part"]:
                    ids, numbers = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows"))
                    last, index = row["part"], Index(ids, numbers, np.frombuffer(row["data"], np.int64).reshape(len(ids), row["width"]))
                asked, own = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "q_rows"))
                vectors = np.frombuffer(row["q_data"], np.int64).reshape(len(asked), row["q_width"])
                out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []}
                for q, number, v in zip(asked.tolist(), own.tolist(), vectors, strict=True):
                    rows, scores = index.search(v, number, k)
                    out["query_row"] += [number] * len(rows)
                    out["query_id"] += [q] * len(rows)
                    out["vec_id"] += index.ids[rows].tolist()
                    out["row"] += index.numbers[rows].tolist()
                    out["score"] += scores.tolist()
                yield pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in out]))

    return run


def integers(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """row (a number of its own), vec_id and v = floor(1024 * x) of the vectors whose components are all finite.

    Rows with a null vec_id are left out, vectors without components stay, and each of several
    rows of one vec_id stays.
    """
    x = F.col(vec).cast("array<double>")
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    good = vectors.filter(F.col(vec).isNotNull() & F.col("vec_id").isNotNull() & finite)
    v = F.transform(x, lambda y: F.floor(y * 1024).cast("long"))
    return kept(good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest integer inner products of each query.

    Both have row, vec_id and v (array of long, of components below 2**31 and products that fit a
    long), as integers gives them: a row's number is its own in both, and the candidate of the
    query's number is left out.  Of several rows of one vec_id each is a candidate, and each a
    query with a ranking of its own.  Equal scores go to the smaller vec_id.  Shorter vectors
    count as filled with zeros.  Without queries or candidates the result is empty; other
    columns are left out.
    """
    v, asked = (df.select("row", "vec_id", "v") for df in (vectors, queries))
    shards = max(1, -(-v.count() // SHARD))
    part = lambda df, n: df.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n))).groupBy("part").applyInArrow(packed, PACKED)
    names = [F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "data", "width")]
    blocks = part(asked, max(1, -(-asked.count() // QUERIES))).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("part"))
    found = part(v, shards).join(blocks, "part").mapInArrow(searched(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.filter(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 10
"""
