"""Exact top-k inner products with a pivot table.

Distances to the pivots bound |q - x| from below, and so q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 from above; the product of
the norms bounds it as well. Candidates of a block are evaluated in the order of the smaller bound until the k-th score
beats the next one. Queries and
candidates meet in a grid of blocks of bounded size: a query is sent once to each candidate block, a candidate once to
each query block. Pivots are spread: each is the farthest of a sample from those before it.

Vectors that are null, or hold null or non-finite components, take no part; vectors of different lengths never meet; equal
rows count as rows, but a row never meets its own id; an id with several vectors is a query for each of them (equal ones
count once), ranked apart. Scores are exact; those beyond 64 bits are cut to the largest or smallest of them. Fewer than k
candidates give fewer rows; an empty table gives none. Other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

FOUND = "qn long, query_id long, vec_id long, score long"


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; doubles hold them while norms stay below 2^26."""
    if exact:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x], np.int64)


def best(ids: np.ndarray, x: np.ndarray, dist: np.ndarray, qid: int, q: np.ndarray, qdist: np.ndarray, norms: np.ndarray, k: int, step: int = 256):
    """Up to k scores and ids of one query in one block, best first, ties to the smaller id; and how many were evaluated."""
    qq = float(q @ q)
    low = np.abs(dist - qdist).max(axis=1) if dist.shape[1] else np.zeros(len(ids))
    bound = np.minimum((norms + qq - np.square(low)) / 2, np.sqrt(norms * qq))
    bound += 1e-9 * (norms + qq) + 1e-6  # rounding never hides a candidate
    order = np.argsort(-bound, kind="stable")
    got_s, got_i, seen = np.empty(0, np.int64), np.empty(0, np.int64), 0
    exact = max(qq, float(norms.max(initial=0.0))) < 2.0**52
    for at in range(0, len(order), step):
        if len(got_s) == k and got_s[-1] > bound[order[at]]:
            break
        part = order[at : at + step]
        seen += len(part)
        part = part[ids[part] != qid]
        s, i = np.concatenate([got_s, products(x[part], q, exact)]), np.concatenate([got_i, ids[part]])
        top = np.lexsort((i, -s.astype(object) if not exact else -s))[:k]
        got_s, got_i = s[top], i[top]
    return got_s, got_i, seen


def spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of sample, each the farthest from those before it."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        far = np.minimum(far, np.square(sample - sample[chosen[-1]]).sum(axis=1))
        chosen.append(int(far.argmax()))
    return sample[np.unique(chosen)]


def topk(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, pivots: int = 64, sample: int = 1024, block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score for every row where ``is_query`` holds."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    v = vectors.select("vec_id", "embedding", is_query.alias("q")).where(ok & F.col("vec_id").isNotNull())
    v = v.select("vec_id", "q", F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("x"))
    drawn = {}
    for r in v.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).collect():  # sample rows at most
        drawn.setdefault(len(r["x"]), []).append(r["x"])
    table_ = {n: spread(np.array(rows, float), pivots) for n, rows in drawn.items()}

    def distances(batches):
        for b in batches:
            out = []
            for x in b["x"]:
                p = table_.get(len(x))
                out.append(np.sqrt(np.square(p - np.asarray(x)).sum(axis=1)) if p is not None else np.empty(0))
            yield b.assign(d=out)

    v = cut(v.mapInPandas(distances, "vec_id long, q boolean, x array<double>, d array<double>"))
    asked = v.where("q").dropDuplicates(["vec_id", "x"])
    asked = cut(asked.select(F.monotonically_increasing_id().alias("qn"), "vec_id", "x", "d"))
    nc, ng = max(1, -(-v.count() // block)), max(1, -(-asked.count() // block))
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    c = v.select("vec_id", "x", "d", F.size("x").alias("dim"), F.pmod(F.xxhash64("vec_id", "x"), F.lit(nc)).alias("cb"), cells(ng).alias("qb"))
    q = asked.select("qn", "vec_id", "x", "d", F.size("x").alias("dim"), cells(nc).alias("cb"), F.pmod(F.xxhash64("vec_id", "x", F.lit(1)), F.lit(ng)).alias("qb"))

    def meet(cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cand) and len(ask):
            ids, x = cand["vec_id"].to_numpy(), np.vstack(cand["x"].to_list())
            dist = np.array(cand["d"].to_list(), dtype=float).reshape(len(ids), -1)
            norms = np.square(x).sum(axis=1)
            for qn, qid, qx, qd in zip(ask["qn"], ask["vec_id"], ask["x"], ask["d"], strict=True):
                s, i, _ = best(ids, x, dist, qid, np.asarray(qx), np.asarray(qd, dtype=float), norms, k)
                out += [(qn, qid, int(b), int(a)) for a, b in zip(s, i, strict=True)]
        return pd.DataFrame(out, columns=["qn", "query_id", "vec_id", "score"]).astype("int64")

    by = ["dim", "cb", "qb"]
    found = c.groupBy(*by).cogroup(q.groupBy(*by)).applyInPandas(meet, FOUND)
    order = Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 256)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
