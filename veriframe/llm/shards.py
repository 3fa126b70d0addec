"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Rows fall into source partitions by a hash. Only the partitions' counts reach the driver; it draws how
many rows of each partition go to each shard (multivariate hypergeometric, so the whole is a uniform
shuffle and shard sizes differ by at most one). Each partition is permuted locally and cut by its matrix
row; after the exchange each shard is permuted again by scattering into buckets that are permuted in turn.
Null texts count as empty; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import lru_cache
from math import factorial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of partitions, columns of shards; exact margins."""
    total = sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng, rows = np.random.default_rng(seed), []
    for n in counts:
        rows.append(draw := exact_draw(rng, left, n))
        left = left - draw
    return np.array(rows, np.int64).reshape(len(counts), shards)


def exact_draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Without replacement: n rows from the shards' free places."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for s, good in enumerate(left):
        rest -= int(good)
        out[s] = hypergeometric(rng, int(good), rest, n)
        n -= int(out[s])
    return out


@lru_cache(4096)
def log_factorial(n: int) -> Decimal:
    """To some 30 digits: exact below 64, Stirling's series from there on."""
    with localcontext() as c:
        c.prec = 50
        if n < 64:
            return Decimal(factorial(n)).ln()
        x = Decimal(n)
        series = sum((Decimal(a) / b / x ** (2 * k + 1) for k, (a, b) in enumerate(STIRLING)), Decimal(0))
        return (x + Decimal("0.5")) * x.ln() - x + HALF_LOG_2PI + series


# The coefficients of Stirling's series and ln(2 pi) / 2.
STIRLING = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400))
HALF_LOG_2PI = Decimal("0.918938533204672741780329736405617639861397473637783412817")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, block: int = 1024) -> int:
    """How many of n draws are good; by inversion, outwards from the mode, in the same way at every size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    f = log_factorial
    with localcontext() as c:
        c.prec = 50
        at_mode = float((f(good) + f(bad) + f(n) + f(good + bad - n) - f(good + bad) - f(mode) - f(good - mode) - f(n - mode) - f(bad - n + mode)).exp())
    u = rng.random() - at_mode
    if u < 0:
        return mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while up < high or down > low:
        k = np.arange(up, min(up + block, high), dtype=float)
        p = p_up * np.cumprod((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1)))
        if len(p) and (mass := np.cumsum(p))[-1] > u:
            return up + 1 + int(np.searchsorted(mass, u, "right"))
        u, up, p_up = (u - mass[-1], up + len(p), p[-1]) if len(p) else (u, up, p_up)
        k = np.arange(down, max(down - block, low), -1, dtype=float)
        p = p_down * np.cumprod(k * (bad - n + k) / ((good - k + 1) * (n - k + 1)))
        if len(p) and (mass := np.cumsum(p))[-1] > u:
            return down - 1 - int(np.searchsorted(mass, u, "right"))
        u, down, p_down = (u - mass[-1], down - len(p), p[-1]) if len(p) else (u, down, p_down)
    return mode  # only what rounding left over


def shard(rows: DataFrame, shards: int = 24, group_rows: int = 1_000_000, seed: int = 17) -> DataFrame:
    """rows: doc_id and any payload columns. Adds shard and slot (gapless from 0 in each shard).

    Source partitions and the buckets of a shard hold group_rows rows or so each, whatever the table's size.
    """
    spark, names = rows.sparkSession, rows.columns
    r1, r2, p, b, n, ends_, k, start_ = (fresh(rows, x) for x in ("r1", "r2", "p", "b", "n", "ends", "k", "start"))
    # the row's number keeps equal rows apart; the checkpoint fixes it
    place = F.monotonically_increasing_id()
    rows = cut(rows.withColumns({r1: F.xxhash64(F.lit(seed), place, *names), r2: F.xxhash64(F.lit(seed + 1), place, *names)}))
    total = rows.count()
    partitions, buckets = max(4 * shards, -(-total // group_rows)), max(32, -(-total // (shards * group_rows)))
    keyed = rows.withColumns({p: F.pmod(F.xxhash64(F.lit(seed + 2), r1, r2), F.lit(partitions)).cast("int"), b: F.pmod(F.xxhash64(F.lit(seed + 3), r1, r2), F.lit(buckets)).cast("int")})
    counts = {x[p]: x["count"] for x in keyed.groupBy(p).count().collect()}  # one row a partition
    ends = matrix([counts.get(x, 0) for x in range(partitions)], shards, seed).cumsum(axis=1)
    ends = spark.createDataFrame([(x, [int(v) for v in e]) for x, e in enumerate(ends)], f"{p} int, {ends_} array<bigint>")
    dealt = keyed.withColumn(n, F.row_number().over(Window.partitionBy(p).orderBy(r1, *names))).join(F.broadcast(ends), p)  # partitions x shards numbers
    dealt = cut(dealt.withColumn("shard", F.size(F.filter(ends_, lambda e: e < F.col(n))).cast("int")).select(*names, r2, b, "shard"))
    placed = dealt.withColumn(k, F.row_number().over(Window.partitionBy("shard", b).orderBy(r2, *names)))
    before = F.sum("count").over(Window.partitionBy("shard").orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("shard", b).count().select("shard", b, F.coalesce(before, F.lit(0)).alias(start_))
    return placed.join(F.broadcast(starts), ["shard", b]).select(*names, "shard", (F.col(start_) + F.col(k) - 1).cast("long").alias("slot"))  # shards x buckets numbers


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
