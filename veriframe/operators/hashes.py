"""Perceptual hashes and near matches by banded equality joins (pigeonhole, so none is missed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hamming
from ..plans.lineage import cut


def vector_hashes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """64-bit average hash and neighbour-difference hash of 64-element vectors, first element in the top bit."""
    v = F.col(vector)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    bit = lambda test: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(F.when(test(i), F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return df.where(F.size(v) == 64).withColumn("__mean", mean).select(key, bit(lambda i: F.get(v, i) > F.col("__mean")).alias("ahash"), bit(lambda i: F.get(v, i) > F.get(v, (i + 1) % 64)).alias("dhash"))


def exact_groups(df: DataFrame, digest: str, key: str) -> DataFrame:
    return df.groupBy(digest).agg(F.count("*").alias("members"), F.min(key).alias("first")).where("members > 1")


def near_pairs(df: DataFrame, key: str, d_limit: int = 5, a_limit: int = 8) -> DataFrame:
    """Pairs (a < b) within both Hamming limits; d_limit + 1 bands of dhash are joined."""
    bands, at, cols = d_limit + 1, 0, []
    for k in range(bands):
        width = 64 // bands + (k < 64 % bands)
        cols.append(F.shiftrightunsigned("dhash", at).bitwiseAND(F.lit((1 << width) - 1)).alias(f"b{k}"))
        at += width
    df = cut(df.select(key, "dhash", "ahash"))  # hashes are made once for both sides
    x = df.select(key, "dhash", "ahash", F.posexplode(F.array(*cols)).alias("band", "part"))
    side = lambda s: x.select("band", "part", F.col(key).alias(s), F.col("dhash").alias("d" + s), F.col("ahash").alias("h" + s))
    d, h = hamming(F.col("da"), F.col("db")), hamming(F.col("ha"), F.col("hb"))
    return side("a").join(side("b"), ["band", "part"]).where((F.col("a") < F.col("b")) & (d <= d_limit) & (h <= a_limit)).select("a", "b", d.alias("dhash_distance"), h.alias("ahash_distance")).distinct()
