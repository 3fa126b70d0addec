"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where executors share this machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veriframe-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


# Rows and bytes of a batch sent to Python, so that long texts and wide sketches fit beside each other.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def small_batches(spark: SparkSession) -> None:
    """Bound the batches for Python workers where the session still has Spark's own setting."""
    for key, (usual, ours) in BATCHES.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, ours)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut lineage with a compressed table in the shared folder; its path is for discard()."""
    small_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str):
    """A text key for a row that is null-safe and the same on every retry."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, in order."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (public splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    b = np.uint64(base)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * b + h[j : j + n]
    return mix(out)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence counts as one if shorter."""
    words = lower_ascii(text).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(word_hashes(words), min(width, len(words)), 0x9E3779B97F4A7C15))


UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(UPPER)
