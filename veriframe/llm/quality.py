"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics come from the whole text alone. Normal equations are summed in each partition, then in a few groups,
so what reaches the driver depends on the number of features, not of rows. The model learns from SAMPLE label rows at
most: ridge on two thirds of them and calibration on the rest, both without the held-out quarter. Null and empty texts have statistics
of zero and are scored like the others; a document with several label rows counts once for each; null labels are
left out; with no usable label every score is 1 (nothing speaks against a document). Repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

STATS = ("log_bytes", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "newline", "distinct_words", "top_word", "short_words", "distinct_lines", "short_lines", "high_bytes", "end_marks", "longest_word")
FEATURES, RIDGE, GROUPS, BINS, SPREAD, KEEP = 192, 0.1, 8, 1024, 5.0, 0.7
SAMPLE = 20_000  # label rows that the model is fitted on, at most; those of smallest hash

KIND = np.zeros(256, np.int64)  # 0 letter or other, 1 upper, 2 digit, 3 punctuation, 4 symbol, 5 newline, 6 high byte
KIND[65:91], KIND[48:58], KIND[10], KIND[128:] = 1, 2, 5, 6
KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3
BLANK, END = np.zeros(256, np.int8), np.zeros(256, np.int64)
BLANK[[9, 10, 11, 12, 13, 32]], END[[ord(c) for c in "#$%&*|!"]] = 1, 1
KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(STATS)
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(KIND[codes], minlength=7) / n
    words, lines = raw.split(), raw.split(b"\n")
    w, count = max(1, len(words)), Counter(words)
    edge = np.flatnonzero(np.diff(np.concatenate([[1], BLANK[codes], [1]])))  # where words begin and end, in turn
    lengths, ends = edge[1::2] - edge[::2], int(END[codes[edge[1::2] - 1]].sum())
    return [np.log1p(n), np.log1p(len(words)), lengths.mean() if len(words) else 0.0, *kinds[1:6], len(count) / w**0.75, max(count.values(), default=0) / w,
            float((lengths <= 3).mean()) if len(words) else 0.0, len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), kinds[6], ends / w, np.log1p(lengths.max(initial=0))]


def training(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """stats, quality and calibrates of the labelled rows that the model may learn from."""

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[float(x) for x in statistics(t)] for t in b])

    marked = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", "quality")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample rows at most
    return cut(rows.select(stats("text").alias("stats"), "quality", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("calibrates")))


def project(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, seed: int = 5) -> np.ndarray:
    """Random Fourier features of the standardised statistics, with a constant."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(len(mean), FEATURES)) / SPREAD, rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / sd, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])


def pool(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; mean place and level of each block."""
    blocks: list[list[float]] = []
    for a, s, m in zip(x, y, n, strict=True):
        blocks.append([a * m, s, m])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([p / m for p, _, m in blocks]), np.array([s / m for _, s, m in blocks])


def held_out(col="doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(4)) == 2


def scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A function of the text column: its calibrated score, computed where the text is read."""
    predict = fit(training(docs, labels, sample))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(predict(np.array([statistics(t) for t in b], dtype=float).reshape(len(b), -1)))

    return scored


def score(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = scorer(docs, labels, sample)("text")
    out = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), scored.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= keep).cast("int"))


def fit(train: DataFrame):
    """A function from statistics to calibrated scores."""
    k = len(STATS)
    sums = train.select(F.count("*"), *[f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(k)]).first()
    if not sums[0]:
        return lambda x: np.ones(len(x))
    mean, sd = np.array(sums[1 : k + 1]), np.maximum(np.array(sums[k + 1 :]), 1e-6)
    size = FEATURES + 1

    def equations(batches):
        a, b = np.zeros((size, size)), np.zeros(size)
        for x in batches:
            if len(x):
                z = project(np.array(x["stats"].to_list()), mean, sd)
                a += z.T @ z
                b += z.T @ x["quality"].to_numpy(float)
        yield pd.DataFrame({"sums": [np.concatenate([a.ravel(), b])]})

    def add(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum(x["sums"].to_list(), axis=0)]})

    parts = train.where(~F.col("calibrates")).select("stats", F.col("quality").cast("double").alias("quality")).mapInPandas(equations, "sums array<double>")
    few = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS))).applyInPandas(add, "sums array<double>").collect()
    total = np.sum([r["sums"] for r in few], axis=0) if few else np.zeros(size * size + size)
    a, b = total[: size * size].reshape(size, size), total[size * size :]
    beta = np.linalg.solve(a + RIDGE * np.eye(size), b)

    @F.pandas_udf("int")
    def bin_of(s: pd.Series) -> pd.Series:
        raw = project(np.array(s.to_list(), dtype=float).reshape(len(s), -1), mean, sd) @ beta
        return pd.Series(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype("int32"))

    held = train.where("calibrates").groupBy(bin_of("stats").alias("bin")).agg(F.sum("quality").alias("s"), F.count("*").alias("n")).orderBy("bin").collect()  # BINS rows at most
    x, level = pool(*(np.array([r[c] for r in held], float) for c in ("bin", "s", "n"))) if held else (np.array([0.0, BINS]), np.array([0.0, 1.0]))

    def predict(stats: np.ndarray) -> np.ndarray:
        raw = project(stats, mean, sd) @ beta
        at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS)
        return np.clip(np.interp(at, x, level), 0, 1)  # between the means of the pooled blocks

    return predict


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: those scored KEEP or more, by their text alone.

    Null and empty texts are scored like any other; equal texts fare alike. Without usable labels nothing goes; an empty
    table gives an empty one. Other columns pass through, whatever their names.
    """
    return docs.where(scorer(docs, table(spark, sf_dir, "labels"))("text") >= KEEP)
