"""Benchmark decontamination by SimHash of item-sized windows.

Windows as long as a benchmark item, and holding enough shingles of items to reach the similarity, get a 128-bit SimHash
over their weighted shingles. A multi-index finds the items whose fingerprints lie within RADIUS, all of them: the bits are
cut into 8 blocks of 16, two fingerprints within the radius differ in at most RADIUS // 8 bits of some block, and each
block's values within that distance are looked up. Candidates are confirmed by exact weighted-shingle similarity (sum of
minima over sum of maxima).

Each bit of two sets' fingerprints differs with probability acos(c) / pi, where c is their cosine: 0.15 at a similarity of
0.8, so 19 bits of 128 are expected to differ there and fewer above. RADIUS loses about 1 match in 500 at 0.8 itself and
practically none from 0.82 on; tests measure it. With radius None every item of the window's length is compared exactly.

A text shorter than an item is one window for it. Items with fewer words than a shingle are matched as one shingle; null or
empty items and texts match nothing. The benchmark is counted and sent out in blocks of ``item_bytes`` at most (or one
item, if that is longer). Repeated documents are judged each; repeated items are reported by each of their ids; of equally
similar windows the first is reported. Empty tables give empty results. Other columns do not matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, lower_ascii, mix, rolling, table, word_hashes

WIDTH, SIMILARITY, RADIUS, SALT = 5, 0.8, 31, 0x9E3779B97F4A7C15
BITS, PART = 128, 16
HIT = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def bits(h: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1 for the BITS bits of each shingle hash."""
    both = np.stack([mix(h), mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int32) * 2 - 1


def prints(signs: np.ndarray) -> np.ndarray:
    """Rows of BITS / PART numbers of PART bits."""
    return np.packbits(signs, axis=1).view(np.uint16)


class HammingIndex:
    """All fingerprints within a radius of a given one, by blocks of PART bits (pigeonhole)."""

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.prints, self.radius, blocks = fingerprints, radius, BITS // PART
        near = [sum(1 << b for b in c) for k in range(radius // blocks + 1) for c in combinations(range(PART), k)]
        self.masks = np.array(near, np.uint16)
        self.order = [np.argsort(fingerprints[:, j], kind="stable") for j in range(blocks)]
        self.ends = [np.searchsorted(fingerprints[o, j], np.arange(2**PART + 1)) for j, o in enumerate(self.order)]

    def near(self, one: np.ndarray) -> np.ndarray:
        """Rows of the fingerprints within the radius of one."""
        got = []
        for j, (order, ends) in enumerate(zip(self.order, self.ends, strict=True)):
            v = (self.masks ^ one[j]).astype(np.int64)
            lo, hi = ends[v], ends[v + 1]
            got += [order[a:b] for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True)]
        rows = np.unique(np.concatenate(got)) if got else np.empty(0, np.int64)
        return rows[np.bitwise_count(self.prints[rows] ^ one).sum(axis=1) <= self.radius]


class Items:
    """One block of benchmark items: which shingles they hold, and their fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], radius: int | None = RADIUS):
        self.items = []
        for item_id, text in rows:
            w = lower_ascii(text).split()
            if w:
                h = rolling(word_hashes(w), min(WIDTH, len(w)), SALT)
                self.items.append((item_id, len(w), len(h), Counter(h.tolist())))
        pairs = sorted((s, k) for k, it in enumerate(self.items) for s in it[3])
        self.keys = np.array([p[0] for p in pairs], np.uint64)
        self.owner = np.array([p[1] for p in pairs], np.int64)
        signs = [bits(np.fromiter(it[3].elements(), np.uint64)).sum(axis=0) > 0 for it in self.items]
        self.index = HammingIndex(prints(np.array(signs)), radius) if signs and radius is not None else None
        self.sized = defaultdict(set)  # by words of a shingle and shingles of the item
        for k, it in enumerate(self.items):
            self.sized[min(WIDTH, it[1]), it[2]].add(k)

    def windows(self, h: np.ndarray, width: int, similarity: float) -> dict[int, np.ndarray]:
        """For each window size, the starts of windows that hold enough shingles of some item of that size."""
        lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        at = np.flatnonzero(hi > lo)
        if not len(at):
            return {}
        reps, found = (hi - lo)[at], defaultdict(list)
        pos = np.repeat(at, reps)
        own = self.owner[np.repeat(lo[at], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        order = np.argsort(own, kind="stable")
        pos, own = pos[order], own[order]
        for k, first, n in zip(*np.unique(own, return_index=True, return_counts=True), strict=True):
            _, n_words, length, _ = self.items[k]
            size = min(length, len(h))  # a text shorter than the item is one window
            need = int(np.ceil(similarity / (1 + similarity) * (length + size) - 1e-9))
            if min(WIDTH, n_words) != width or size < similarity * length or n < need:
                continue
            hits = pos[first : first + n]
            ends = hits[need - 1 :]
            ok = ends - hits[: len(ends)] < size
            found[size] += [np.arange(max(0, e - size + 1), min(b, len(h) - size) + 1) for b, e in zip(hits[: len(ends)][ok], ends[ok], strict=True)]
        return {size: np.unique(np.concatenate(x)) for size, x in found.items() if x}

    def search(self, text: str | None, similarity: float) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window for each item that reaches the similarity."""
        words = lower_ascii(text).split()
        if not words or not self.items:
            return []
        wh, best = word_hashes(words), {}
        for width in sorted({w for w, _ in self.sized}):
            h = rolling(wh, width, SALT)
            for size, starts in self.windows(h, width, similarity).items() if len(h) else ():
                fits = set().union(*(ks for (w, length), ks in self.sized.items() if w == width and min(length, len(h)) == size))
                for at in range(0, len(starts), 256):
                    part = starts[at : at + 256]
                    if self.index:
                        from_, to = part[0], part[-1] + size
                        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits(h[from_:to]), axis=0)])
                        fp = prints(sums[part - from_ + size] - sums[part - from_] > 0)
                    for i, start in enumerate(part.tolist()):
                        near = fits.intersection(self.index.near(fp[i]).tolist()) if self.index else fits
                        w = Counter(h[start : start + size].tolist()) if near else None
                        for k in near:
                            item_id, _, length, weights = self.items[k]
                            both = sum((w & weights).values())
                            sim = both / (length + size - both)
                            if sim >= similarity and (k not in best or (-sim, start) < best[k][:2]):
                                best[k] = (-sim, start, size + width - 1)
        return [(self.items[k][0], -sim, start, n) for k, (sim, start, n) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, item_bytes: int = 32_000_000, radius: int | None = RADIUS) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, similarity, start_word, n_words. Clean documents have none."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    size = F.sum(F.octet_length("text") + 8).over(Window.partitionBy("p").orderBy("item_id", "text"))
    # a first cut by hash keeps each running sum on a bounded share of the items
    total = items.select(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    cuts = max(1, -(-2 * total // item_bytes))
    blocked = items.withColumn("p", F.pmod(F.xxhash64("item_id", "text"), F.lit(cuts))).withColumn("b", F.floor(size / item_bytes))
    out = None
    for p, b in sorted(tuple(r) for r in blocked.select("p", "b").distinct().collect()):  # one row a block
        mine = blocked.where((F.col("p") == p) & (F.col("b") == b))
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in mine.collect()])  # item_bytes or so

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Items(shared.value, radius)
            for x in batches:
                rows = [(d, *hit) for d, t in zip(x["doc_id"].astype("Int64"), x["text"], strict=True) for hit in index.search(t, similarity)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "start_word", "n_words"]).astype({"doc_id": "Int64"})

        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, HIT)
        out = hits if out is None else out.union(hits)
    return spark.createDataFrame([], HIT) if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, judged by id: all rows of an id with such a passage go.

    Rows with a null id are judged together as well. Null and empty texts hold none and stay, as do all rows when either
    table is empty; equal rows fare alike. Other columns pass through, whatever their names.
    """
    id_ = fresh(docs, "i")
    bad = cut(contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(id_)).distinct())
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left_anti").select(*docs.columns)
