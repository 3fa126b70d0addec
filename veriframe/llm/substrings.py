"""Removal of repeated passages by relative Lempel-Ziv factors against all earlier text.

In each 20-word window the 6-word block of smallest hash (the leftmost of equal ones) is its reference block, so equal
windows hold equal blocks at the same place. A block stands for the run of windows that chose it; the words of that run
are its context. Every block of every document is indexed; those that occur once cannot be part of a repeated window.

Factoring. Of equal contexts the earliest is the reference; all windows of any later one are copies of it. A document is
parsed greedily from left to right: blocks whose references follow each other in one document, at one displacement, form
one factor. Where factors end, contexts differ but single windows may still be copies: for blocks with several contexts
the windows of each context's earliest place are compared as well. Every factor has 20 words at least; its words go.

A document is its id and text, in the order of id, then of a hash of the text; a null id comes after all others. So rows
of one id with different texts are documents of their own, and equal rows have one result. Word-for-word equal documents
are one class, of which the first stands for all. Null and empty texts have no words, documents under 20 words lose
nothing, an empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, mix, release, rolling, store, table, word_hashes

WINDOW, BLOCK = 20, 6
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LAST = 2**63 - 1
SLICE = 200_000  # blocks in an output batch
PROFILE = "k long, mark long, doc_id long, n_words long, whole binary, blocks array<long>"
ANCHOR = "k long, mark long, block long, context long, lo int, n int, windows array<long>"
FACTOR = "array<struct<start: int, length: int, ref_id: long, ref_start: int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def reference_blocks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first window of each run, number of runs + 1 (the last is the number of windows); block's place; block's hash"""
    n, span = len(h) - WINDOW + 1, WINDOW - BLOCK + 1
    if n <= 0:
        return np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    b = rolling(h, BLOCK, 0xD6E8FEB86659FD93)
    low, at, width = b, np.arange(len(b)), 1
    while width < span:
        d = min(width, span - width)
        at = np.where(low[d:] < low[:-d], at[d:], at[:-d])
        low, width = np.minimum(low[d:], low[:-d]), width + d
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return np.append(first, n), at[first], low[first]


class Spans:
    """Hashes of any stretch of one document's words."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), INVERSE)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(np.int64)))


def keyed(docs: DataFrame) -> DataFrame:
    """k (the id; null ids last), mark (hash of id and text), doc_id, text"""
    id_ = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(id_, F.lit(LAST)).alias("k"), F.xxhash64(id_, "text").alias("mark"), id_.alias("doc_id"), "text")


def profile(docs: DataFrame) -> DataFrame:
    """PROFILE of every row: number of the words, their sha256, hashes of the reference blocks; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, whole, blocks = [], [], []
            for t in x.column("text"):
                w = words_of(t.as_py())
                n.append(len(w))
                whole.append(hashlib.sha256(b" ".join(w)).digest())
                blocks.append(reference_blocks(word_hashes(w))[2] if len(w) >= WINDOW else np.empty(0, np.uint64))
            yield pa.RecordBatch.from_arrays([x.column("k"), x.column("mark"), x.column("doc_id"), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), lists(blocks)], names=["k", "mark", "doc_id", "n_words", "whole", "blocks"])

    return docs.mapInArrow(run, PROFILE)


def anchors(texts: DataFrame) -> DataFrame:
    """ANCHOR of each repeated block of texts (k, mark, text, repeated): its context and the windows that chose it.

    Of equal contexts met together, only the earliest carries its windows, others none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for x in batches:
            for k, m, t, rep in zip(*(x.column(c) for c in ("k", "mark", "text", "repeated")), strict=True):
                h = word_hashes(words_of(t.as_py()))
                first, at, block = reference_blocks(h)
                hit = np.flatnonzero(np.isin(block.view(np.int64), rep.values.to_numpy()))
                lo, hi, s = first[hit], first[hit + 1], Spans(h)
                with np.errstate(over="ignore"):
                    context = s.of(lo, hi + WINDOW - 1) ^ mix(((hi - lo) * 64 + at[hit] - lo).astype(np.uint64))
                starts = np.arange(len(h) - WINDOW + 1)
                windows = s.of(starts, starts + WINDOW)
                out.append((np.full(len(hit), k.as_py()), np.full(len(hit), m.as_py()), block[hit].view(np.int64), context.view(np.int64), lo.astype(np.int32), [windows[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
                size += len(hit)
                if size >= SLICE:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        *cols, windows = zip(*out, strict=True)
        cols, windows = [np.concatenate(c) for c in cols], [w for x in windows for w in x]
        n = np.array([len(w) for w in windows], np.int32)
        order = np.lexsort([cols[4], cols[1], cols[0], cols[3], cols[2]])
        again = (cols[2][order[1:]] == cols[2][order[:-1]]) & (cols[3][order[1:]] == cols[3][order[:-1]])
        for i in order[1:][again].tolist():
            windows[i] = windows[i][:0]
        return pa.RecordBatch.from_arrays([*map(pa.array, [*cols, n]), lists(windows)], names=["k", "mark", "block", "context", "lo", "n", "windows"])

    return texts.mapInArrow(run, ANCHOR)


def parse(parts: np.ndarray) -> np.ndarray:
    """Greedy factors of one document: start, words, reference (k, mark, start) of parts (lo, windows, k, mark, ref)."""
    p = parts[np.lexsort((parts[:, 4], parts[:, 0]))]
    end = p[:, 0] + p[:, 1]
    follows = (p[1:, 2] == p[:-1, 2]) & (p[1:, 3] == p[:-1, 3]) & (p[1:, 4] - p[1:, 0] == p[:-1, 4] - p[:-1, 0]) & (p[1:, 0] <= end[:-1])
    head = np.concatenate([[0], np.flatnonzero(~follows) + 1])
    last = np.maximum.reduceat(end, head)
    return np.column_stack([p[head, 0], last - p[head, 0] + WINDOW - 1, p[head, 2], p[head, 3], p[head, 4]])


def cut_out(texts: DataFrame) -> DataFrame:
    """k, mark, n_removed, kept_sha256, factors of texts (k, mark, text, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, sha, factors = [], [], []
            for t, parts in zip(x.column("text"), x.column("parts"), strict=True):
                words, v = words_of(t.as_py()), parts.values
                f = parse(np.column_stack([v.field(c).to_numpy().astype(np.int64) for c in ("lo", "n", "rk", "rm", "rlo")]))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, f[:, 0], 1)
                np.add.at(edge, f[:, 0] + f[:, 1], -1)
                gone = np.cumsum(edge)[:-1] > 0
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
                factors.append([{"start": a, "length": b, "ref_id": None if k == LAST else k, "ref_start": r} for a, b, k, _, r in f.tolist()])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([x.column("k"), x.column("mark"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(factors, kind)], names=["k", "mark", "n_removed", "kept", "factors"])

    return texts.mapInArrow(run, f"k long, mark long, n_removed long, kept string, factors {FACTOR}")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors for every row."""
    spark, docs = docs.sparkSession, keyed(docs)
    all_, all_at = store(profile(docs))
    place, empty = F.struct("k", "mark"), hashlib.sha256(b"").hexdigest()
    firsts = all_.where(F.col("n_words") >= WINDOW).groupBy("whole").agg(F.min(place).alias("first"))
    info = cut(all_.select("k", "mark", "doc_id", "n_words", "whole").join(firsts, "whole", "left"))
    alone = firsts.select("first.*").join(all_.select("k", "mark", "blocks"), ["k", "mark"]).dropDuplicates(["k", "mark"])
    block = alone.select("k", "mark", F.explode("blocks").alias("block"))
    often, often_at = store(block.groupBy("block").agg(F.count("*").alias("c")).where("c > 1").select("block"))  # both sides exchanged: hot blocks can be split
    near, near_at = store(block.join(often, "block").groupBy("k", "mark").agg(F.collect_set("block").alias("repeated")))
    discard(spark, all_at, often_at)
    release(spark)
    once = docs.groupBy("k", "mark").agg(F.first("text").alias("text"))  # equal rows are one document
    found, found_at = store(anchors(once.join(near, ["k", "mark"]).select("k", "mark", "text", "repeated")))
    discard(spark, near_at)
    del all_, firsts, alone, block, often, near
    release(spark)
    here = F.struct("k", "mark", "lo")
    windows = F.first(F.when(F.size("windows") > 0, F.col("windows")), ignorenulls=True)
    earliest, earliest_at = store(found.groupBy("block", "context").agg(F.min(here).alias("e"), F.count("*").alias("c"), windows.alias("windows")))
    whole = found.join(earliest.where("c > 1").select("block", "context", "e"), ["block", "context"]).where(here > F.col("e"))
    whole = whole.select("k", "mark", "lo", "n", "e")
    # factor boundaries: blocks with several contexts, window by window
    several = earliest.groupBy("block").agg(F.count("*").alias("c")).where("c > 1").select("block")
    single = earliest.join(several, "block", "left_semi").select("block", "e.k", "e.mark", F.col("e.lo").alias("from"), F.posexplode("windows").alias("i", "w"))
    single = single.select("block", "w", "k", "mark", (F.col("from") + F.col("i")).alias("lo"))
    lowest, lowest_at = store(single.groupBy("block", "w").agg(F.min(here).alias("e"), F.count("*").alias("c")).where("c > 1").select("block", "w", "e"))
    release(spark)
    edges = single.join(lowest, ["block", "w"]).where(here > F.col("e")).select("k", "mark", "lo", F.lit(1).alias("n"), "e")
    part = F.struct("lo", "n", F.col("e.k").alias("rk"), F.col("e.mark").alias("rm"), F.col("e.lo").alias("rlo"))
    parts, parts_at = store(whole.union(edges).groupBy("k", "mark").agg(F.collect_list(part).alias("parts")))
    discard(spark, found_at, earliest_at, lowest_at)
    del found, earliest, whole, single, lowest, edges, several
    release(spark)
    gone = cut_out(once.join(parts, ["k", "mark"]).select("k", "mark", "text", "parts"))
    copy = F.coalesce(F.col("first") < place, F.lit(False))
    entire = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length"), F.nullif("first.k", F.lit(LAST)).alias("ref_id"), F.lit(0).alias("ref_start")))
    out = cut(info.join(gone, ["k", "mark"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept", F.lower(F.hex("whole")))).alias("kept_sha256"),
        F.when(copy, entire).otherwise(F.coalesce("factors", F.array())).cast(FACTOR).alias("factors"),
    ))
    discard(spark, parts_at)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
