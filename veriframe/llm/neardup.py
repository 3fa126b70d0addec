"""Near duplicates by SetSketch registers.

A register is the exponentially spaced, truncated level of the smallest of one random value per word shingle; registers
merge by maximum and collide more often the more alike two sets are. A shingle's values for the registers are drawn in
ascending order, one from each of M equal strata, and dealt by a permutation of its own, so a set is done as soon as every
register has a value. Documents with the same shingle set are one class from the start.

Classes that share a band of registers are candidates. Never all pairs of a bucket are made:

1. Each bucket's most central class (the one whose bands are shared most) meets all others: one pair for each member.
2. A likelihood estimate from both register sets drops clear misses; the rest are confirmed on the full sets.
3. What still shares a bucket over different components is joined without loss on its rarest shingles: two sets alike
   enough must share one of the few rarest of each (rarity is counted over these classes), at places that leave room for
   the overlap needed. This finds every remaining link between classes that share a band.

Texts without words (null and empty ones too) link with nothing and are components of their own id. Equal rows are linked
as equal sets; rows of one id with different texts are classes of their own, each with its links. A null id links as any
other; it is never the component's id unless all its members have none. An empty table gives an empty result. Other
columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, mix, release, shingle_set, table

M, ROWS, BASE, LIFT, SEED = 512, 8, 1.05, 121, 11  # LIFT keeps the registers of one-shingle sets clear of zero
MISS = 1e-6  # a pair at the threshold shares no band with about this probability, as far as M registers reach
WORDED = r"[^\x20\x09-\x0D]"


def registers(s: np.ndarray) -> np.ndarray:
    """M levels of one set, modulo 256; empty for an empty set."""
    n = len(s)
    if not n:
        return np.empty(0, np.uint8)
    low, j = np.ones(M), 0
    step, first = mix(s ^ np.uint64(SEED)) | np.uint64(1), mix(s + np.uint64(SEED))
    with np.errstate(over="ignore"):
        while j < M and low.max() == 1:  # values of later strata are larger, so a register once reached is done
            js = np.arange(j, j := min(M, j - (-8 * M // n)), dtype=np.uint64)
            at = (first[:, None] + step[:, None] * js) & np.uint64(M - 1)
            u = (js + (mix(s[:, None] ^ mix(js + np.uint64(1))) >> np.uint64(11)) / 2.0**53) / M
            np.minimum.at(low, at.ravel().astype(np.intp), u.ravel())
    return (np.floor(LIFT - np.log(-np.log1p(-np.clip(low, 1e-18, 1 - 1e-12))) / math.log(BASE)).astype(np.int64) & 255).astype(np.uint8)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For each row, the similarity that makes the counts of equal, larger and smaller registers likeliest."""
    d = (a - b).view(np.int8)  # levels are modulo 256; candidates never differ by half of that
    same, up, down = ((d == 0).sum(axis=1), (d > 0).sum(axis=1), (d < 0).sum(axis=1))
    j = np.linspace(0.3, 0.995, 140)
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    score = same[:, None] * np.log(np.maximum(1 - more - less, 1e-12)) + up[:, None] * np.log(more) + down[:, None] * np.log(less)
    return j[np.where(j <= np.minimum(u / v, v / u), score, -np.inf).argmax(axis=1)]


def bands(percent: int) -> int:
    return min(M // ROWS, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS))))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark (md5 of the text), n_shingles, a digest of the shingle set, registers; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                s = shingle_set(t)
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), registers(s).tobytes()) if len(s) else (0, None, None))
            yield pd.DataFrame(out, columns=["n_shingles", "digest", "regs"]).assign(doc_id=b["doc_id"].astype("Int64").to_numpy(), mark=b["mark"].to_numpy())[["doc_id", "mark", "n_shingles", "digest", "regs"]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("mark"))
    return rows.mapInPandas(run, "doc_id long, mark string, n_shingles long, digest binary, regs binary")


def band_keys(n: int):
    """registers -> one key for each of n bands"""

    @F.pandas_udf("array<long>")
    def run(regs: pd.Series) -> pd.Series:
        r = np.frombuffer(b"".join(regs), np.uint8).reshape(len(regs), M // ROWS, ROWS)[:, :n].astype(np.uint64)
        key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), r.shape[:2])
        with np.errstate(over="ignore"):
            for k in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
        return pd.Series(list(key.view(np.int64)))

    return run


def shingles(text):
    """text -> its shingle set"""

    @F.pandas_udf("array<long>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: shingle_set(t).view(np.int64))

    return run(text)


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the estimate lets through and whose full sets are alike."""
    t = percent / 100
    floor = t - 5 * math.sqrt(t * (1 - t) / M)

    @F.pandas_udf("double")
    def estimate(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        whole = lambda r: np.frombuffer(b"".join(r), np.uint8).reshape(-1, M)
        return pd.Series(likely(whole(ra), whole(rb), na.to_numpy(float), nb.to_numpy(float)), dtype=float)

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last = (None, None)  # a hub's rows mostly follow each other
        for ta, tb in batches:
            out = []
            for p, q in zip(ta, tb, strict=True):
                last = last if last[0] == p else (p, shingle_set(p))
                x, y = last[1], shingle_set(q)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.Series(out, dtype=bool)

    side = lambda k: classes.select(F.col("id").alias(k), F.col("regs").alias("r" + k), F.col("n").alias("n" + k))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    near = cut(sized.where(estimate("ra", "rb", "na", "nb") >= floor).select("a", "b"))
    release(pairs.sparkSession)
    of = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias("t" + k))
    return cut(near.join(of("b"), "b").join(of("a"), "a").where(alike("ta", "tb")).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """id, comp (smallest reachable id) of the ids on edges, by passing minima along edges and jumping over them."""
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct())
    comp = cut(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        told = both.join(comp.select(F.col("id").alias("to"), F.col("comp").alias("c")), "to").groupBy("id").agg(F.min("c").alias("c"))
        near = comp.join(told, "id").select("id", "comp", F.least("comp", "c").alias("new"))
        jump = comp.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        new = cut(near.join(jump, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("now"), "comp"))
        changed = new.where("now <> comp").limit(1).count()
        comp = new.select("id", F.col("now").alias("comp"))
        del told, near, jump
        release(edges.sparkSession)
        if not changed:
            return comp


def by_rarest(open_: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open_ (id, comp, n) from different components that may be alike: none that is alike is missing.

    Shingles are ordered by how many of these classes hold them. If a and b are alike, the first shingle of that order
    that both hold leaves at least the overlap needed from its place on, in either set.
    """
    held = open_.join(texts, "id").select("id", "comp", "n", F.explode(shingles("text")).alias("s"))
    often = cut(held.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"))  # both sides exchanged: hot shingles can be split
    common = held.join(often, "s").groupBy("id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("common"))
    # those that no other class holds come first and meet nothing
    placed = common.select("id", "comp", "n", F.posexplode("common").alias("k", "x"), (F.col("n") - F.size("common")).alias("alone"))
    placed = placed.select(F.col("x.s").alias("s"), "id", "comp", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("left"))
    # "left" counts the shingles from this one on; the smallest partner still alike enough has percent of n
    placed = cut(placed.where(F.col("left") * 100 >= F.col("n") * percent))
    mixed = placed.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("s")
    placed = placed.join(mixed, "s", "left_semi")
    x = placed.select("s", F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("left").alias("la"))
    y = placed.select("s", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    room = F.least("la", "lb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return x.join(y, "s").where((F.col("ca") < F.col("cb")) & room).select("a", "b").distinct()


def link(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, chosen_mark for every row; the row of component_id with chosen_mark stands for its group."""
    rows = cut(sketches(docs))
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("low")
    sets = rows.where("digest is not null").groupBy("digest").agg(lowest, F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    classes = cut(sets.withColumn("id", F.monotonically_increasing_id()))
    banded = classes.select("id", F.explode(band_keys(bands(percent))("regs")).alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"))  # both sides exchanged: hot keys can be split
    members = cut(banded.join(shared, "key").select("key", "id", "k"))
    release(docs.sparkSession)
    marks = members.select("id").distinct().join(classes, "id").select("id", F.col("low.mark").alias("mark"))
    texts = cut(docs.select(F.md5("text").alias("mark"), "text").groupBy("mark").agg(F.first("text").alias("text")).join(marks, "mark").select("id", "text"))
    release(docs.sparkSession)
    central = members.groupBy("id").agg(F.sum("k").alias("weight"))
    hubs = members.join(central, "id").groupBy("key").agg(F.max(F.struct("weight", "id"))["id"].alias("a"))
    star = members.join(hubs, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    first = confirm(star, classes, texts, percent)
    labelled = members.join(components(first), "id", "left").select("id", "key", F.coalesce("comp", "id").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_ = labelled.join(mixed, "key", "left_semi").select("id", "comp").distinct().join(classes.select("id", "n"), "id")
    second = confirm(by_rarest(cut(open_), texts, percent), classes, texts, percent)
    comp = components(first.union(second))
    of = classes.select("digest", "id", "low").join(comp, "id", "left").select("digest", "low", F.coalesce("comp", "id").alias("comp"))
    heads = cut(of.groupBy("comp").agg(F.min("low").alias("head")))  # both sides exchanged: a large component can be split
    named = of.join(heads, "comp").select("digest", F.col("head.doc_id").alias("component_id"), F.col("head.mark").alias("chosen_mark"))
    worded = F.col("n_shingles") > 0
    return rows.join(named, "digest", "left").select("doc_id", "mark", "n_shingles", F.when(worded, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "chosen_mark")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at similarity 0.8: the smallest id (of several texts of that id, the smallest md5).

    Of equal rows one stays; a null id stays only where its group has no other. Rows without words (null and empty
    texts) all stay. An empty table gives an empty one; other columns pass through, whatever their names.
    """
    kept = link(docs, percent=80).where("n_shingles > 0 and doc_id <=> component_id and mark = chosen_mark")
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__of")).distinct()
    worded, mark = F.coalesce(F.col("text").rlike(WORDED), F.lit(False)), fresh(docs, "mark")
    once = docs.where(worded).withColumn(mark, F.md5("text")).dropDuplicates(["doc_id", mark])
    id_, of = fresh(docs, "id"), fresh(docs, "of")
    kept = kept.toDF(id_, of)
    once = once.join(kept, once["doc_id"].cast("long").eqNullSafe(kept[id_]) & (once[mark] == kept[of]), "left_semi")
    return once.select(*docs.columns).unionByName(docs.where(~worded))
