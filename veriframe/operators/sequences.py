"""Relations between ordered vectors, all as equality joins on derived keys. Blocks: (block, vals array<double>)."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """One ordered vector for each group."""
    v = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.transform(v, lambda s: s["__v"]).alias("vals"))


def varies(vals: Column) -> Column:
    return F.array_min(vals) < F.array_max(vals)


def duplicate_sequences(b: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Full vectors that occur in more than one block: digest, n, members, first block."""
    d = b.where((F.size("vals") >= least) & varies(F.col("vals"))).withColumn("digest", F.sha2(F.array_join(F.transform("vals", lambda x: x.cast("string")), "|"), 256))
    return d.groupBy("digest").agg(F.max(F.size("vals")).alias("n"), F.count("*").alias("members"), F.min(key).alias("first_block")).where("members > 1")


def grams(b: DataFrame, key: str, length: int) -> DataFrame:
    """Every run of ``length`` consecutive values: key, pos (from 0), gram."""
    starts = F.when(F.size("vals") >= length, F.sequence(F.lit(0), F.size("vals") - length)).otherwise(F.expr("cast(array() as array<int>)"))
    return b.select(key, "vals", F.explode(starts).alias("pos")).select(key, "pos", F.slice("vals", F.col("pos") + 1, length).alias("gram"))


def shared_runs(b: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Longest common run of each pair of blocks that share one: a, b, length, offsets from 1."""
    g = grams(b, key, least)
    often = g.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    g = g.join(often, "gram", "left_semi")
    pairs = g.select(F.col(key).alias("a"), F.col("pos").alias("pa"), "gram").join(g.select(F.col(key).alias("b"), F.col("pos").alias("pb"), "gram"), "gram").where("a < b")
    diagonal = Window.partitionBy("a", "b", F.expr("pa - pb")).orderBy("pa")
    runs = pairs.withColumn("island", F.col("pa") - F.row_number().over(diagonal)).groupBy("a", "b", F.expr("pa - pb").alias("shift"), "island").agg(F.count("*").alias("k"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max(varies(F.col("gram"))).alias("varies"))
    best = Window.partitionBy("a", "b").orderBy(F.desc("k"), "pa", "pb")
    return runs.withColumn("r", F.row_number().over(best)).where("r = 1 and varies").select("a", "b", (F.col("k") + least - 1).cast("int").alias("length"), (F.col("pa") + 1).alias("offset_a"), (F.col("pb") + 1).alias("offset_b"))


LEVELS, FINE, STEP, LEAST_GAP = 6, 5e-5, 8, 6e-6  # cell widths FINE * STEP ** level; the level after them has one cell


def total(vals: Column) -> Column:
    return F.aggregate(vals, F.lit(0.0), lambda s, x: s + x)


def norm(vals: Column) -> Column:
    return F.sqrt(total(F.transform(vals, lambda x: x * x)))


def projections(vals: Column) -> Column:
    """Three projections of the direction of vals: directions that are d apart differ by at most d in each."""
    unit = norm(vals) * F.sqrt(F.size(vals).cast("double"))
    wave = lambda f: total(F.transform(vals, lambda x, i: x * F.cos((i + 1) * f)))
    return F.array(*[wave(f) / unit for f in (0.7, 1.9, 3.1)])


def source_keys(p: Column) -> Column:
    """The cell of the projections on every level."""
    cells = lambda width: F.transform(p, lambda x: F.floor(x / width))
    return F.array(*[F.struct(F.lit(k).alias("level"), c.alias("cell")) for k, c in enumerate([*[cells(FINE * STEP**k) for k in range(LEVELS)], F.transform(p, lambda x: F.lit(0).cast("bigint"))])])


def target_keys(p: Column, gap: Column) -> Column:
    """All cells, of either sign, that hold directions up to gap apart, on the finest level with cells of 8 gaps."""
    level = reduce(lambda rest, k: F.when(gap * 8 <= FINE * STEP**k, k).otherwise(rest), reversed(range(LEVELS)), F.lit(LEVELS))
    width = F.lit(FINE) * F.pow(F.lit(float(STEP)), level)
    near = [F.when(level == LEVELS, F.transform(p, lambda x: F.lit(0).cast("bigint"))).otherwise(F.array(*[F.floor((sign * p[i] + e * gap) / width) for i, e in enumerate(ends)])) for sign in (1, -1) for ends in product((-1, 1), repeat=3)]
    return F.transform(F.array_distinct(F.array(*near)), lambda c: F.struct(level.alias("level"), c.alias("cell")))


def gap(vals: Column, basis: Column, rel: float) -> Column:
    """How far the direction of basis may lie from its source's when vals are off by rel of themselves or by 1e-9."""
    return F.greatest(F.lit(LEAST_GAP), 2.1 * (rel * norm(vals) + 1e-9 * F.sqrt(F.size(vals).cast("double"))) / norm(basis))


def scaled_vectors(b: DataFrame, key: str, layout: list[str], rel: float = 1e-6, least: int = 3) -> DataFrame:
    """Pairs of equal layout and length with one fixed ratio.

    Pairs meet by cells of their directions, neighbouring cells included, so none that passes the check is missed.
    """
    largest = F.array_max(F.transform("vals", lambda x: F.abs(x)))
    d = b.where((F.size("vals") >= least) & varies(F.col("vals")) & (largest > 1e-9) & (largest < float("inf"))).withColumns({"n": F.size("vals"), "p": projections(F.transform("vals", lambda x: x / largest)), "gap": gap(F.col("vals"), F.col("vals"), rel)})
    x = d.select(*layout, "n", F.explode(source_keys(F.col("p"))).alias("at"), F.col(key).alias("a"), F.col("vals").alias("va"))
    y = d.select(*layout, "n", F.explode(target_keys(F.col("p"), F.col("gap"))).alias("at"), F.col(key).alias("b"), F.col("vals").alias("vb"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    j = x.join(y, [*layout, "n", "at"]).where("a < b").withColumn("ratio", dot(F.col("va"), F.col("vb")) / dot(F.col("va"), F.col("va")))
    ok = F.forall(F.zip_with("va", "vb", lambda s, t: F.struct(s.alias("s"), t.alias("t"))), lambda p: F.abs(p["t"] - F.col("ratio") * p["s"]) <= F.greatest(F.lit(1e-9), rel * F.abs(p["t"])))
    return j.where(ok & (F.abs(F.col("ratio") - 1) > rel) & (F.abs(F.col("ratio")) > 1e-9)).select(*layout, "a", "b", F.round("ratio", 6).alias("ratio"))


def mean(vals: Column) -> Column:
    return total(vals) / F.size(vals)


def close(seen: Column, want: Column, rel: float) -> Column:
    """All within 1e-9, or all within rel of the larger side."""
    error = F.zip_with(seen, want, lambda x, y: F.abs(x - y))
    share = F.zip_with(seen, want, lambda x, y: F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9)))
    return (F.array_max(error) <= 1e-9) | (F.array_max(share) <= rel)


def times(vals: Column, by: Column, plus: Column | float = 0.0) -> Column:
    return F.transform(vals, lambda x: x * by + plus)


def scale(s: Column, t: Column) -> Column:
    """Least-squares ratio of t to s over at least three values other than 0; null if there is none."""
    both = F.filter(F.zip_with(s, t, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: F.abs(p["x"]) > 1e-9)
    square = total(F.transform(both, lambda p: p["x"] * p["x"]))
    ratio = total(F.transform(both, lambda p: p["x"] * p["y"])) / F.when(square > 1e-9, square)
    return F.when((F.size(both) >= 3) & (F.abs(ratio) > 1e-9), ratio)


def differs(vals: Column) -> Column:
    """Not constant in ten significant digits."""
    return F.format_string("%.9e", F.array_min(vals)) != F.format_string("%.9e", F.array_max(vals))


def window_relations(b: DataFrame, key: str, layout: list[str], length: int = 3, digits: int = 6, longest: int = 6, rel: float = 1e-6) -> DataFrame:
    """Windows of length to longest values of neighbouring blocks where the target is constant - source, or the first
    of source + constant, source * constant, source * constant + offset and constant / source that holds.

    Windows meet by cells of the directions of their centred values or of 1 / source and target; a relation is then
    verified. Ratios that hold between the whole blocks are left to scaled_vectors.
    """
    order = Window.partitionBy(*layout).orderBy(key)
    next_ = b.select(*layout, key, "vals").withColumns({"b": F.lead(key).over(order), "vb": F.lead("vals").over(order)}).where("b is not null")
    va, vb = F.col("vals"), F.col("vb")
    whole = F.when((F.size(va) == F.size(vb)) & (F.size(va) >= 3), close(vb, times(va, scale(va, vb)), rel) & ~(close(vb, times(va, F.lit(1.0), mean(vb) - mean(va)), rel) & (F.abs(mean(vb) - mean(va)) > 1e-9)))
    next_ = next_.select(F.col(key).alias("a"), "b", F.coalesce(whole, F.lit(False)).alias("whole"))
    w = reduce(DataFrame.union, [grams(b, key, n).withColumn("length", F.lit(n)) for n in range(length, longest + 1)]).where(differs(F.col("gram")))
    g = F.col("gram")
    centred, inverse = F.transform(g, lambda x: x - mean(g)), F.transform(g, lambda x: 1 / F.when(F.abs(x) > 1e-9, x))
    known = ~F.exists(g, lambda x: F.abs(x) <= 1e-9)
    found = []
    for s, t in ((centred, centred), (F.when(known, inverse), F.when(known, g))):
        x = w.withColumn("p", projections(s)).where("p is not null and p[0] is not null").select(F.col(key).alias("a"), F.col("pos").alias("pa"), "length", F.col("gram").alias("s"), F.explode(source_keys(F.col("p"))).alias("at"))
        y = w.withColumns({"p": projections(t), "gap": gap(g, t, rel)}).where("p is not null and p[0] is not null").select(F.col(key).alias("b"), F.col("pos").alias("pb"), "length", F.col("gram").alias("t"), F.explode(target_keys(F.col("p"), F.col("gap"))).alias("at"))
        found.append(next_.join(x, "a").join(y, ["b", "length", "at"]).select("a", "b", "pa", "pb", "length", "s", "t", "whole"))
    s, t = F.col("s"), F.col("t")
    d = found[0].union(found[1]).distinct()
    d = d.withColumns({"sum": mean(s) + mean(t), "plus": mean(t) - mean(s), "ratio": scale(s, t), "products": F.zip_with(s, t, lambda x, y: x * y), "inverses": F.transform(s, lambda x: 1 / F.when(F.abs(x) > 1e-9, x))})
    spread = total(F.transform(s, lambda x: (x - mean(s)) * (x - mean(s))))
    d = d.withColumns({"slope": total(F.zip_with(s, t, lambda x, y: (x - mean(s)) * (y - mean(t)))) / F.when(spread > 1e-9, spread), "product": mean(F.col("products")), "over": scale(F.col("inverses"), t), "filled": ~F.exists(s, lambda x: F.abs(x) <= 1e-9)})
    d = d.withColumn("offset", mean(t) - F.col("slope") * mean(s))
    is_ = lambda name, constant, offset=None: F.struct(F.lit(name).alias("relation"), constant.cast("double").alias("constant"), F.lit(offset).cast("double").alias("offset"))
    c = F.col
    scaled = c("ratio").isNotNull() & (F.abs(c("ratio") - 1) > rel)
    affine = (F.abs(c("slope")) > 1e-9) & (F.abs(c("slope") - 1) > rel) & (F.abs(c("offset")) > 1e-9) & close(t, times(s, c("slope"), c("offset")), rel)
    first = (
        F.when(close(t, times(s, F.lit(1.0), c("plus")), rel) & (F.abs(c("plus")) > 1e-9), is_("target = source + constant", F.round(c("plus"), digits)))
        .when(scaled & close(t, times(s, c("ratio")), rel), F.when(~c("whole"), is_("target = source * constant", F.round(c("ratio"), 12))))
        .when(scaled & affine, F.when(F.abs(c("slope") + 1) > rel, is_("target = source * constant + offset", F.round(c("slope"), 12), F.round(c("offset"), digits))))
        .when(scaled & c("filled") & differs(c("inverses")) & close(t, times(c("inverses"), c("over")), rel), is_("target = constant / source", F.round(c("over"), 12)))
    )
    of = lambda vals, x: F.transform(vals, lambda _: x)
    sums = F.zip_with(s, t, lambda x, y: x + y)
    minus = F.when(close(sums, of(sums, c("sum")), rel) & (F.abs(c("sum")) > 1e-9), is_("target = constant - source", F.round(c("sum"), digits)))
    filled = c("filled") & ~F.exists(t, lambda x: F.abs(x) <= 1e-9) & (F.abs(c("product")) > 1e-9)
    by = F.when(filled & close(c("products"), of(c("products"), c("product")), rel), is_("target = constant / source", F.round(c("product"), 12)))
    by = F.when(~F.coalesce(c("first.relation") == "target = constant / source", F.lit(False)), by)
    rows = d.withColumn("first", first).withColumn("r", F.explode(F.array_compact(F.array(minus, c("first"), by))))
    return rows.select("a", "b", "pa", "pb", "r.relation", "r.constant", "length", "r.offset")
