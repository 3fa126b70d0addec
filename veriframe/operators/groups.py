"""Group summaries, distribution audit, progressions, pair sums and classical tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.stddev_samp(v) / F.sqrt(F.count(v)), 6).alias("sem"),
                                                   F.min(v).alias("min"), F.max(v).alias("max"), (F.count(v) - F.count_distinct(v)).alias("duplicates"))


def distribution(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Median, type-7 quartile range, sample-sd skewness and excess kurtosis, rounded to 5 places."""
    v = F.col(value)
    a = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count(v).alias("n"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k"))
    shrink = (F.col("n") - 1) / F.col("n")
    return a.select(*by, "n", F.round(F.col("q")[1], 5).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 5).alias("iqr"),
                    F.when(F.col("n") >= 3, F.round(F.col("s") * F.pow(shrink, 1.5), 5)).alias("skewness"), F.when(F.col("n") >= 4, F.round((F.col("k") + 3) * F.pow(shrink, 2) - 3, 5)).alias("excess_kurtosis"))


def progressions(df: DataFrame, by: list[str], order: list[str], value: str = "value", tolerance: float = 0.001, least: int = 5) -> DataFrame:
    """Groups of at least five values that rise or fall throughout; near-exact when steps deviate little."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), (F.col(value) - F.lag(value).over(w)).alias("d"))
    a = d.groupBy(*by).agg(F.count("v").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), ((F.max("v") - F.min("v")) / (F.count("v") - 1)).alias("step"))
    step = F.when(F.col("low") < 0, -F.col("step")).otherwise(F.col("step"))
    out = a.where((F.col("n") >= least) & ((F.col("low") >= 0) | (F.col("high") <= 0)) & (F.col("low") != 0) | (F.col("n") >= least) & (F.col("low") == 0) & (F.col("high") > 0))
    return out.select(*by, "n", F.round(step, 6).alias("step"), (F.greatest(F.abs(F.col("low") - step), F.abs(F.col("high") - step)) <= tolerance).alias("near_exact"))


def pair_sums(df: DataFrame, block: list[str], row: str, order: list[str], value: str = "value", digits: int = 6) -> DataFrame:
    """Alternate pairs (1,2), (3,4)... of each row and the share of the commonest rounded sum; constant_pair_sums has the whole rule."""
    w = Window.partitionBy(*block, row).orderBy(*order)
    p = df.where(F.col(value).isNotNull()).withColumn("k", F.floor((F.row_number().over(w) - 1) / 2))
    pairs = p.groupBy(*block, row, "k").agg(F.count("*").alias("c"), F.round(F.sum(value), digits).alias("s")).where("c = 2")
    modes = pairs.groupBy(*block, "s").agg(F.count("*").alias("m"), F.count_distinct(row).alias("r"))
    return modes.groupBy(*block).agg(F.sum("m").alias("pairs"), F.max(F.struct(F.col("m"), (-F.col("s")).alias("neg"))).alias("top")).select(*block, "pairs", F.col("top.m").alias("matching"), (-F.col("top.neg")).alias("target"),
        ((F.col("pairs") >= 12) & (F.col("top.m") >= F.greatest(F.lit(10), F.ceil(F.col("pairs") * 0.8)))).alias("candidate"))


def modal_cluster(ordered: Column, tolerance: float) -> Column:
    """struct<mean, n> of the largest cluster of sorted values, the first of equals; a value within tolerance of the running mean joins."""
    state = lambda total, n, best, best_n: F.struct(total.alias("total"), n.alias("n"), best.alias("best"), best_n.alias("best_n"))
    larger = lambda a: F.coalesce(a["n"] > a["best_n"], F.lit(False))
    best = lambda a: F.when(larger(a), a["total"] / a["n"]).otherwise(a["best"])

    def step(a: Column, x: Column) -> Column:
        near = (a["n"] > 0) & (F.abs(x - a["total"] / F.greatest(a["n"], F.lit(1))) <= tolerance)
        return F.when(near, state(a["total"] + x, a["n"] + 1, a["best"], a["best_n"])).otherwise(state(x, F.lit(1), best(a), F.greatest(a["n"], a["best_n"])))

    start = state(F.lit(0.0), F.lit(0), F.lit(None).cast("double"), F.lit(0))
    return F.aggregate(ordered, start, step, lambda a: F.struct(best(a).alias("mean"), F.greatest(a["n"], a["best_n"]).alias("n")))


def constant_pair_sums(df: DataFrame, block: list[str], row: str, order: list[str], value: str = "value", tolerance: float = 1e-9) -> DataFrame:
    """The surveyed screen (A12, A13): modal cluster of the pair sums of rows with two pairs at least, with row totals."""
    w = Window.partitionBy(*block, row).orderBy(*order)
    v = F.col(value).cast("double")
    p = df.where(v.isNotNull() & ~F.isnan(v)).withColumn("k", F.floor((F.row_number().over(w) - 1) / 2))
    pairs = p.groupBy(*block, row, "k").agg(F.count("*").alias("c"), F.sum(v).alias("s")).where("c = 2")
    rows = pairs.groupBy(*block, row).agg(F.count("*").alias("n"), F.sum("s").alias("total"), F.collect_list("s").alias("sums")).where("n >= 2")
    a = rows.groupBy(*block).agg(F.sum("n").alias("pairs"), F.count("*").alias("rows"), F.array_sort(F.flatten(F.collect_list("sums"))).alias("sums"), F.collect_list(F.struct("n", "total")).alias("totals"))
    a = a.withColumn("mode", modal_cluster(F.col("sums"), tolerance))
    matches = F.size(F.filter("totals", lambda r: F.abs(r["total"] - F.col("mode.mean") * r["n"]) <= tolerance * r["n"]))
    share = lambda least, of: F.greatest(F.lit(least), F.ceil(F.col(of) * 0.8))
    a = a.select(*block, "pairs", "rows", F.col("mode.n").alias("matching"), F.col("mode.mean").alias("target"), matches.alias("row_matches"))
    return a.withColumn("candidate", (F.col("pairs") >= 12) & (F.col("rows") >= 4) & (F.col("matching") >= share(10, "pairs")) & (F.col("row_matches") >= share(4, "rows")))


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_p(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_p(x: float, k: float) -> float:
    """Upper tail; series below the mean, continued fraction above."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= y / n
            total += term
        return 1 - front * total
    b, c = y + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def tests(df: DataFrame, group: str, value: str, pair: tuple | None = None) -> DataFrame:
    """test, statistic, df1, df2: Welch and Student t and rank sum of a pair of groups, ANOVA and Kruskal-Wallis of all."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def ranked(x: DataFrame) -> DataFrame:
        tie = x.groupBy("v").agg(F.count("*").alias("t")).withColumn("rank", before + (F.col("t") + 1) / 2)
        return x.groupBy("g", "v").agg(F.count("*").alias("c")).join(tie, "v")

    m = {r["g"]: r for r in d.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).collect()}  # one row a group
    out = []
    if pair and all(p in m and m[p]["n"] > 1 for p in pair):
        a, b = (m[p] for p in pair)
        se = a["s"] / a["n"], b["s"] / b["n"]
        if sum(se):
            t = (a["m"] - b["m"]) / math.sqrt(sum(se))
            df_ = sum(se) ** 2 / (se[0] ** 2 / (a["n"] - 1) + se[1] ** 2 / (b["n"] - 1))
            out.append(("welch_t", t, df_, None, t_p(t, df_)))
            k = a["n"] + b["n"] - 2
            s = ((a["n"] - 1) * a["s"] + (b["n"] - 1) * b["s"]) / k
            t = (a["m"] - b["m"]) / math.sqrt(s * (1 / a["n"] + 1 / b["n"]))
            out.append(("student_t", t, float(k), None, t_p(t, k)))
        r = ranked(d.where(F.col("g").isin(*pair)))
        ties = sum_ties(r)
        rank_sum = r.where(F.col("g") == pair[0]).agg(F.sum(F.col("rank") * F.col("c"))).first()[0]
        n1, n2 = a["n"], b["n"]
        w = rank_sum - n1 * (n1 + 1) / 2
        var = n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))
        z = w - n1 * n2 / 2
        z = (z - math.copysign(0.5, z) * (z != 0)) / math.sqrt(var) if var else 0.0
        out.append(("rank_sum", w, None, None, math.erfc(abs(z) / math.sqrt(2))))
    k, n = len(m), sum(r["n"] for r in m.values())
    if k > 2 and n > k:
        grand = sum(r["n"] * r["m"] for r in m.values()) / n
        ssb, ssw = sum(r["n"] * (r["m"] - grand) ** 2 for r in m.values()), sum((r["n"] - 1) * (r["s"] or 0) for r in m.values())
        f = ssb / (k - 1) / (ssw / (n - k)) if ssw else float("inf")
        out.append(("anova", f, float(k - 1), float(n - k), f_p(f, k - 1, n - k)))
        r = ranked(d)
        sums = r.groupBy("g").agg(F.sum(F.col("rank") * F.col("c")).alias("s"), F.sum("c").alias("n")).collect()
        h = 12 / (n * (n + 1)) * sum(x["s"] ** 2 / x["n"] for x in sums) - 3 * (n + 1)
        h /= 1 - sum_ties(r) / (n**3 - n) or 1.0
        out.append(("kruskal_wallis", h, float(k - 1), None, chi2_p(h, k - 1)))
    return d.sparkSession.createDataFrame(pd.DataFrame(out, columns=["test", "statistic", "df1", "df2", "p_value"]) if out else [], "test string, statistic double, df1 double, df2 double, p_value double")


def sum_ties(ranked: DataFrame) -> float:
    t = F.col("t").cast("double")
    return ranked.select("v", "t").distinct().agg(F.coalesce(F.sum(t * t * t - t), F.lit(0.0))).first()[0]


def t_quantile(p: float, df: float) -> float:
    """Of Student's t, for p over a half; by bisection on the two-sided tail."""
    low, high = 0.0, 1.0
    while t_p(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def figure_summary(df: DataFrame, group: str, value: str, order: str, error: str = "sd") -> DataFrame:
    """Groups by first appearance: place, n, mean, sd, sem, ci95 and the error to plot (sd, sem, ci or none)."""
    half = F.udf(lambda n: t_quantile(0.975, max(n - 1, 1)), "double", useArrow=True)  # one value a group
    s = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.min(order).alias("first"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    s = s.withColumn("sem", F.col("sd") / F.sqrt("n")).withColumn("ci95", F.when(F.col("sem").isNotNull(), half("n") * F.col("sem")))
    shown = {"sd": F.col("sd"), "sem": F.col("sem"), "ci": F.col("ci95")}.get(error, F.lit(None).cast("double"))
    return s.withColumns({"place": F.row_number().over(Window.orderBy("first")), "plotted_error": shown}).drop("first")
