"""Queries of the screening operators on the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import digits, findings, formulas, groups, hashes, relations, sequences
from ..sources.workbooks import melt
from . import sheets

NUMERIC = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"]


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def prices(s, d):
    return load(s, d, "lineitem").select("l_returnflag", "l_suppkey", F.col("l_extendedprice").cast("string").alias("raw"))


def event_values(s, d):
    return load(s, d, "events").select("event_type", "user_id", "event_id", F.col("value"), F.col("value").cast("string").alias("raw"))


def scalars(s, d):
    c = F.col("raw")
    return prices(s, d).select(N.decimal_places(c).alias("places"), N.last_digit(c).alias("last"), N.first_digit(c).alias("first")).groupBy("places", "last", "first").agg(F.count("*").alias("n"))


def sizes_by_brand(s, d):
    p = load(s, d, "part").where("p_size is not null").select((F.col("p_partkey") % 97).alias("block"), "p_partkey", F.col("p_size").cast("double").alias("v"))
    return sequences.blocks(p, ["block"], ["p_partkey"], "v").withColumn("sheet", F.lit(1))


def retail_by_block(s, d):
    p = load(s, d, "part").select(F.floor(F.col("p_partkey") / 10).cast("long").alias("block"), "p_partkey", F.round("p_retailprice", 2).alias("v"))
    return sequences.blocks(p, ["block"], ["p_partkey"], "v").withColumn("sheet", F.floor(F.col("block") / 5).cast("long"))


def image_hashes(s, d, parts):
    """Pictures of few distinct parts: each of the first components stands for 64 / parts pixels."""
    pixels = F.flatten(F.transform(F.slice("embedding", 1, parts), lambda x: F.array_repeat(x, 64 // parts)))
    return hashes.vector_hashes(load(s, d, "embeddings").where("size(embedding) = 64").select("vec_id", pixels.alias("pixels")), "vec_id", "pixels")


def discounts_by_order(s, d):
    return sequences.blocks(load(s, d, "lineitem").withColumn("v", F.col("l_discount")), ["l_orderkey"], ["l_linenumber"], "v")


def sums_by_sheet(s, d):
    """Three blocks a sheet; the third of every other sheet is the sum of the first two."""
    p = load(s, d, "part").where("p_size is not null and p_retailprice is not null").select(F.floor(F.col("p_partkey") / 10).cast("long").alias("sheet"), "p_partkey", F.col("p_size").cast("double").alias("x"), F.round("p_retailprice", 2).alias("y"))
    z = F.when(F.col("sheet") % 2 == 0, F.col("x") + F.col("y")).otherwise(F.col("y") - F.col("p_partkey") % 7)
    long = p.withColumn("z", z).unpivot(["sheet", "p_partkey"], ["x", "y", "z"], "name", "v").withColumn("block", F.concat_ws("!", F.col("sheet").cast("string"), "name"))
    return sequences.blocks(long, ["sheet", "block"], ["p_partkey"], "v")


def formula_cells(s, d):
    """Sheets of 40 parts with a formula a row, a shared one, and totals below; every ninth stored value is off by one."""
    p = load(s, d, "part").where("p_size is not null and p_retailprice is not null").select(F.floor(F.col("p_partkey") / 40).cast("int").cast("string").alias("sheet"), (F.col("p_partkey") % 40 + 1).cast("int").alias("row"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    r, none = F.col("row").cast("string"), F.lit(None).cast("string")
    cell = lambda col, raw, formula=none, shared=none: p.select(F.lit("w").alias("workbook"), "sheet", "row", F.lit(col).alias("col"), raw.cast("string").alias("raw"), formula.alias("formula"), shared.alias("shared_index"))
    off = F.when(F.col("row") % 9 == 0, 1).otherwise(0)
    total = p.groupBy("sheet").agg(F.sum("a").alias("v"), F.avg("a").alias("m")).select(F.lit("w").alias("workbook"), "sheet", F.lit(50).alias("row"), F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("v").cast("string").alias("raw"), F.lit("SUM(A1:A40)").alias("formula")), F.struct(F.lit(2).alias("col"), F.col("m").cast("string").alias("raw"), F.lit("AVERAGE(A1:A40)").alias("formula")), F.struct(F.lit(3).alias("col"), F.lit("0").alias("raw"), F.lit("MEDIAN(A1:A40)").alias("formula")))).alias("x")).select("workbook", "sheet", "row", "x.col", "x.raw", "x.formula", none.alias("shared_index"))
    return cell(1, F.col("a")).union(cell(2, F.col("b"))).union(cell(3, F.col("a") * 2 + F.col("b") + off, F.concat(F.lit("A"), r, F.lit("*2+B"), r))).union(cell(4, F.col("b") - F.col("a"), F.when(F.col("row") == 1, "B1-A1").otherwise(""), F.lit("0"))).union(total)


def ordered_findings(s, d):
    """Exact repeats as numbered findings."""
    r = digits.exact_repeats(event_values(s, d), 2).withColumn("category", F.lit("Exact long-decimal repeat"))
    return findings.numbered(r, "EXREP", [F.desc("count"), "value"]).select("id", "value", "count", "risk")


QUERIES = {
    "scalar_functions": scalars,
    "inventory": lambda s, d: digits.inventory(melt(load(s, d, "lineitem"), [], NUMERIC), ["column"]),
    "digit_summary": lambda s, d: digits.digit_summary(prices(s, d), ["l_returnflag"]),
    "digit_summary_events": lambda s, d: digits.digit_summary(event_values(s, d), ["event_type"]),
    "column_audit": lambda s, d: digits.column_audit(melt(load(s, d, "lineitem"), [], NUMERIC), ["column"]),
    "exact_repeats": lambda s, d: digits.exact_repeats(event_values(s, d), 2),
    "group_summary": lambda s, d: groups.summary(prices(s, d).withColumn("value", F.col("raw").cast("double")), ["l_suppkey"]),
    "distribution_audit": lambda s, d: groups.distribution(event_values(s, d), ["event_type"]),
    "progressions": lambda s, d: groups.progressions(load(s, d, "part").select(F.floor(F.col("p_partkey") / 6).alias("block"), "p_partkey", F.col("p_retailprice").alias("value")), ["block"], ["p_partkey"]),
    "pair_sums": lambda s, d: groups.pair_sums(load(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("value")), ["l_suppkey"], "l_orderkey", ["l_linenumber", "value"], digits=2),
    "constant_pair_sums": lambda s, d: groups.constant_pair_sums(load(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("value")), ["l_suppkey"], "l_orderkey", ["l_linenumber", "value"]),
    "group_tests": lambda s, d: groups.tests(event_values(s, d), "event_type", "value", ("click", "view")).select("test", F.round("statistic", 4).alias("statistic"), F.round("df1", 3).alias("df1"), F.round("df2", 3).alias("df2")),
    "duplicate_sequences": lambda s, d: sequences.duplicate_sequences(discounts_by_order(s, d), "l_orderkey", 3).select("n", "members", "first_block"),
    "shared_runs": lambda s, d: sequences.shared_runs(sizes_by_brand(s, d), "block"),
    "scaled_vectors": lambda s, d: sequences.scaled_vectors(retail_by_block(s, d), "block", ["sheet"]),
    "window_relations": lambda s, d: sequences.window_relations(retail_by_block(s, d), "block", ["sheet"]),
    "near_images": lambda s, d: hashes.near_pairs(image_hashes(s, d, 16), "vec_id", 5, 8),
    "near_pages": lambda s, d: hashes.near_pairs(image_hashes(s, d, 8), "vec_id", 3, 5),
    "exact_images": lambda s, d: hashes.exact_groups(load(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha")), "sha", "doc_id"),
    "window_triples": lambda s, d: relations.maximal_triples(relations.window_triples(sums_by_sheet(s, d), "block", ["sheet"])),
    "formula_recheck": lambda s, d: formulas.recheck(formula_cells(s, d)).select("sheet", "row", "col", F.round("recalculated", 6).alias("recalculated"), "verdict"),
    "formula_verdicts": lambda s, d: formulas.verdicts(formulas.recheck(formula_cells(s, d))),
    "figure_summary": lambda s, d: groups.figure_summary(event_values(s, d), "event_type", "value", "event_id").select("event_type", "place", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sem")]),
    "numbered_repeats": ordered_findings,
    "risk_rollup": lambda s, d: findings.rollup(digits.exact_repeats(event_values(s, d), 1), "places"),
    "top_findings": lambda s, d: findings.top(digits.exact_repeats(event_values(s, d), 1), ["places"], [F.desc("count"), "value"], 10),
}

LD = "right(regexp_replace(raw, '[^0-9]', '', 'g'), 1)"
FD = "regexp_extract(raw, '[1-9]', 0)"
DP = "length(regexp_extract(raw, '\\.([0-9]*)$', 1))"
EV = "(SELECT event_type, value, CAST(value AS VARCHAR) AS raw FROM events WHERE value IS NOT NULL)"
PR = "(SELECT l_returnflag, l_suppkey, l_extendedprice AS value, CAST(l_extendedprice AS VARCHAR) AS raw FROM lineitem WHERE l_extendedprice IS NOT NULL)"
MELT = "(" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, CAST({c} AS VARCHAR) AS raw FROM lineitem WHERE {c} IS NOT NULL" for c in NUMERIC) + ")"


def digit_sql(source: str, by: str) -> str:
    return f"""
WITH c AS (SELECT {by}, {LD} AS ld, {FD} AS fd, abs(value) AS v FROM {source}),
l AS (SELECT {by}, ld, count(*) AS k FROM c GROUP BY ALL),
t AS (SELECT {by}, count(*) AS n, count(*) FILTER (v > 0) AS nz, max(v) FILTER (v > 0) / min(v) FILTER (v > 0) AS span FROM c GROUP BY ALL),
a AS (SELECT {by}, any_value(n) AS n, -sum(k / n * log2(k / n)) AS e, sum(k * k) * 10.0 / any_value(n) - any_value(n) AS x, max(k) / any_value(n) AS m,
      coalesce(sum(k) FILTER (ld IN ('0', '5')), 0) / any_value(n) AS z FROM l JOIN t USING ({by}) GROUP BY {by}),
f AS (SELECT {by}, g.d, count(fd) AS k FROM (SELECT DISTINCT {by} FROM c) CROSS JOIN range(1, 10) g(d) LEFT JOIN (SELECT * FROM c WHERE v > 0) c2 USING ({by})
      WHERE c2.fd = CAST(g.d AS VARCHAR) GROUP BY ALL),
b AS (SELECT {by}, sum(power(coalesce(k, 0) - nz * log10(1 + 1 / d), 2) / (nz * log10(1 + 1 / d))) AS b FROM (SELECT t.*, r.d FROM t CROSS JOIN range(1, 10) r(d)) LEFT JOIN f USING ({by}, d) WHERE nz >= 50 AND span >= 100 GROUP BY {by}),
r AS (SELECT {by}, n, round(e, 6) AS entropy, round(x, 6) AS chi_square, round(m, 6) AS max_fraction, round(z, 6) AS zero_five_fraction, round(b, 6) AS benford_chi_square FROM a LEFT JOIN b USING ({by}))
SELECT *, CASE WHEN n < 20 THEN 'small_n_digit_distribution_summary_only' ELSE concat_ws(';', CASE WHEN max_fraction >= 0.35 THEN 'last_digit_concentration' END,
  CASE WHEN zero_five_fraction >= 0.4 THEN 'terminal_0_or_5_enrichment' END, CASE WHEN entropy < 2.5 THEN 'low_last_digit_entropy' END,
  CASE WHEN chi_square >= 27.88 THEN 'last_digit_nonuniform' END, CASE WHEN benford_chi_square >= 26.12 THEN 'benford_deviation' END) END AS flags FROM r"""


def repeats_sql(least: int) -> str:
    return f"SELECT raw AS value, CAST({DP} AS INTEGER) AS places, count(*) AS count, CASE WHEN {DP} >= 6 AND NOT (regexp_matches(raw, '000000|999999') AND {DP} > 6) THEN 'HIGH-RISK_REVIEW' ELSE 'WARN_REVIEW' END AS risk FROM {EV} WHERE {DP} >= {least} GROUP BY raw HAVING count(*) > 1"


def near_sql(d: int, a: int, parts: int) -> str:
    return f"""WITH p AS (SELECT vec_id, list_transform(range(0, 64), lambda i: embedding[i // {64 // parts} + 1]) AS x FROM embeddings WHERE len(embedding) = 64),
m AS (SELECT vec_id, x, list_sum(list_transform(x, lambda e: CAST(e AS DOUBLE))) / 64 AS m FROM p),
h AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x[i] > m THEN CAST(1 AS HUGEINT) << (64 - i) ELSE 0 END)) AS HUGEINT) AS a,
 CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x[i] > x[i % 64 + 1] THEN CAST(1 AS HUGEINT) << (64 - i) ELSE 0 END)) AS HUGEINT) AS d FROM m)
SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.d, y.d)) AS INTEGER) AS dhash_distance, CAST(bit_count(xor(x.a, y.a)) AS INTEGER) AS ahash_distance
FROM h x JOIN h y ON x.vec_id < y.vec_id AND bit_count(xor(x.d, y.d)) <= {d} AND bit_count(xor(x.a, y.a)) <= {a}"""


SHRINK = "sum(power(value - mu, {k})) / count(*) / power(any_value(sd), {k})"
ORACLES = {
    "scalar_functions": f"SELECT CAST({DP} AS INTEGER) AS places, {LD} AS \"last\", {FD} AS \"first\", count(*) AS n FROM {PR} GROUP BY ALL",
    "inventory": f"SELECT \"column\", count(*) AS nonempty, count(*) AS numeric, CAST(0 AS BIGINT) AS text, CAST(max({DP}) AS INTEGER) AS max_places, count(*) FILTER ({DP} >= 3) AS places_3, count(*) FILTER ({DP} >= 8) AS places_8 FROM {MELT} GROUP BY 1",
    "digit_summary": digit_sql(PR, "l_returnflag"),
    "digit_summary_events": digit_sql(EV, "event_type"),
    "column_audit": f"""WITH a AS (SELECT "column", count(*) AS filled, count(*) AS n, count(DISTINCT {DP}) AS distinct_places, CAST(max({DP}) AS INTEGER) AS max_places, count(*) FILTER ({DP} >= 3) AS long_decimals,
 count(*) FILTER (value = floor(value) AND {DP} > 0) AS whole_as_decimal, count(*) FILTER ({LD} IN ('0', '5')) AS zero_five, CAST(0 AS BIGINT) AS off_grid FROM {MELT} GROUP BY 1)
 SELECT *, concat_ws(';', CASE WHEN distinct_places > 2 THEN 'mixed_decimal_precision' END, CASE WHEN long_decimals > 0 THEN 'long_decimal' END, CASE WHEN whole_as_decimal > 0 THEN 'integer_reported_as_decimal' END,
 CASE WHEN n >= 20 AND zero_five >= 0.45 * n THEN 'terminal_0_or_5_enrichment' END) AS flags FROM a""",
    "exact_repeats": repeats_sql(2),
    "group_summary": f"SELECT l_suppkey, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem, min(value) AS min, max(value) AS max, count(*) - count(DISTINCT value) AS duplicates FROM {PR} GROUP BY 1",
    "distribution_audit": f"""WITH m AS (SELECT event_type, avg(value) AS mu, stddev_samp(value) AS sd FROM {EV} GROUP BY 1)
 SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 5) AS iqr,
 round({SHRINK.format(k=3)}, 5) AS skewness, round({SHRINK.format(k=4)} - 3, 5) AS excess_kurtosis FROM {EV} JOIN m USING (event_type) GROUP BY 1""",
    "progressions": """WITH d AS (SELECT floor(p_partkey / 6)::BIGINT AS block, p_retailprice AS v, p_retailprice - lag(p_retailprice) OVER (PARTITION BY floor(p_partkey / 6) ORDER BY p_partkey) AS d FROM part WHERE p_retailprice IS NOT NULL),
 a AS (SELECT block, count(*) AS n, min(d) AS lo, max(d) AS hi, (max(v) - min(v)) / (count(*) - 1) * CASE WHEN min(d) < 0 THEN -1 ELSE 1 END AS st FROM d GROUP BY 1)
 SELECT block, n, round(st, 6) AS step, greatest(abs(lo - st), abs(hi - st)) <= 0.001 AS near_exact FROM a WHERE n >= 5 AND (lo >= 0 OR hi <= 0) AND NOT (lo = 0 AND hi = 0)""",
    "pair_sums": """WITH p AS (SELECT l_suppkey, l_orderkey, l_quantity AS v, (row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_quantity) - 1) // 2 AS k FROM lineitem WHERE l_quantity IS NOT NULL),
 s AS (SELECT l_suppkey, l_orderkey, round(sum(v), 2) AS s FROM p GROUP BY l_suppkey, l_orderkey, k HAVING count(*) = 2), m AS (SELECT l_suppkey, s, count(*) AS m FROM s GROUP BY ALL),
 t AS (SELECT *, sum(m) OVER (PARTITION BY l_suppkey) AS pairs, row_number() OVER (PARTITION BY l_suppkey ORDER BY m DESC, s) AS r FROM m)
 SELECT l_suppkey, CAST(pairs AS BIGINT) AS pairs, m AS matching, s AS target, pairs >= 12 AND m >= greatest(10, ceil(pairs * 0.8)) AS candidate FROM t WHERE r = 1""",
    "duplicate_sequences": """WITH b AS (SELECT l_orderkey, list(l_discount ORDER BY l_linenumber, l_discount) AS v FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1)
 SELECT CAST(len(v) AS INTEGER) AS n, count(*) AS members, min(l_orderkey) AS first_block FROM b WHERE len(v) >= 3 AND list_min(v) < list_max(v) GROUP BY v HAVING count(*) > 1""",
    "shared_runs": """WITH b AS (SELECT p_partkey % 97 AS block, list(p_size ORDER BY p_partkey, p_size) AS v FROM part WHERE p_size IS NOT NULL GROUP BY 1),
 g AS (SELECT block, unnest(range(1, len(v) - 1)) AS pos, v FROM b WHERE len(v) >= 3), w AS (SELECT block, pos, v[pos] AS x, v[pos + 1] AS y, v[pos + 2] AS z FROM g),
 p AS (SELECT a.block AS a, b.block AS b, a.pos AS pa, b.pos AS pb, a.x <> a.y OR a.y <> a.z AS varies FROM w a JOIN w b ON a.block < b.block AND a.x = b.x AND a.y = b.y AND a.z = b.z),
 i AS (SELECT *, pa - row_number() OVER (PARTITION BY a, b, pa - pb ORDER BY pa) AS island FROM p),
 r AS (SELECT a, b, count(*) AS k, min(pa) AS pa, min(pb) AS pb, bool_or(varies) AS varies FROM i GROUP BY a, b, pa - pb, island),
 o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY k DESC, pa, pb) AS r FROM r)
 SELECT a, b, CAST(k + 2 AS INTEGER) AS length, CAST(pa AS INTEGER) AS offset_a, CAST(pb AS INTEGER) AS offset_b FROM o WHERE r = 1 AND varies""",
    "scaled_vectors": """WITH b AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS block, list(round(p_retailprice, 2) ORDER BY p_partkey, p_retailprice) AS v FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1),
 c AS (SELECT CAST(floor(block / 5) AS BIGINT) AS sheet, * FROM b WHERE len(v) >= 3 AND list_min(v) < list_max(v)),
 j AS (SELECT a.sheet, a.block AS a, b.block AS b, a.v AS va, b.v AS vb, list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) / list_sum(list_transform(a.v, lambda x: x * x)) AS ratio FROM c a JOIN c b ON a.sheet = b.sheet AND a.block < b.block AND len(a.v) = len(b.v))
 SELECT sheet, a, b, round(ratio, 6) AS ratio FROM j WHERE abs(ratio - 1) > 1e-6 AND abs(ratio) > 1e-9 AND len(list_filter(list_zip(va, vb), lambda x: abs(x[2] - ratio * x[1]) > greatest(1e-9, 1e-6 * abs(x[2])))) = 0""",
    "group_tests": f"""WITH e AS {EV}, m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS s FROM e GROUP BY 1),
 x AS (SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.s / a.n AS e1, b.s / b.n AS e2, a.s AS s1, b.s AS s2 FROM m a, m b WHERE a.g = 'click' AND b.g = 'view'),
 r2 AS (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM e WHERE event_type IN ('click', 'view')),
 ra AS (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM e), k AS (SELECT g, sum(r) AS s, count(*) AS n FROM ra GROUP BY 1),
 t AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS t FROM (SELECT count(*) AS c FROM e GROUP BY value)), z AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mu, sum((n - 1) * s) AS w FROM m)
 SELECT 'welch_t' AS test, round((m1 - m2) / sqrt(e1 + e2), 4) AS statistic, round(power(e1 + e2, 2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), 3) AS df1, CAST(NULL AS DOUBLE) AS df2 FROM x
 UNION ALL SELECT 'student_t', round((m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 4), n1 + n2 - 2, NULL FROM x
 UNION ALL SELECT 'rank_sum', round((SELECT sum(r) FROM r2 WHERE g = 'click') - n1 * (n1 + 1) / 2.0, 4), NULL, NULL FROM x
 UNION ALL SELECT 'anova', round((SELECT sum(m.n * power(m - mu, 2)) FROM m) / (k - 1) / (w / (n - k)), 4), k - 1, n - k FROM z
 UNION ALL SELECT 'kruskal_wallis', round((12.0 / (n * (n + 1)) * (SELECT sum(s * s / k.n) FROM k) - 3 * (n + 1)) / (1 - (SELECT t FROM t) / (power(n, 3) - n)), 4), k - 1, NULL FROM z""",
    "formula_recheck": """WITH p AS (SELECT CAST(CAST(floor(p_partkey / 40) AS INTEGER) AS VARCHAR) AS sheet, CAST(p_partkey % 40 + 1 AS INTEGER) AS "row", CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL),
 o AS (SELECT DISTINCT sheet FROM p WHERE "row" = 1)
 SELECT sheet, "row", 3 AS col, round(a * 2 + b, 6) AS recalculated, CASE WHEN "row" % 9 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS verdict FROM p
 UNION ALL SELECT sheet, "row", 4, CASE WHEN o.sheet IS NOT NULL THEN round(b - a, 6) END, CASE WHEN o.sheet IS NULL THEN 'UNSUPPORTED_EMPTY_OR_SHARED_WITHOUT_ORIGIN' ELSE 'MATCH' END FROM p LEFT JOIN o USING (sheet)
 UNION ALL SELECT sheet, 50, 1, round(sum(a), 6), 'MATCH' FROM p GROUP BY sheet UNION ALL SELECT sheet, 50, 2, round(avg(a), 6), 'MATCH' FROM p GROUP BY sheet UNION ALL SELECT sheet, 50, 3, NULL, 'UNSUPPORTED_FUNCTION_MEDIAN' FROM p GROUP BY sheet""",
    "figure_summary": f"SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS place, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM (SELECT event_type, event_id, value FROM events WHERE value IS NOT NULL) GROUP BY event_type",
    "numbered_repeats": f"SELECT concat('EXREP-', lpad(CAST(n AS VARCHAR), CAST(greatest(4, len(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS id, value, count, risk FROM (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS n FROM ({repeats_sql(2)}))",
    "near_images": near_sql(5, 8, 16),
    "near_pages": near_sql(3, 5, 8),
    "exact_images": "SELECT sha256(text) AS sha, count(*) AS members, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "risk_rollup": f"SELECT places, count(*) AS total, count(*) FILTER (contains(risk, 'HIGH')) AS high, count(*) FILTER (NOT contains(risk, 'HIGH')) AS warn FROM ({repeats_sql(1)}) GROUP BY 1",
    "top_findings": f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY places ORDER BY count DESC, value) AS INTEGER) AS rank FROM ({repeats_sql(1)})) WHERE rank <= 10",
}
ORACLES["formula_verdicts"] = f"SELECT verdict, count(*) AS n FROM ({ORACLES['formula_recheck']}) GROUP BY 1"
QUERIES |= sheets.QUERIES
ORACLES |= sheets.ORACLES
