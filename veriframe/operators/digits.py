"""Digit and decimal screens: one shuffle each, counts summed before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N

# Screening thresholds.
MIN_N, CONCENTRATION, TERMINAL, ENTROPY, UNIFORM_CHI, BENFORD_CHI, BENFORD_N, BENFORD_SPAN = 20, 0.35, 0.40, 2.5, 27.88, 26.12, 50, 100


def flags(*pairs: tuple[str, Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in pairs])), ";")


def digit_summary(cells: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """Last- and first-digit distribution of the numeric texts of each group."""
    c = F.col(raw)
    df = cells.where(N.is_number(c)).select(*by, N.last_digit(c).alias("ld"), N.first_digit(c).alias("fd"), F.abs(N.cleaned(c).cast("double")).alias("v"))
    nz = F.when(F.col("v") > 0, F.col("v"))
    agg = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(nz).alias("nonzero"), (F.max(nz) / F.min(nz)).alias("span"),
                              *[F.count_if(F.col("ld") == str(k)).alias(f"l{k}") for k in range(10)],
                              *[F.count_if((F.col("fd") == str(k)) & (F.col("v") > 0)).alias(f"f{k}") for k in range(1, 10)])
    last = [F.col(f"l{k}") for k in range(10)]
    n = F.col("n")
    plus = lambda xs: sum(xs[1:], xs[0])
    entropy = plus([F.when(x > 0, -(x / n) * F.log2(x / n)).otherwise(0.0) for x in last])
    first = [(F.col(f"f{k}"), F.log10(F.lit(1 + 1 / k)) * F.col("nonzero")) for k in range(1, 10)]
    benford = F.when((F.col("nonzero") >= BENFORD_N) & (F.col("span") >= BENFORD_SPAN), plus([(x - e) * (x - e) / e for x, e in first]))
    out = agg.select(*by, "n", F.round(entropy, 6).alias("entropy"), F.round(plus([x * x for x in last]) * 10.0 / n - n, 6).alias("chi_square"),
                     F.round(F.greatest(*last) / n, 6).alias("max_fraction"), F.round((last[0] + last[5]) / n, 6).alias("zero_five_fraction"), F.round(benford, 6).alias("benford_chi_square"))
    enough = n >= MIN_N
    return out.withColumn("flags", F.when(~enough, F.lit("small_n_digit_distribution_summary_only")).otherwise(flags(
        ("last_digit_concentration", F.col("max_fraction") >= CONCENTRATION), ("terminal_0_or_5_enrichment", F.col("zero_five_fraction") >= TERMINAL),
        ("low_last_digit_entropy", F.col("entropy") < ENTROPY), ("last_digit_nonuniform", F.col("chi_square") >= UNIFORM_CHI), ("benford_deviation", F.col("benford_chi_square") >= BENFORD_CHI))))


def column_audit(melted: DataFrame, by: list[str], denominator: int | None = None, numeric_share: float = 0.8) -> DataFrame:
    """Decimal audit of columns given as (by..., raw); columns with too few numbers are left out."""
    c = F.col("raw")
    x = melted.select(*by, c.alias("raw"), N.is_number(c).alias("num")).where("num or not lower(trim(raw)) in ('', 'na', 'nan', 'none', 'null')")
    x = x.select(*by, "num", F.when(F.col("num"), N.decimal_places(c)).alias("dp"), F.when(F.col("num"), N.last_digit(c)).alias("ld"), F.when(F.col("num"), N.cleaned(c).try_cast("double")).alias("v"))
    v, step = F.col("v"), 100.0 / denominator if denominator else None
    off = (v.between(0, 100) & (F.abs(v - F.bround(v / step) * step) > 1e-6)) if step else F.lit(False)
    # the places seen, as bits: no second aggregation for a distinct count
    agg = x.groupBy(*by).agg(F.count("*").alias("filled"), F.count("v").alias("n"), F.coalesce(F.bit_count(F.bit_or(F.expr("shiftleft(1L, least(dp, 62))"))), F.lit(0)).cast("long").alias("distinct_places"), F.max("dp").alias("max_places"), F.count_if(F.col("dp") >= 3).alias("long_decimals"),
                             F.count_if((v == F.floor(v)) & (F.col("dp") > 0)).alias("whole_as_decimal"), F.count_if(F.col("ld").isin("0", "5")).alias("zero_five"), F.count_if(off).alias("off_grid"))
    return agg.where(F.col("n") >= numeric_share * F.col("filled")).withColumn("flags", flags(
        ("mixed_decimal_precision", F.col("distinct_places") > 2), ("long_decimal", F.col("long_decimals") > 0), ("integer_reported_as_decimal", F.col("whole_as_decimal") > 0),
        ("terminal_0_or_5_enrichment", (F.col("n") >= 20) & (F.col("zero_five") >= 0.45 * F.col("n"))), ("denominator_incompatible", F.col("off_grid") > 0)))


def exact_repeats(cells: DataFrame, min_places: int = 3, high_places: int = 6) -> DataFrame:
    """Groups of the same long decimal text: value, places, count, risk."""
    c = F.col("raw")
    d = cells.where(N.is_number(c) & (N.decimal_places(c) >= min_places)).groupBy("raw").agg(F.count("*").alias("count")).where("count > 1")
    high = (N.decimal_places(c) >= high_places) & ~N.float_artifact(c)
    return d.select(c.alias("value"), N.decimal_places(c).alias("places"), "count", F.when(high, "HIGH-RISK_REVIEW").otherwise("WARN_REVIEW").alias("risk"))


def inventory(cells: DataFrame, by: list[str]) -> DataFrame:
    """Filled, numeric and text cells and decimal places of each group."""
    c, num = F.col("raw"), F.col("num")
    x = cells.select(*by, N.is_number(c).alias("num"), F.coalesce(F.trim(c) != "", F.lit(False)).alias("filled"), c.alias("raw")).select(*by, "num", "filled", F.when(num, N.decimal_places(c)).alias("dp"))
    return x.groupBy(*by).agg(F.count_if("filled").alias("nonempty"), F.count_if("num").alias("numeric"), F.count_if(~num & F.col("filled")).alias("text"), F.coalesce(F.max("dp"), F.lit(0)).alias("max_places"),
                              F.count_if(F.col("dp") >= 3).alias("places_3"), F.count_if(F.col("dp") >= 8).alias("places_8"))


def sheet_inventory(cells: DataFrame) -> DataFrame:
    """Of each sheet: last row and column, filled, numeric, text and formula cells, decimal places."""
    by = ["workbook", "sheet"]
    formulas = F.count_if(F.coalesce(F.col("formula") != "", F.lit(False))) if "formula" in cells.columns else F.lit(0).cast("long")
    size = cells.groupBy(*by).agg(F.max("row").alias("rows"), F.max("col").alias("cols"), formulas.alias("formula_cells"))
    return size.join(inventory(cells, by), by)
