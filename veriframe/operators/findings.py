"""Ranking, rollup and display limits of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_axis_or_id, is_derived
from ..plans.lineage import cut


def bucket(risk):
    return F.when(risk.contains("HIGH"), "HIGH").when(risk.contains("WARN"), "WARN").otherwise("OTHER")


def rollup(findings: DataFrame, category: str = "category", risk: str = "risk") -> DataFrame:
    b = bucket(F.col(risk))
    return findings.groupBy(category).agg(F.count("*").alias("total"), F.count_if(b == "HIGH").alias("high"), F.count_if(b == "WARN").alias("warn"))


def top(findings: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """First rows of each category; 0 means no limit."""
    ranked = findings.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


# Categories in the order of a report, weights of group flags.
CATEGORIES = (
    "Numeric matrix reuse", "Numeric sequence reuse", "Fixed-ratio numeric vectors", "Window arithmetic relation", "Exact long-decimal repeat", "Formula validation",
    "Group-level numeric screen", "Image integrity", "Image exact embedded duplicates", "Image near embedded matches", "Rendered page matches", "Rendered region candidates",
)
WEIGHTS = (("near_exact_arithmetic_progression", 100), ("constant_adjacent_pair_sum_pattern", 90), ("low_last_digit_entropy", 20), ("last_digit_concentration", 20), ("terminal_0_5_enrichment", 15), ("monotonic_nonconstant_sequence", 10))


def report_order(category: str = "category", risk: str = "risk", finding: str = "id") -> list:
    """Sort keys: the report's categories (others after them, by name), HIGH before WARN before others, then the id's number."""
    at = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col(category))
    b = bucket(F.col(risk))
    number = F.coalesce(F.regexp_extract(finding, r"(\d+)$", 1).try_cast("long"), F.lit(999_999))
    return [F.when(at > 0, at).otherwise(len(CATEGORIES) + 1), F.col(category), F.when(b == "HIGH", 0).when(b == "WARN", 1).otherwise(2), number, F.col(finding)]


def group_score(flags, n):
    """Weights of the flags that hold, and up to 20 for the size."""
    score = F.least(F.lit(20), F.coalesce(n.cast("int"), F.lit(0)))
    for flag, weight in WEIGHTS:
        score = score + F.when(F.coalesce(flags.contains(flag), F.lit(False)), weight).otherwise(0)
    return score


def repeat_order(risk: str = "risk", places: str = "places", count: str = "count", value: str = "value") -> list:
    """HIGH first, then most places, most repeats, and the value from the last."""
    return [F.when(F.col(risk).contains("HIGH"), 0).otherwise(1), F.desc(places), F.desc(count), F.desc(value)]


def numbered(df: DataFrame, prefix: str, order: list, name: str = "id") -> DataFrame:
    """Ids PREFIX-0001 and so on by global order; each partition numbers its own rows from the sum of those before it."""
    done = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = done.groupBy(part.alias("__p")).count()  # one row a partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__p", before.alias("__start"))
    out = done.withColumn("__p", part).join(F.broadcast(starts), "__p")
    number = (F.col("__start") + within + 1).cast("string")
    return out.withColumn(name, F.concat(F.lit(f"{prefix}-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")))).drop("__p", "__at", "__start")


def capped(df: DataFrame, by: list[str], order: list, cap: int) -> DataFrame:
    """The first rows of each group, at most cap of them; 0 means no cap. For reports that state the cap."""
    if not cap:
        return df
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= cap).drop("__k")


def unmatched(formulas: DataFrame, verdict: str = "verdict") -> DataFrame:
    return formulas.where(F.col(verdict) != "MATCH")


def flagged(groups: DataFrame, flags: str = "flags") -> DataFrame:
    """Group screens with any of the weighted flags."""
    return groups.where(F.exists(F.array(*[F.lit(f) for f, _ in WEIGHTS]), lambda f: F.col(flags).contains(f)))


def independence(panel_a, panel_b, group_a, group_b, context_a, context_b):
    """struct<independent, hint> of two blocks; groups and contexts are normalised labels."""
    panel, group = panel_a == panel_b, group_a == group_b
    apart = (context_a != context_b) | ((context_a == "") & (context_b == ""))
    hint = (
        F.when(panel & group & apart, "same_panel_same_condition_different_readout_or_cytokine").when(panel & ~group, "same_panel_adjacent_or_distinct_condition").when(~panel & group, "cross_panel_same_condition")
        .when(panel & group, "same_panel_same_condition_same_context_shared_source_possible").otherwise("independence_unclear")
    )
    return F.struct(((panel & group & apart) | (panel != group)).alias("independent"), hint.alias("hint"))


def shared_source(group_a, group_b, context_a, context_b):
    same = (context_a == context_b) & (context_a != "") & (group_a == group_b)
    return F.when(same, "possible_shared_source_check_formula_normalization_or_export_rule").otherwise("no_shared_source_documented_by_raw_layout")


def sequence_risk(independent, source):
    return F.when(independent & source.startswith("no_"), "HIGH-RISK_REVIEW").otherwise("WARN_REVIEW")


def scaled_risk(independent, source):
    return F.when(independent & source.startswith("no_"), "HIGH-RISK_REVIEW").when(source.startswith("possible"), "WARN_REVIEW").otherwise("WARN_TO_HIGH-RISK_REVIEW")


def block_role(panel, context, group, sheet):
    """derived, axis or primary, by a block's labels and its sheet's name."""
    text = F.concat_ws(" ", panel, context, group, sheet)
    return F.when(is_derived(text), "derived").when(is_axis_or_id(text), "axis").otherwise("primary")


def window_risk(roles: list, target_role, independent):
    clear = (target_role != "derived") & independent
    for r in roles:
        clear = clear & (r != "axis")
    return F.when(clear & (target_role != "axis"), "HIGH-RISK_REVIEW").otherwise("WARN_REVIEW")


def keep_maximal(rows: DataFrame, key: list[str], cells: str, order: list) -> DataFrame:
    """Of rows of one key, drops those whose cells are a subset of an earlier row's, by the given order.

    Supersets are transitive, so an earlier kept row covers what any earlier row covers; an anti-join on the first cell keeps
    rows apart that cannot cover each other.
    """
    ranked = cut(rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))))
    small = ranked.select(*key, "__rank", F.col(cells).alias("__cells"), F.array_min(cells).alias("__one"))
    large = ranked.select(*key, F.col("__rank").alias("__r2"), F.col(cells).alias("__c2"), F.explode(F.array_distinct(cells)).alias("__one"))
    covered = small.join(large, [*key, "__one"]).where((F.col("__r2") < F.col("__rank")) & (F.size(F.array_except("__cells", "__c2")) == 0)).select(*key, "__rank").distinct()
    return ranked.join(covered, [*key, "__rank"], "left_anti").drop("__rank")
