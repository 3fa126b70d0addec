"""The standard run: all screens of a table of cells in one session, with fixed settings."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators import digits, findings, formulas, layout, relations, sequences
from .lineage import cut


@dataclass(frozen=True)
class AuditConfig:
    """Settings of a run; the defaults are the standard ones."""

    repeat_places: int = 3
    high_places: int = 6
    shortest_sequence: int = 3
    window_lengths: tuple[int, int] = (3, 6)
    window_values: int = 80  # longer blocks are dealt in shares of so many positions; none is left out
    relative: float = 1e-6
    matrix_share: float = 0.8
    matrix_cells: int = 12
    report_limit: int = 50


def preflight(spark: SparkSession, config: AuditConfig) -> list[str]:
    """What stands against a run; empty if nothing does."""
    out = [] if int(pyspark.__version__.split(".")[0]) >= 4 else ["PySpark 4 or later is needed"]
    if spark.version != pyspark.__version__:
        out.append(f"the cluster runs Spark {spark.version}, the client {pyspark.__version__}")
    if not 2 < config.window_lengths[0] <= config.window_lengths[1]:
        out.append("windows have three values at least")
    if config.window_values < 1:
        out.append("a share of a block has one position at least")
    return out


def screens(cells: DataFrame, config: AuditConfig = AuditConfig()) -> dict[str, Callable[[], DataFrame]]:
    """Each screen by name; nothing runs until it is called."""
    sheet = ["workbook", "sheet"]
    blocks = []

    def block() -> DataFrame:
        if not blocks:
            b = layout.group_blocks(cells)
            name = F.concat_ws("!", "workbook", "sheet", "panel", "row", F.lpad("group_start", 5, "0"))
            blocks.append(cut(b.where(~layout.L.is_axis(F.col("group"))).select(*sheet, "panel", "row", "group", "context", "vals", name.alias("block"))))
        return blocks[0]

    place = [*sheet, "panel", "row"]
    return {
        "sheet_summary": lambda: digits.sheet_inventory(cells),
        "numeric_cells": lambda: layout.numeric_cells(cells),
        "panel_labels": lambda: layout.typed(cells).where(layout.L.is_figure(F.col("raw"))).select(*sheet, "row", "col", "raw"),
        "digit_summary": lambda: digits.digit_summary(cells, sheet),
        "exact_repeats": lambda: digits.exact_repeats(cells, config.repeat_places, config.high_places),
        "group_blocks": lambda: layout.block_summary(layout.group_blocks(cells)),
        "duplicate_sequences": lambda: sequences.duplicate_sequences(block(), "block", config.shortest_sequence),
        "shared_runs": lambda: sequences.shared_runs(block(), "block", config.shortest_sequence),
        "scaled_vectors": lambda: sequences.scaled_vectors(block(), "block", place, config.relative),
        "window_relations": lambda: relations.maximal_windows(sequences.window_relations(block(), "block", place, *[config.window_lengths[0]], longest=config.window_lengths[1], rel=config.relative)),
        "window_triples": lambda: relations.maximal_triples(relations.window_triples(block(), "block", place, *config.window_lengths, rel=config.relative, share=config.window_values)),
        "matrix_overlap": lambda: layout.summary_mismatches(layout.matrix_overlap(cells, config.matrix_share, config.matrix_cells), cells),
    } | ({"formula_recheck": lambda: formulas.recheck(cells)} if "formula" in cells.columns else {})


def candidates(made: dict[str, DataFrame]) -> DataFrame:
    """Findings of the screens with a risk: category, id, risk, place, detail."""
    parts = []
    if "matrix_overlap" in made:
        parts.append(made["matrix_overlap"].select(F.lit("Numeric matrix reuse").alias("category"), "risk", F.concat_ws("!", "workbook", "sheet").alias("place"), F.concat_ws(" ", "match_type", "matched").alias("detail")))
    if "exact_repeats" in made:
        parts.append(made["exact_repeats"].select(F.lit("Exact long-decimal repeat").alias("category"), "risk", F.lit("").alias("place"), F.concat_ws(" x ", "value", "count").alias("detail")))
    if "formula_recheck" in made:
        bad = findings.unmatched(made["formula_recheck"])
        parts.append(bad.select(F.lit("Formula validation").alias("category"), F.when(F.col("verdict") == "MISMATCH", "HIGH-RISK_REVIEW").otherwise("WARN_REVIEW").alias("risk"), F.concat_ws("!", "workbook", "sheet", F.concat_ws(",", "row", "col")).alias("place"), F.concat_ws(" ", "verdict", "formula").alias("detail")))
    if "scaled_vectors" in made:
        parts.append(made["scaled_vectors"].select(F.lit("Fixed-ratio numeric vectors").alias("category"), F.lit("WARN_TO_HIGH-RISK_REVIEW").alias("risk"), F.concat_ws(" and ", "a", "b").alias("place"), F.col("ratio").cast("string").alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return findings.numbered(out, "FND", ["category", F.when(F.col("risk").contains("HIGH"), 0).otherwise(1), "place", "detail"])


def run_audit(cells: DataFrame, out: str, config: AuditConfig = AuditConfig(), dry_run: bool = False) -> dict[str, str]:
    """Writes all screens, findings, a report and a manifest below out; a dry run names what it would write."""
    spark = cells.sparkSession
    if against := preflight(spark, config):
        raise ValueError("; ".join(against))
    todo = screens(cells, config)
    if dry_run:
        return {name: f"{out}/{name}" for name in todo}
    paths = sinks.write_screens({name: make() for name, make in todo.items()}, out)
    found = candidates(sinks.read_screens(spark, paths))
    paths |= sinks.write_screens({"findings": found}, out)
    found = spark.read.parquet(paths["findings"])
    sinks.write_text(spark, f"{out}/report.md", sinks.markdown(found, config.report_limit))
    sinks.write_text(spark, f"{out}/report.html", sinks.page(found, config.report_limit))
    sinks.write_text(spark, f"{out}/manifest.json", json.dumps(sinks.manifest(spark, asdict(config)), indent=1))
    return paths
