"""Panels, header rows, group blocks and copied matrices of irregular sheets, as relations over the filled cells.

Cells are workbook, sheet, row, col (from 1) and raw. Everything is joined and windowed by sheet; a sheet is never
collected. Cells without text do not matter; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N
from ..plans.lineage import cut

SHEET = ["workbook", "sheet"]
HEADER = [*SHEET, "row", "start", "end"]


def typed(cells: DataFrame) -> DataFrame:
    """The filled cells with is_num, is_text, value."""
    raw = F.trim("raw")
    return cells.where(L.filled(F.col("raw"))).select(*SHEET, "row", "col", raw.alias("raw"), N.is_number(raw).alias("is_num"), L.is_text(raw).alias("is_text"), N.to_number(raw).alias("value"))


def numeric_cells(cells: DataFrame) -> DataFrame:
    """Every number with its address, places and float-artefact mark."""
    c = typed(cells).where("is_num")
    raw = F.col("raw")
    return c.select(*SHEET, "row", "col", N.a1(F.col("row"), F.col("col")).alias("cell"), "raw", "value", N.decimal_places(raw).alias("places"), N.float_artifact(raw).alias("artifact"))


def segments(cells: DataFrame, ahead: int = 5) -> DataFrame:
    """Runs of columns with a filled cell in the row or the rows ahead of it: workbook, sheet, row, start, end."""
    rows = F.explode(F.sequence(F.greatest(F.col("row") - ahead, F.lit(1)), F.col("row")))
    active = cells.select(*SHEET, "col", rows.alias("row")).distinct()
    run = F.col("col") - F.row_number().over(Window.partitionBy(*SHEET, "row").orderBy("col"))
    return active.withColumn("run", run).groupBy(*SHEET, "row", "run").agg(F.min("col").alias("start"), F.max("col").alias("end")).drop("run")


def within(spans: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """Cells of the spans' columns, joined on the given keys."""
    return spans.join(cells, on).where(F.col("col").between(F.col("start"), F.col("end")))


def headers(cells: DataFrame) -> DataFrame:
    """Header rows: two labels or more in a segment over a row with two numbers or more. labels: array<struct<col, label>>."""
    spans = segments(cells)
    named = within(spans, cells.where("is_text"), [*SHEET, "row"]).groupBy(*HEADER).agg(F.sort_array(F.collect_list(F.struct("col", F.col("raw").alias("label")))).alias("labels")).where(F.size("labels") >= 2)
    below = cells.where("is_num").withColumn("row", F.col("row") - 1)
    return named.join(within(named.drop("labels"), below, [*SHEET, "row"]).groupBy(*HEADER).agg(F.count("*").alias("numbers")).where("numbers >= 2"), HEADER).drop("numbers")


def extents(heads: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds last_row: data rows follow the header until one has no number, or two labels (but for the first)."""
    below = heads.select(*HEADER).withColumnRenamed("row", "head").join(cells, SHEET).where((F.col("row") > F.col("head")) & F.col("col").between(F.col("start"), F.col("end")))
    key = [*SHEET, "head", "start", "end"]
    counted = below.groupBy(*key, "row").agg(F.count_if("is_num").alias("n"), F.count_if("is_text").alias("t"))
    good = counted.where((F.col("n") > 0) & ((F.col("t") < 2) | (F.col("row") == F.col("head") + 1)))
    unbroken = good.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("row"))).where(F.col("row") - F.col("k") == F.col("head"))
    last = unbroken.groupBy(*key).agg(F.max("row").alias("last_row")).withColumnRenamed("head", "row")
    return heads.join(last, HEADER)


def panel_labels(heads: DataFrame, cells: DataFrame, reach: int = 8) -> DataFrame:
    """Adds panel: the nearest figure label above within the segment (reach rows), else the nearest anywhere above, leftmost first."""
    figures = cells.where(L.is_figure(F.col("raw"))).select(*SHEET, F.col("row").alias("at"), "col", "raw")
    met = heads.select(*HEADER).join(figures, SHEET).where(F.col("at") <= F.col("row"))
    inside = (F.col("at") > F.col("row") - reach) & F.col("col").between(F.col("start"), F.col("end"))
    best = met.groupBy(*HEADER).agg(F.max_by("raw", F.struct(inside, "at", -F.col("col"))).alias("panel"))
    return heads.join(best, HEADER, "left").withColumn("panel", F.coalesce("panel", F.lit("")))


def groups(heads: DataFrame) -> DataFrame:
    """One row for each group label of headers with two or more: figure labels are none, axis labels only beside one other."""
    labels = F.filter("labels", lambda x: ~x["label"].rlike(L.FIGURE) & ~(L.is_axis(x["label"]) & (F.size("labels") > 2)))
    kept = heads.withColumn("kept", labels).where(F.size("kept") >= 2).select("*", F.posexplode("kept").alias("k", "g"))
    until = F.coalesce(F.get("kept", F.col("k") + 1)["col"] - 1, F.col("end"))
    return kept.select(*[c for c in heads.columns if c != "labels"], F.col("g.label").alias("group"), F.col("g.col").alias("group_start"), until.alias("group_end"))


def contexts(found: DataFrame, cells: DataFrame, above: int = 4) -> DataFrame:
    """Adds context: in each row above the header the nearest label at or left of the group, distinct, joined from the top."""
    key = [*HEADER, "group_start"]
    notes = cells.where("is_text").where(~F.col("raw").rlike(L.FIGURE)).select(*SHEET, F.col("row").alias("at"), "col", "raw")
    met = found.select(*key).join(notes, SHEET).where(F.col("at").between(F.col("row") - above, F.col("row") - 1) & F.col("col").between(F.col("start"), F.col("group_start")))
    nearest = met.groupBy(*key, "at").agg(F.max_by("raw", "col").alias("label"))
    said = nearest.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "label"))).alias("x"))
    said = said.select(*key, F.array_join(F.array_distinct(F.col("x.label")), " | ").alias("context"))
    return found.join(said, key, "left").withColumn("context", F.coalesce("context", F.lit("")))


def group_blocks(cells: DataFrame) -> DataFrame:
    """Group blocks with panel, context, and their numbers in row-major order (raws, vals); blocks of two numbers or more."""
    c = cut(typed(cells))
    heads = cut(headers(c))
    found = contexts(groups(panel_labels(extents(heads, c), c)), c)
    key = [*HEADER, "group_start"]
    data = c.where("is_num").select(*SHEET, F.col("row").alias("at"), "col", "raw", "value")
    met = found.select(*key, "group_end", "last_row").join(data, SHEET).where((F.col("at") > F.col("row")) & (F.col("at") <= F.col("last_row")) & F.col("col").between(F.col("group_start"), F.col("group_end")))
    listed = met.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "col", "raw", "value"))).alias("x")).where(F.size("x") >= 2)
    return found.join(listed.select(*key, F.col("x.raw").alias("raws"), F.col("x.value").alias("vals"), F.size("x").alias("n")), key)


def block_summary(blocks: DataFrame) -> DataFrame:
    """n, mean, sd, sem, cv, min, max, duplicate count and flags of group blocks."""
    by = [*SHEET, "row", "group_start", "group", "panel"]
    flat = blocks.select(*by, F.explode(F.arrays_zip("raws", "vals")).alias("x")).select(*by, "x.raws", "x.vals")
    s = flat.groupBy(*by).agg(F.count("*").alias("n"), F.avg("vals").alias("mean"), F.stddev_samp("vals").alias("sd"), F.min("vals").alias("min"), F.max("vals").alias("max"), (F.count("*") - F.count_distinct("raws")).alias("duplicates"))
    enough, flag = F.col("n") >= 5, lambda name, when: F.when(when, name)
    flags = F.concat_ws(";", flag("zero_variance", enough & (F.col("sd") == 0)), flag("high_duplicate_rate", enough & (F.col("duplicates") / F.col("n") >= 0.4)))
    return s.withColumns({"sem": F.col("sd") / F.sqrt("n"), "cv": F.when(F.col("mean") != 0, F.col("sd") / F.abs("mean")), "flags": flags})


def adjacent_pairs(blocks: DataFrame) -> DataFrame:
    """Neighbouring group blocks of one layout: the columns of both, by a and b group_start."""
    w = Window.partitionBy(*SHEET, "panel", "row", "last_row").orderBy("group_start", "group_end")
    nxt = F.lead(F.struct("group_start", "group", "context")).over(w)
    return blocks.withColumn("next", nxt).where("next is not null").select(*SHEET, "panel", "row", F.col("group_start").alias("a"), F.col("next.group_start").alias("b"), F.col("group").alias("group_a"), F.col("next.group").alias("group_b"), F.col("context").alias("context_a"), F.col("next.context").alias("context_b"))


def rectangles(cells: DataFrame, least_rows: int = 3, least_cols: int = 2, least_cells: int = 12) -> DataFrame:
    """Complete numeric rectangles right of figure labels, in rows with two labels or more."""
    c = typed(cells)
    wide = c.groupBy(*SHEET).agg(F.max("col").alias("ncol"))
    row = Window.partitionBy(*SHEET, "row")
    figures = c.where(L.is_figure(F.col("raw"))).withColumn("k", F.count("*").over(row)).withColumn("next", F.lead("col").over(row.orderBy("col"))).where("k >= 2")
    figures = figures.join(wide, SHEET).select(*SHEET, "row", F.col("col").alias("label_col"), F.col("raw").alias("label"), F.coalesce(F.col("next") - 1, "ncol").alias("hard_end"))
    numbers, key = c.where("is_num").select(*SHEET, "row", "col", "value"), [*SHEET, "row", "label_col"]
    right = figures.join(numbers, [*SHEET, "row"]).where((F.col("col") > F.col("label_col")) & (F.col("col") <= F.col("hard_end")))
    right = right.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("col"))).where(F.col("col") - F.col("k") == F.col("label_col"))
    spans = right.groupBy(*key, "label").agg(F.max("col").alias("end")).withColumn("start", F.col("label_col") + 1)
    down = spans.withColumnRenamed("row", "top").join(numbers, SHEET).where((F.col("row") >= F.col("top")) & F.col("col").between(F.col("start"), F.col("end")))
    top = [*SHEET, "top", "label_col", "label", "start", "end"]
    whole = down.groupBy(*top, "row").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).where(F.col("n") == F.col("end") - F.col("start") + 1)
    unbroken = whole.withColumn("k", F.row_number().over(Window.partitionBy(*top).orderBy("row"))).where(F.col("row") - F.col("k") == F.col("top") - 1)
    out = unbroken.groupBy(*top).agg(F.count("*").cast("int").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("n_cols", F.col("end") - F.col("start") + 1)
    return out.where((F.col("n_rows") >= least_rows) & (F.col("n_cols") >= least_cols) & (F.col("n_rows") * F.col("n_cols") >= least_cells) & (F.col("lo") < F.col("hi"))).drop("lo", "hi")


def rectangle_cells(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """Each rectangle's cells by offset: workbook, sheet, id struct<top, label_col>, dr, dc, key."""
    c = typed(cells).where("is_num").select(*SHEET, "row", "col", L.value_key(F.col("raw")).alias("key"))
    met = rects.join(c, SHEET).where((F.col("row") >= F.col("top")) & (F.col("row") < F.col("top") + F.col("n_rows")) & F.col("col").between(F.col("start"), F.col("end")))
    return met.select(*SHEET, F.struct("top", "label_col").alias("id"), "n_rows", "n_cols", (F.col("row") - F.col("top")).alias("dr"), (F.col("col") - F.col("start")).alias("dc"), "key")


def largest_block(hits: list, least_rows: int = 3, least_cols: int = 2, least_cells: int = 12) -> tuple | None:
    """(cells, top, left, rows, cols) of the largest filled rectangle of hits (dr, dc, key) that is not constant; the first in (top, bottom, left) order of equals."""
    key = {(h["dr"], h["dc"]): h["key"] for h in hits}
    rows, best = sorted({r for r, _ in key}), None
    for top in rows:
        cols = sorted(c for r, c in key if r == top)
        bottom = top
        while cols:
            height, run = bottom - top + 1, [cols[0]]
            runs = []
            for c in cols[1:]:
                if c == run[-1] + 1:
                    run.append(c)
                else:
                    runs.append(run)
                    run = [c]
            for run in [*runs, run]:
                size = height * len(run)
                if height >= least_rows and len(run) >= least_cols and size >= least_cells and (best is None or size > best[0]) and len({key[r, c] for r in range(top, bottom + 1) for c in run}) > 1:
                    best = (size, top, run[0], height, len(run))
            bottom += 1
            cols = [c for c in cols if (bottom, c) in key]
    return best


def matrix_overlap(cells: DataFrame, fraction: float = 0.8, least_cells: int = 12) -> DataFrame:
    """Pairs of rectangles of one sheet, top left aligned, that share most cells or a solid exact part.

    Equal cells are met by an equi-join on place and value, so rectangles without a common cell never meet.
    """
    rects = cut(rectangles(cells))
    of = cut(rectangle_cells(rects, cells))
    side = lambda k: of.select(*SHEET, "dr", "dc", "key", *[F.col(c).alias(c + k) for c in ("id", "n_rows", "n_cols")])
    met = side("_a").join(side("_b"), [*SHEET, "dr", "dc", "key"]).where(F.col("id_a") < F.col("id_b"))
    pair = [*SHEET, "id_a", "id_b", "n_rows_a", "n_cols_a", "n_rows_b", "n_cols_b"]
    both = met.groupBy(*pair).agg(F.count("*").alias("matched"), F.count_distinct("key").alias("values"), F.collect_list(F.struct("dr", "dc", "key")).alias("hits")).where(F.col("matched") >= least_cells)
    both = both.withColumn("compared", F.least("n_rows_a", "n_rows_b") * F.least("n_cols_a", "n_cols_b")).withColumn("fraction", F.col("matched") / F.col("compared"))
    block = F.udf(largest_block, "struct<cells: int, top: int, left: int, rows: int, cols: int>", useArrow=True)  # one small mask a pair
    both = both.withColumn("block", block("hits")).withColumn("whole", F.col("fraction") >= fraction)
    both = both.where((F.col("whole") & (F.col("values") > 1)) | (~F.col("whole") & F.col("block").isNotNull()))
    same = (F.col("n_rows_a") == F.col("n_rows_b")) & (F.col("n_cols_a") == F.col("n_cols_b")) & (F.col("matched") == F.col("compared"))
    evidence = F.when(F.col("whole"), F.col("matched")).otherwise(F.col("block.cells"))
    kind = F.when(F.col("whole") & same, "exact_matrix_reuse").when(F.col("whole"), "partial_matrix_overlap").otherwise("partial_contiguous_matrix_reuse")
    risk = F.when((F.col("fraction") >= 0.95) | (evidence >= 30), "HIGH-RISK_REVIEW").otherwise("WARN_TO_HIGH-RISK_REVIEW")
    basis = F.when(F.col("id_a.top") == F.col("id_b.top"), "same_sheet_same_row_distinct_panel").otherwise("same_sheet_distinct_panel")
    return both.select(*pair, "compared", "matched", "fraction", evidence.cast("long").alias("evidence"), F.col("block.rows").alias("block_rows"), F.col("block.cols").alias("block_cols"), kind.alias("match_type"), basis.alias("basis"), risk.alias("risk"))


def summary_mismatches(overlaps: DataFrame, cells: DataFrame, rows_below: int = 6) -> DataFrame:
    """Adds mismatch_rows: of the rows below two overlapping rectangles, how many differ in label or values."""
    c = typed(cells)
    last = c.groupBy(*SHEET).agg(F.max("row").alias("bottom"))
    keyed = c.select(*SHEET, F.col("row").alias("r"), F.col("col").alias("c"), L.mixed_key(F.col("raw")).alias("key"))
    pair = [*SHEET, "id_a", "id_b"]
    width = F.least("n_cols_a", "n_cols_b")
    spots = overlaps.join(last, SHEET).withColumn("dc", F.explode(F.sequence(F.lit(0), width))).withColumn("dr", F.explode(F.sequence(F.lit(0), F.lit(rows_below - 1))))
    row = lambda k: F.col(f"id_{k}.top") + F.col(f"n_rows_{k}") + F.col("dr")
    spots = spots.where((row("a") <= F.col("bottom")) & (row("b") <= F.col("bottom"))).select(*pair, "dr", "dc", row("a").alias("ra"), (F.col("id_a.label_col") + F.col("dc")).alias("ca"), row("b").alias("rb"), (F.col("id_b.label_col") + F.col("dc")).alias("cb"))
    for k in ("a", "b"):
        spots = spots.join(keyed.select(*SHEET, F.col("r").alias("r" + k), F.col("c").alias("c" + k), F.col("key").alias("key_" + k)), [*SHEET, "r" + k, "c" + k], "left")
    differ = spots.groupBy(*pair, "dr").agg(F.bool_or(~F.coalesce("key_a", F.lit("")).eqNullSafe(F.coalesce("key_b", F.lit("")))).alias("x"))
    counted = differ.groupBy(*pair).agg(F.count_if("x").alias("mismatch_rows"))
    return overlaps.join(counted, pair, "left").withColumn("mismatch_rows", F.coalesce("mismatch_rows", F.lit(0)))
