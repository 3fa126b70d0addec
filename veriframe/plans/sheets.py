"""Layout queries on sheets laid out from the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout

# Sheets of 40 parts: two panels of 20, below each other, each with a figure label, a note, a header and data; and sheets
# whose two panels stand side by side, the second a copy of the first but for some cells. Both dialects run this text.
PARTS = "(SELECT CAST(floor(p_partkey / 40.0) AS INT) AS s, CAST(p_partkey % 40 AS INT) AS i, p_size, p_retailprice FROM part)"
BASE = "CAST(floor(i / 20.0) AS INT) * 30"


def grid_sql() -> str:
    cell = lambda sheet, row, col, raw, where="1 = 1": f"SELECT 'parts' AS workbook, concat('{sheet}', CAST(s AS STRING)) AS sheet, CAST({row} AS INT) AS \"row\", CAST({col} AS INT) AS col, CAST({raw} AS STRING) AS raw FROM {PARTS} WHERE {where}"
    out = [
        cell("p", f"{BASE} + 1", 2, "concat('Fig. ', CAST(1 + floor(i / 20.0) AS INT), 'A')", "i % 20 = 0"),
        cell("p", f"{BASE} + 2", 3, "CASE WHEN s % 2 = 0 THEN 'IL-6' ELSE 'TNF' END", "i % 20 = 1"),
        *[cell("p", f"{BASE} + 3", c, f"'{name}'", "i % 20 = 2") for c, name in ((2, "time"), (3, "control"), (4, "dose 5"), (6, "dose 10"))],
        cell("p", f"{BASE} + 4 + i % 20", 2, "i % 20"),
        cell("p", f"{BASE} + 4 + i % 20", 3, "p_size"),
        cell("p", f"{BASE} + 4 + i % 20", 4, "p_retailprice"),
        cell("p", f"{BASE} + 4 + i % 20", 5, "CASE WHEN i % 7 = 6 THEN 'n.d.' ELSE CAST(p_retailprice * 2 AS STRING) END"),
        cell("p", f"{BASE} + 4 + i % 20", 6, "p_size + 1"),
        cell("p", f"{BASE} + 4 + i % 20", 7, "'lost'", "i % 20 = 17 AND s % 3 = 0"),
        cell("p", f"{BASE} + 4 + i % 20", 8, "'lost'", "i % 20 = 17 AND s % 3 = 0"),
        cell("m", "1", 1, "'Fig. 1A'", "i = 0"), cell("m", "1", 6, "'Fig. 1B'", "i = 0"),
        cell("m", "43", 1, "'mean'", "i = 0"), cell("m", "43", 6, "CASE WHEN s % 2 = 0 THEN ' Mean' ELSE 'sd' END", "i = 0"),
    ]
    for c, v in ((2, "p_size"), (3, "p_retailprice"), (4, "p_size + i")):
        out += [cell("m", "i + 1", c, v), cell("m", "i + 1", c + 5, f"CASE WHEN (i + {c}) % (3 + s % 5) = 0 THEN -i ELSE {v} END")]
    return " UNION ALL ".join(out)


def grid(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(grid_sql().replace('"row"', "row").replace("FROM part)", "FROM {part})"), part=spark.read.parquet(f"{d}/part.parquet"))


def segments(s, d):
    return layout.segments(layout.typed(grid(s, d)))


def headers(s, d):
    c = layout.typed(grid(s, d))
    found = layout.panel_labels(layout.extents(layout.headers(c), c), c)
    return found.select("sheet", "row", "start", "end", "last_row", "panel", F.size("labels").alias("labels"))


def blocks(s, d):
    total = F.aggregate("vals", F.lit(0.0), lambda a, x: a + x)
    return layout.group_blocks(grid(s, d)).select("sheet", "row", "group", "group_start", "group_end", "last_row", "panel", "context", "n", F.round(total, 2).alias("total"))


def summaries(s, d):
    b = layout.block_summary(layout.group_blocks(grid(s, d)))
    return b.select("sheet", "row", "group_start", "n", "min", "max", "duplicates", "flags", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sem", "cv")])


def pairs(s, d):
    return layout.adjacent_pairs(layout.group_blocks(grid(s, d))).select("sheet", "panel", "row", "a", "b", "group_a", "group_b")


def panel_cells(s, d):
    c = layout.typed(grid(s, d))
    return c.where(layout.L.is_figure(F.col("raw"))).select("sheet", "row", "col", "raw")


def numbers(s, d):
    n = layout.numeric_cells(grid(s, d))
    return n.groupBy("sheet", "places").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("cell").alias("first"))


def rectangles(s, d):
    return layout.rectangles(grid(s, d)).select("sheet", "top", "label_col", "label", "start", "end", "n_rows", "n_cols")


def overlaps(s, d):
    cells = grid(s, d)
    return layout.summary_mismatches(layout.matrix_overlap(cells), cells).select("sheet", F.col("id_a.label_col").alias("a"), F.col("id_b.label_col").alias("b"), "compared", "matched", "evidence", "match_type", "basis", "risk", "mismatch_rows")


QUERIES = {
    "column_segments": segments, "header_rows": headers, "group_blocks": blocks, "group_block_summary": summaries, "adjacent_groups": pairs,
    "panel_label_cells": panel_cells, "numeric_cells": numbers, "panel_rectangles": rectangles, "matrix_overlap": overlaps,
}

FIG, AXIS = r"'(?i)(?:^|\b)(?:fig|sfig|supplementary|extended|extneded)\.?\s*[\w .,\-]*'", "'(?i)^time'"
CELLS = f"""g AS ({grid_sql()}),
c AS (SELECT workbook, sheet, "row", col, trim(raw) AS raw, try_cast(trim(raw) AS DOUBLE) AS v, try_cast(trim(raw) AS DOUBLE) IS NULL AS txt FROM g WHERE trim(raw) <> '')"""
SEG = CELLS + """,
act AS (SELECT DISTINCT workbook, sheet, col, r AS "row" FROM (SELECT workbook, sheet, col, unnest(range(greatest("row" - 5, 1), "row" + 1)) AS r FROM c)),
seg AS (SELECT workbook, sheet, "row", min(col) AS start, max(col) AS "end" FROM (SELECT *, col - row_number() OVER (PARTITION BY sheet, "row" ORDER BY col) AS run FROM act) GROUP BY workbook, sheet, "row", run)"""
HEAD = SEG + f""",
h AS (SELECT sheet, s."row", start, "end", list(struct_pack(col := col, label := raw) ORDER BY col) AS labels FROM seg s JOIN c USING (sheet, "row") WHERE txt AND col BETWEEN start AND "end" GROUP BY ALL HAVING count(*) >= 2),
h2 AS (SELECT h.* FROM h WHERE (SELECT count(*) FROM c WHERE c.sheet = h.sheet AND c."row" = h."row" + 1 AND NOT txt AND col BETWEEN start AND "end") >= 2),
cnt AS (SELECT h2.sheet, h2."row", start, "end", c."row" AS r, count(*) FILTER (NOT txt) AS n, count(*) FILTER (txt) AS t FROM h2 JOIN c ON c.sheet = h2.sheet AND c."row" > h2."row" AND col BETWEEN start AND "end" GROUP BY ALL),
bad AS (SELECT k.sheet, k."row", k.start, k."end", k.r FROM cnt k WHERE n = 0 OR (t >= 2 AND r > "row" + 1)),
gap AS (SELECT sheet, "row", start, "end", r + 1 AS r FROM cnt x WHERE NOT EXISTS (SELECT 1 FROM cnt y WHERE y.sheet = x.sheet AND y."row" = x."row" AND y.start = x.start AND y."end" = x."end" AND y.r = x.r + 1)),
ext AS (SELECT sheet, "row", start, "end", min(r) - 1 AS last_row FROM (SELECT * FROM bad UNION ALL SELECT * FROM gap) GROUP BY ALL),
fig AS (SELECT sheet, "row" AS r, col, raw FROM c WHERE txt AND regexp_matches(raw, {FIG})),
pan AS (SELECT h2.sheet, h2."row", start, "end", first(raw ORDER BY (r > "row" - 8 AND col BETWEEN start AND "end") DESC, r DESC, col) AS panel FROM h2 JOIN fig ON fig.sheet = h2.sheet AND r <= "row" GROUP BY ALL),
hd AS (SELECT h2.*, last_row, coalesce(panel, '') AS panel FROM h2 JOIN ext USING (sheet, "row", start, "end") LEFT JOIN pan USING (sheet, "row", start, "end"))"""
BLOCKS = HEAD + f""",
gl AS (SELECT hd.* EXCLUDE (labels), x.col AS group_start, x.label AS "group" FROM (SELECT *, unnest(labels) AS x FROM hd) hd WHERE NOT regexp_matches(x.label, {FIG}) AND NOT (len(labels) > 2 AND regexp_matches(x.label, {AXIS}))),
gr AS (SELECT *, coalesce(lead(group_start) OVER w - 1, "end") AS group_end, count(*) OVER (PARTITION BY sheet, "row", start, "end") AS k FROM gl WINDOW w AS (PARTITION BY sheet, "row", start, "end" ORDER BY group_start)),
near AS (SELECT gr.sheet, gr."row", gr.start, gr.group_start, c."row" AS r, max_by(c.raw, c.col) AS label FROM gr JOIN c ON c.sheet = gr.sheet AND c."row" BETWEEN gr."row" - 4 AND gr."row" - 1 AND c.col BETWEEN start AND group_start WHERE txt AND NOT regexp_matches(c.raw, {FIG}) GROUP BY ALL),
ctx AS (SELECT sheet, "row", start, group_start, string_agg(label, ' | ' ORDER BY r) AS context FROM (SELECT sheet, "row", start, group_start, label, min(r) AS r FROM near GROUP BY ALL) GROUP BY ALL),
val AS (SELECT gr.*, coalesce(context, '') AS context, c."row" AS r, c.col AS cc, c.raw AS raw, v FROM gr LEFT JOIN ctx USING (sheet, "row", start, group_start) JOIN c ON c.sheet = gr.sheet AND c."row" > gr."row" AND c."row" <= last_row AND c.col BETWEEN group_start AND group_end WHERE k >= 2 AND NOT txt),
blk AS (SELECT sheet, "row", "group", group_start, group_end, last_row, panel, context, count(*) AS n, sum(v) AS total, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS min, max(v) AS max, count(*) - count(DISTINCT raw) AS duplicates FROM val GROUP BY ALL HAVING count(*) >= 2)"""
RECT = CELLS + f""",
f AS (SELECT sheet, "row", col, raw, count(*) OVER (PARTITION BY sheet, "row") AS k, lead(col) OVER (PARTITION BY sheet, "row" ORDER BY col) AS nxt FROM c WHERE txt AND regexp_matches(raw, {FIG})),
w AS (SELECT sheet, max(col) AS ncol FROM c GROUP BY 1),
rt AS (SELECT f.sheet, f."row" AS top, f.col AS label_col, f.raw AS label, c.col, c.col - row_number() OVER (PARTITION BY f.sheet, f."row", f.col ORDER BY c.col) AS run FROM f JOIN w USING (sheet) JOIN c ON c.sheet = f.sheet AND c."row" = f."row" AND NOT c.txt AND c.col > f.col AND c.col <= coalesce(nxt - 1, ncol) WHERE k >= 2),
sp AS (SELECT sheet, top, label_col, label, label_col + 1 AS start, max(col) AS "end" FROM rt WHERE run = label_col GROUP BY ALL),
dn AS (SELECT sp.*, c."row" AS r, min(v) AS lo, max(v) AS hi FROM sp JOIN c ON c.sheet = sp.sheet AND c."row" >= top AND NOT txt AND c.col BETWEEN start AND "end" GROUP BY ALL HAVING count(*) = "end" - start + 1),
ub AS (SELECT *, r - row_number() OVER (PARTITION BY sheet, top, label_col ORDER BY r) AS run FROM dn),
rc AS (SELECT sheet, top, label_col, label, start, "end", CAST(count(*) AS INTEGER) AS n_rows, CAST("end" - start + 1 AS INTEGER) AS n_cols FROM ub WHERE run = top - 1 GROUP BY sheet, top, label_col, label, start, "end" HAVING count(*) >= 3 AND "end" > start AND count(*) * ("end" - start + 1) >= 12 AND min(lo) < max(hi))"""
MATRIX = RECT + """,
rx AS (SELECT rc.*, c."row" - top AS dr, c.col - start AS dc, v FROM rc JOIN c ON c.sheet = rc.sheet AND c."row" >= top AND c."row" < top + n_rows AND c.col BETWEEN start AND "end"),
mt AS (SELECT a.sheet, a.top AS ta, a.label_col AS a, b.label_col AS b, a.n_rows AS ra, a.n_cols AS ca, b.n_rows AS rb, b.n_cols AS cb, count(*) AS matched, count(DISTINCT a.v) AS vals FROM rx a JOIN rx b ON a.sheet = b.sheet AND a.dr = b.dr AND a.dc = b.dc AND a.v = b.v AND (a.top, a.label_col) < (b.top, b.label_col) GROUP BY ALL HAVING count(*) >= 12),
mk AS (SELECT sheet, a, b, dr, list(dc ORDER BY dc) AS dcs FROM (SELECT DISTINCT a.sheet, a.label_col AS a, b.label_col AS b, a.dr, a.dc FROM rx a JOIN rx b ON a.sheet = b.sheet AND a.dr = b.dr AND a.dc = b.dc AND a.v = b.v AND (a.top, a.label_col) < (b.top, b.label_col)) GROUP BY ALL),
span AS (SELECT * FROM (VALUES (0, 1), (1, 2), (0, 2)) t(l, r)),
isl AS (SELECT sheet, a, b, l, r, dr, dr - row_number() OVER (PARTITION BY sheet, a, b, l, r ORDER BY dr) AS run FROM mk, span WHERE len(list_filter(dcs, lambda x: x BETWEEN l AND r)) = r - l + 1),
sub AS (SELECT sheet, a, b, max(k) AS block FROM (SELECT sheet, a, b, count(*) * (r - l + 1) AS k FROM isl GROUP BY sheet, a, b, l, r, run HAVING count(*) >= 3 AND count(*) * (r - l + 1) >= 12) GROUP BY ALL),
mm AS (SELECT *, least(ra, rb) * least(ca, cb) AS compared, matched / (least(ra, rb) * least(ca, cb)) AS fr FROM mt LEFT JOIN sub USING (sheet, a, b)),
mf AS (SELECT *, CASE WHEN fr >= 0.8 THEN matched ELSE block END AS evidence FROM mm WHERE (fr >= 0.8 AND vals > 1) OR (fr < 0.8 AND block IS NOT NULL)),
nt AS (SELECT sheet, "row" AS r, max(CASE WHEN col = 1 THEN lower(raw) END) AS x, max(CASE WHEN col = 6 THEN lower(raw) END) AS y FROM c WHERE starts_with(sheet, 'm') AND "row" BETWEEN 41 AND 46 GROUP BY ALL)"""
ORACLES = {
    "column_segments": f'WITH {SEG} SELECT workbook, sheet, CAST("row" AS INTEGER) AS "row", start, "end" FROM seg',
    "header_rows": f'WITH {HEAD} SELECT sheet, CAST("row" AS INTEGER) AS "row", start, "end", CAST(last_row AS INTEGER) AS last_row, panel, CAST(len(labels) AS INTEGER) AS labels FROM hd',
    "group_blocks": f'WITH {BLOCKS} SELECT sheet, CAST("row" AS INTEGER) AS "row", "group", group_start, CAST(group_end AS INTEGER) AS group_end, CAST(last_row AS INTEGER) AS last_row, panel, context, CAST(n AS INTEGER) AS n, round(total, 2) AS total FROM blk',
    "group_block_summary": f"""WITH {BLOCKS} SELECT sheet, CAST("row" AS INTEGER) AS "row", group_start, n, min, max, duplicates, concat_ws(';', CASE WHEN n >= 5 AND sd = 0 THEN 'zero_variance' END, CASE WHEN n >= 5 AND duplicates / n >= 0.4 THEN 'high_duplicate_rate' END) AS flags,
 round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS sem, CASE WHEN mean <> 0 THEN round(sd / abs(mean), 6) END AS cv FROM blk""",
    "adjacent_groups": f"""WITH {BLOCKS} SELECT sheet, panel, CAST("row" AS INTEGER) AS "row", a, b, group_a, group_b FROM (SELECT sheet, panel, "row", group_start AS a, lead(group_start) OVER w AS b, "group" AS group_a, lead("group") OVER w AS group_b FROM blk
 WINDOW w AS (PARTITION BY sheet, panel, "row", last_row ORDER BY group_start, group_end)) WHERE b IS NOT NULL""",
    "panel_label_cells": f'WITH {CELLS} SELECT sheet, "row", col, raw FROM c WHERE txt AND regexp_matches(raw, {FIG})',
    "numeric_cells": f"""WITH {CELLS} SELECT sheet, CAST(length(regexp_extract(raw, '\\.([0-9]*)$', 1)) AS INTEGER) AS places, count(*) AS n, round(sum(v), 2) AS total, min(concat(chr(64 + col), "row")) AS "first" FROM c WHERE NOT txt GROUP BY ALL""",
    "panel_rectangles": f'WITH {RECT} SELECT sheet, top, label_col, label, start, "end", n_rows, n_cols FROM rc',
    "matrix_overlap": f"""WITH {MATRIX} SELECT mf.sheet, a, b, CAST(compared AS INTEGER) AS compared, matched, CAST(evidence AS BIGINT) AS evidence,
 CASE WHEN fr >= 0.8 AND ra = rb AND ca = cb AND matched = compared THEN 'exact_matrix_reuse' WHEN fr >= 0.8 THEN 'partial_matrix_overlap' ELSE 'partial_contiguous_matrix_reuse' END AS match_type,
 'same_sheet_same_row_distinct_panel' AS basis, CASE WHEN fr >= 0.95 OR evidence >= 30 THEN 'HIGH-RISK_REVIEW' ELSE 'WARN_TO_HIGH-RISK_REVIEW' END AS risk,
 CAST((SELECT count(*) FROM nt WHERE nt.sheet = mf.sheet AND r > mf.ra AND trim(coalesce(x, '')) <> trim(coalesce(y, ''))) AS BIGINT) AS mismatch_rows FROM mf""",
}
