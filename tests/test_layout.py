import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from veriframe.functions import labels as L
from veriframe.operators import layout

SCHEMA = "workbook string, sheet string, row int, col int, raw string"


def number(x):
    try:
        return float(x)
    except ValueError:
        return None


def random_sheet(rng):
    """Panels with headers, gaps, notes and stray cells."""
    grid, top = {}, 1
    for panel in range(rng.randint(1, 3)):
        left, width, rows = rng.randint(1, 3), rng.randint(3, 6), rng.randint(1, 6)
        if rng.random() < 0.8:
            grid[top, left] = f"Fig. {panel + 1}B"
        if rng.random() < 0.5:
            grid[top + 1, left + rng.randint(0, width - 1)] = rng.choice(["IL-6", "cells", "Supplementary Fig 2"])
        for c in range(width):
            if rng.random() < 0.8:
                grid[top + 2, left + c] = rng.choice(["time", "ctrl", "drug", "10 mM", "wt"])
        for r in range(rows):
            for c in range(width):
                if rng.random() < 0.85:
                    grid[top + 3 + r, left + c] = rng.choice(["1.5", "2", "3.25", "-4", "n.d.", "1e3"]) if rng.random() < 0.9 else "note"
        top += rows + rng.randint(3, 6)
    return grid


def blocks_by_hand(grid):
    last, wide = max(r for r, _ in grid), max(c for _, c in grid)
    at = lambda r, c: grid.get((r, c), "")
    num = lambda r, c: at(r, c) != "" and number(at(r, c)) is not None
    txt = lambda r, c: at(r, c) != "" and not num(r, c)
    fig = lambda s: re.search(L.FIGURE, s)
    out = set()
    for r in range(1, last):
        active = [c for c in range(1, wide + 1) if any(at(k, c) for k in range(r, r + 6))]
        for _, run in itertools.groupby(enumerate(active), lambda p: p[1] - p[0]):
            cols = [c for _, c in run]
            names = [c for c in cols if txt(r, c)]
            if len(names) < 2 or sum(num(r + 1, c) for c in cols) < 2:
                continue
            end = r
            for k in range(r + 1, last + 1):
                if not any(num(k, c) for c in cols) or (k > r + 1 and sum(txt(k, c) for c in cols) > 1):
                    break
                end = k
            mine = [c for c in names if not fig(at(r, c)) and not (len(names) > 2 and re.match(L.AXIS, at(r, c)))]
            near = [at(k, c) for k in range(r, max(0, r - 8), -1) for c in cols if txt(k, c) and fig(at(k, c))]
            far = [at(k, c) for k in range(r, 0, -1) for c in range(1, wide + 1) if txt(k, c) and fig(at(k, c))]
            for i, c in enumerate(mine if len(mine) > 1 else []):
                stop = mine[i + 1] - 1 if i + 1 < len(mine) else cols[-1]
                vals = [number(at(k, x)) for k in range(r + 1, end + 1) for x in range(c, stop + 1) if num(k, x)]
                said = []
                for k in range(max(1, r - 4), r):
                    said += [next((at(k, x) for x in range(c, cols[0] - 1, -1) if txt(k, x) and not fig(at(k, x))), None)]
                said = " | ".join(dict.fromkeys(x for x in said if x))
                if len(vals) > 1:
                    out.add((r, c, stop, end, at(r, c), [*near, *far, ""][0], said, tuple(vals)))
    return out


def test_group_blocks_equal_brute_force(spark):
    rng = random.Random(5)
    sheets = {f"s{i}": random_sheet(rng) for i in range(60)}
    rows = [("w", s, r, c, v) for s, g in sheets.items() for (r, c), v in g.items()] + [("w", "s0", 900, 1, "  "), ("w", "s1", 901, 1, None)]
    got = {}
    for x in layout.group_blocks(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(x["sheet"], set()).add((x["row"], x["group_start"], x["group_end"], x["last_row"], x["group"], x["panel"], x["context"], tuple(x["vals"])))
    want = {s: b for s, g in sheets.items() if (b := blocks_by_hand(g))}
    assert sum(map(len, want.values())) > 60 and got == want
    assert layout.group_blocks(spark.createDataFrame([], SCHEMA)).count() == 0


def copied(change=()):
    """A sheet of two panels side by side, the second a copy of the first but for some cells."""
    rng, rows = random.Random(1), []
    for dr in range(8):
        for dc in range(3):
            v = str(round(rng.uniform(1, 9), 2))
            rows += [("w", "s", dr + 2, dc + 2, v), ("w", "s", dr + 2, dc + 7, "77" if (dr, dc) in change else v + "0")]
    return [*rows, ("w", "s", 2, 1, "Fig 1"), ("w", "s", 2, 6, "Fig 2"), ("w", "s", 10, 1, "mean"), ("w", "s", 10, 2, "5"), ("w", "s", 10, 6, "Mean"), ("w", "s", 10, 7, "6"), ("w", "s", 11, 1, "sd"), ("w", "s", 11, 6, " SD ")]


@pytest.mark.parametrize("change,want", [((), ("exact_matrix_reuse", 24, 24, "HIGH-RISK_REVIEW")), (((0, 0), (7, 2)), ("partial_matrix_overlap", 22, 22, "WARN_TO_HIGH-RISK_REVIEW")), (tuple((r, c) for r in range(4) for c in (0, 2)), ("partial_contiguous_matrix_reuse", 16, 12, "WARN_TO_HIGH-RISK_REVIEW"))])
def test_matrix_overlap(spark, change, want):
    cells = spark.createDataFrame(copied(change), SCHEMA)
    got = layout.summary_mismatches(layout.matrix_overlap(cells), cells).collect()
    assert [(r["match_type"], r["matched"], r["evidence"], r["risk"], r["mismatch_rows"]) for r in got] == [(*want, 1)]


def test_largest_block_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        hits = [{"dr": r, "dc": c, "key": rng.choice("ab")} for r in range(6) for c in range(5) if rng.random() < 0.85]
        on = {(h["dr"], h["dc"]): h["key"] for h in hits}
        best = 0
        for a, b in itertools.combinations_with_replacement(range(6), 2):
            for c, d in itertools.combinations_with_replacement(range(5), 2):
                spots = [(r, k) for r in range(a, b + 1) for k in range(c, d + 1)]
                if b - a >= 2 and d > c and len(spots) >= 12 and all(x in on for x in spots) and len({on[x] for x in spots}) > 1:
                    best = max(best, len(spots))
        assert (layout.largest_block(hits) or (0,))[0] == best


@pytest.mark.parametrize("x,want10,want15", [(0.1, "0.1", "0.1"), (1234567.0, "1234567", "1234567"), (1e-7, "1e-07", "1e-07"), (2 / 3, "0.6666666667", "0.666666666666667"), (1e20, "1e+20", "1e+20"), (123456789012.0, "1.23456789e+11", "123456789012"), (-0.0, "0", "0"), (float("inf"), "", "")])
def test_significant(spark, x, want10, want15):
    assert tuple(spark.createDataFrame([(x,)], "x double").select(L.shown(F.col("x")), L.significant(F.col("x"), 15)).first()) == (want10, want15)


def test_labels(spark):
    df = spark.createDataFrame([("Fig. 2C", " A  b ", 0.75, "x; y,,z", "9.99999999999999e1")], "a string, b string, r double, f string, n string")
    got = df.select(L.is_figure(F.col("a")), L.normalized(F.col("b")), L.simple_ratio(F.col("r")), L.split_flags(F.col("f")), L.is_axis(F.lit("10 mM")), L.is_derived(F.lit("fold change")), L.is_axis_or_id(F.lit("mouse no. 3")), L.slug(F.lit("A b/C!")), L.compact(F.lit("a  b"), 10), L.column_artifact(F.lit("0.30000000000000004"))).first()
    assert tuple(got) == (True, "a b", "3/4", ["x", "y", "z"], True, True, True, "a-b-c", "a b", True)
