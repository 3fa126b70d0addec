import io
import json
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veriframe import sinks
from veriframe.operators import digits, findings, formulas, images, relations, sequences
from veriframe.plans import audit
from veriframe.sources import display, pictures, workbooks
from veriframe.streaming import screens as streams

CELLS = "workbook string, sheet string, row int, col int, raw string"


@pytest.mark.parametrize("raw,fmt,want", [("0.125", "0.0%", "12.5%"), ("1.5", "0.000", "1.500"), ("1.5", "0.0##", "1.5"), ("1.25", "0.0", "1.2"), ("3", "0.##", "3"), ("2", "General", "2"), ("2", None, "2"), ("1e3", "#,##0.00", "1000.00"), ("2.5", '"x"0.0', "2.5"), ("2.5", "0;-0", "2"), ("abc", "0.0", "abc"), ("5", "0.00E+00", "5"), ("1", "[Red]0.0_)", "1.0")])
def test_displayed(raw, fmt, want):
    assert display.displayed(raw, fmt) == want


def test_unique_headers():
    assert display.unique_headers(["a", "", "a", None, "b", "a"]) == ["a", "column_2", "a.1", "column_4", "b", "a.2"]


def book() -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="a"/><sheet name="gone" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml" Type="x/worksheet"/></Relationships>')
        z.writestr("xl/styles.xml", '<s><numFmts><numFmt numFmtId="164" formatCode="0.000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></s>')
        z.writestr("xl/worksheets/s.xml", '<w><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="C1" t="inlineStr"><is><t>x</t></is></c><c r="A2" s="1"><v>1.5</v></c><c r="B2" s="2"><v>0.125</v></c><c r="C2"><v>7</v></c><c r="C3"><f>A2*2</f><v>3</v></c></w>')
    return buf.getvalue()


def test_workbook_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "audit_results").mkdir()
    for name in ("b.xlsx", "~$b.xlsx", "audit_results/old.xlsx"):
        (tmp_path / "in" / name).write_bytes(book())
    cells = workbooks.read_workbooks(spark, str(tmp_path / "in"))
    assert cells.select("workbook").distinct().count() == 1 and workbooks.read_workbooks(spark, str(tmp_path / "in"), all_folders=True).select("workbook").distinct().count() == 2
    got = {(r["column"], r["row"]): r["raw"] for r in workbooks.load_tables(spark, str(tmp_path / "in" / "b.xlsx"), "S").collect()}
    assert got == {("x", 2): "1.500", ("column_2", 2): "12.50%", ("x.1", 2): "7", ("x.1", 3): "3"}
    assert {r["verdict"] for r in formulas.recheck(cells).collect()} == {"MATCH"}
    inv = digits.sheet_inventory(cells).first()
    assert (inv["rows"], inv["cols"], inv["formula_cells"], inv["nonempty"], inv["numeric"], inv["text"]) == (3, 3, 1, 6, 4, 2)
    for bad, why in (("x.xls", "old .xls"), ("x.doc", "only xlsx")):
        with pytest.raises(ValueError, match=why):
            workbooks.load_tables(spark, bad)
    with pytest.raises(ValueError, match="no sheet"):
        workbooks.load_tables(spark, str(tmp_path / "in" / "b.xlsx"), "T")


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿g;v\nx;1,5\ny;NaN\nz;\n".encode())
    df = workbooks.read_delimited(spark, str(tmp_path / "a.csv"), needs=("g", "v"))
    assert [tuple(r) for r in df.orderBy("g").collect()] == [("x", "1,5"), ("y", ""), ("z", "")]
    with pytest.raises(ValueError, match="no column w"):
        workbooks.read_delimited(spark, str(tmp_path / "a.csv"), needs=("w",))
    assert workbooks.load_tables(spark, str(tmp_path / "a.csv")).count() == 6


def test_large_ranges_end():
    assert formulas.recalculate("SUM(A1:XFD1048576)", {(1, 1): 2.0, (5, 3): 4.0}) == (6.0, "")


def test_findings(spark):
    rows = [("Image integrity", "WARN_REVIEW", "IMG-0002"), ("Numeric matrix reuse", "WARN_REVIEW", "MAT-0010"), ("Numeric matrix reuse", "WARN_TO_HIGH-RISK_REVIEW", "MAT-0011"), ("Other", "PASS", "x"), ("Image integrity", "WARN_REVIEW", "IMG-0001")]
    df = spark.createDataFrame(rows, "category string, risk string, id string")
    assert [r["id"] for r in df.orderBy(*findings.report_order()).collect()] == ["MAT-0011", "MAT-0010", "IMG-0001", "IMG-0002", "x"]
    got = findings.numbered(df.repartition(3), "N", ["id"], "no").orderBy("no").collect()
    assert [(r["no"], r["id"]) for r in got] == [(f"N-{k:04d}", i) for k, i in enumerate(sorted(r[2] for r in rows), 1)]
    assert spark.createDataFrame([("low_last_digit_entropy;terminal_0_5_enrichment", 30)], "f string, n int").select(findings.group_score(F.col("f"), F.col("n"))).first()[0] == 55
    assert findings.capped(df, ["category"], ["id"], 1).count() == 3 and findings.capped(df, ["category"], ["id"], 0).count() == 5
    hint = lambda *x: spark.range(1).select(findings.independence(*map(F.lit, x)).alias("h")).first()["h"]
    assert tuple(hint("p", "p", "g", "g", "a", "b")) == (True, "same_panel_same_condition_different_readout_or_cytokine")
    assert tuple(hint("p", "q", "g", "g", "a", "a")) == (True, "cross_panel_same_condition") and tuple(hint("p", "p", "g", "g", "a", "a"))[0] is False


def test_keep_maximal(spark):
    rng = random.Random(4)
    rows = [(k, sorted(rng.sample(range(6), rng.randint(1, 5))), i) for i, k in enumerate("ab" * 30)]
    want = set()
    for k, cells, i in sorted(rows, key=lambda r: (-len(r[1]), r[2])):
        if not any(j[0] == k and set(cells) <= set(j[1]) for j in want):
            want.add((k, tuple(cells), i))
    got = findings.keep_maximal(spark.createDataFrame(rows, "k string, cells array<int>, i int"), ["k"], "cells", [F.desc(F.size("cells")), "i"]).collect()
    assert {(r["k"], tuple(r["cells"]), r["i"]) for r in got} == want


A, B = (1.5, 4.0, 2.25, 9.0, 3.0), (2.0, 0.5, 8.0, 3.5, 7.0)


@pytest.mark.parametrize("f,want,c", [(lambda a, b: a + b, "target = A + B", 1), (lambda a, b: b - a, "target = B - A", 1), (lambda a, b: a * b, "target = A * B", 1), (lambda a, b: a / b, "target = A / B", 1), (lambda a, b: 2.5 * (a - b), "target = constant * (A - B)", 2.5), (lambda a, b: 3 * a / (a + b), "target = constant * A / (A + B)", 3), (lambda a, b: a + 4 * b, "target = A + constant * B", 4), (lambda a, b: b - 3 * a, "target = B + constant * A", -3)])
def test_window_triples(spark, f, want, c):
    df = spark.createDataFrame([(1, 1, list(A)), (1, 2, list(B)), (1, 3, [f(x, y) for x, y in zip(A, B)])], "sheet int, block int, vals array<double>")
    found = relations.window_triples(df, "block", ["sheet"])
    got = [r for r in relations.maximal_triples(found).collect() if r["t"] == 3]
    assert [(r["relation"], r["constant"], r["pa"], r["pb"], r["pt"], r["length"]) for r in got if r["length"] == 5] == [(want, c, 0, 0, 0, 5)]
    assert found.where("t = 3").count() >= 6 and all(r["length"] == 5 or (r["pa"], r["pb"]) != (r["pt"], r["pt"]) for r in got)


def test_images(spark):
    rng = random.Random(3)
    wide = [rng.randrange(256) for _ in range(72)]
    square = [rng.randrange(256) for _ in range(64)]
    near = [255 - x if i == 0 else x for i, x in enumerate(square)]
    rows = [(1, "a", 100, 90, wide, square), (2, "b", 100, 90, wide, near), (3, "a", 100, 90, wide, square), (4, "c", 20, 90, wide, square)]
    df = images.pixel_hashes(spark.createDataFrame(rows, "id int, sha string, width int, height int, wide array<int>, square array<int>"))
    dhash = sum((wide[i // 8 * 9 + i % 8] > wide[i // 8 * 9 + i % 8 + 1]) << (63 - i) for i in range(64))
    assert df.first()["dhash"] % 2**64 == dhash
    assert [(r["a"], r["b"]) for r in images.near_images(df, "id").collect()] == [(1, 2)]
    assert {(r["a"], r["b"]) for r in images.near_pages(df, "id").collect()} == {(i, j) for i in range(1, 5) for j in range(i + 1, 5)}
    assert {(r["a"], r["b"]) for r in images.equal_tiles(df, "id").collect()} == {(1, 2), (1, 3), (1, 4)}
    tiles = spark.createDataFrame([(1, [0, 0, 1, 0]), (2, [10, 200, 90, 60]), (3, [255, 250, 254, 255])], "id int, pixels array<int>")
    assert [r["id"] for r in images.informative(tiles).collect()] == [2]


def test_pictures_need_a_decoder(spark):
    with pytest.raises(RuntimeError, match="PyMuPDF"):
        pictures.read_pdf_pictures(spark, "x.pdf")


def test_streamed_digit_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": f"2024-01-01T0{i % 3}:10:00", "g": "x", "raw": f"{i}.5{i % 2}"} for i in range(12)] + [{"ts": "2024-01-01T00:20:00", "g": "x", "raw": "n.d."}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("ts timestamp, g string, raw string").json(str(tmp_path / "in"))
    q = streams.digit_counts(stream, "ts", ["g"]).writeStream.format("memory").queryName("digits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["last_digit"], r["n"]) for r in spark.table("digits").groupBy("last_digit").agg(F.sum("n").alias("n")).collect()}
    assert got == {("0", 6), ("1", 6)} and spark.table("digits").count() == 6


def test_standard_run(spark, tmp_path):
    rng, rows = random.Random(1), []
    for dr in range(8):
        for dc in range(3):
            v = str(round(rng.uniform(1, 9), 3))
            rows += [("w", "s", dr + 2, dc + 2, v), ("w", "s", dr + 2, dc + 7, v)]
    rows += [("w", "s", 2, 1, "Fig 1"), ("w", "s", 2, 6, "Fig 2"), ("w", "t", 1, 1, "ctrl"), ("w", "t", 1, 2, "drug"), ("w", "t", 1, 3, "both")]
    for r in range(2, 9):
        a, b = rng.randint(1, 40), rng.randint(1, 40)
        rows += [("w", "t", r, 1, str(a)), ("w", "t", r, 2, str(b)), ("w", "t", r, 3, str(a + b))]
    cells, out = spark.createDataFrame(rows, CELLS), str(tmp_path / "out")
    assert set(audit.run_audit(cells, out, dry_run=True)) >= {"matrix_overlap", "window_triples"} and not Path(out).exists()
    paths = audit.run_audit(cells, out)
    made = {k: spark.read.parquet(v).collect() for k, v in paths.items()}
    assert [r["match_type"] for r in made["matrix_overlap"]] == ["exact_matrix_reuse"]
    assert any(r["relation"] == "target = A + B" and r["length"] == 6 for r in made["window_triples"])
    assert "Numeric matrix reuse" in Path(out, "report.md").read_text() and "<table>" in Path(out, "report.html").read_text()
    assert json.loads(Path(out, "manifest.json").read_text())["settings"]["window_values"] == 80
    assert sorted(r["id"] for r in made["findings"])[0] == "FND-0001" and len({r["id"] for r in made["findings"]}) == len(made["findings"])
    with pytest.raises(ValueError, match="three values"):
        audit.run_audit(cells, out, audit.AuditConfig(window_lengths=(2, 6)))
    sinks.write_sheets(cells, str(tmp_path / "sheets"))
    assert len(list((tmp_path / "sheets").glob("file=*"))) == 2
    csv = sinks.write_screens({"x": spark.createDataFrame([(1, [2])], "a int, b array<int>")}, str(tmp_path / "csv"), "csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(csv["x"]).collect()] == [("1", "[2]")]


def test_maximal_windows(spark):
    df = spark.createDataFrame([(1, 1, [3.0, 1.0, 9.0, 4.0, 2.0, 50.0]), (1, 2, [7.5, 2.5, 22.5, 10.0, 5.0, 13.0])], "sheet int, block int, vals array<double>")
    got = [r for r in relations.maximal_windows(sequences.window_relations(df, "block", ["sheet"])).collect() if r["relation"] == "target = source * constant"]
    assert [(r["pa"], r["pb"], r["length"]) for r in got if r["pa"] == r["pb"]] == [(0, 0, 5)]
