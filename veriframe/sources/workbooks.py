"""Workbook and delimited sources. A workbook is one row of binaryFile; cells come out in long form."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import NULL_TOKENS
from .display import BUILT_IN, displayed

CELLS = "workbook string, sheet string, row int, col int, raw string, cell_type string, formula string, shared_index string, shared_ref string, number_format string"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parts(node, name: str):
    return (x for x in node.iter() if local(x.tag) == name)


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def style_formats(content: bytes) -> list[str | None]:
    """Number format of each cell style."""
    root = ElementTree.fromstring(content)
    own = {int(x.get("numFmtId", 0)): x.get("formatCode") for x in parts(root, "numFmt")}
    styles = next(parts(root, "cellXfs"), ())
    return [own.get(i, BUILT_IN.get(i)) for i in (int(x.get("numFmtId", 0)) for x in styles if local(x.tag) == "xf")]


def workbook_cells(name: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in parts(si, "t")) for si in parts(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
        rels = {r.get("Id"): r.get("Target", "") for r in parts(ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")), "Relationship") if r.get("Type", "/worksheet").endswith("/worksheet")}
        formats = style_formats(z.read("xl/styles.xml")) if "xl/styles.xml" in names else []
        for sheet in parts(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            rid = next((v for k, v in sheet.attrib.items() if local(k) == "id"), None)
            target = rels.get(rid)
            if target is None:
                continue
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            for c in parts(ElementTree.fromstring(z.read(path)), "c"):
                at = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r", ""))
                if not at:
                    continue
                kind, kids = c.get("t", "n"), {local(k.tag): k for k in c}
                raw = kids["v"].text or "" if "v" in kids else ""
                if kind == "s":
                    raw = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
                elif kind == "inlineStr":
                    raw = "".join(t.text or "" for t in parts(c, "t"))
                f = kids.get("f")
                shared = f is not None and f.get("t") == "shared"
                yield name, sheet.get("name"), int(at[2]), column_number(at[1]), raw.strip(), kind, None if f is None else f.text or "", f.get("si") if shared else None, f.get("ref") if shared else None, formats[int(c.get("s"))] if (c.get("s") or "").isdigit() and int(c.get("s")) < len(formats) else None


# Folders of earlier results.
EXCLUDED = (".git", "__pycache__", "audit_results", "source_data_scan", "pdf_image_scan", "visual_report", "_standard_xlsx_inputs")


def discovered(files: DataFrame, root: str, all_folders: bool = False) -> DataFrame:
    """Files (path, ...) without lock files (~$...) and, unless asked for, without those in folders of earlier results; each path once."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    below = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").rpartition("/")[2]) + "/", "")
    folders = F.slice(F.split(below, "/"), F.lit(1), F.size(F.split(below, "/")) - 1)
    out = files.where(~name.rlike(r"^(~|%7E)\$"))
    return (out if all_folders else out.where(~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED))))).dropDuplicates(["path"])


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xls[xm]", all_folders: bool = False) -> DataFrame:
    """Cells of all workbooks below a path; a workbook is named by its whole path."""
    if path.lower().endswith(".xls"):
        raise ValueError("workbooks of the old .xls kind are not read; save them as .xlsx")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = discovered(files.select("path", "content"), path, all_folders)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split()[0] for x in CELLS.split(",")]
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(list(workbook_cells(p, c)), columns=names)

    return files.mapInPandas(run, CELLS)


def as_displayed(cells: DataFrame) -> DataFrame:
    """Cells with raw as the sheet shows it, by each number's format."""

    @F.pandas_udf("string")
    def show(raw: pd.Series, number_format: pd.Series) -> pd.Series:
        return pd.Series([displayed(a, b) for a, b in zip(raw, number_format, strict=True)], dtype=object)

    shown = F.when(F.col("number_format").isNotNull() & (F.col("cell_type") == "n"), show("raw", "number_format")).otherwise(F.col("raw"))
    return cells.withColumn("raw", shown)


def columns_of(cells: DataFrame) -> DataFrame:
    """Sheets as tables: row 1 names the columns (blank ones by place, repeated ones with .1, .2 and so on). workbook, sheet, column, row, raw."""
    sheet = Window.partitionBy("workbook", "sheet")
    wide = cells.groupBy("workbook", "sheet").agg(F.max("col").alias("n")).select("workbook", "sheet", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("col"))
    first = cells.where("row = 1 and trim(raw) <> ''").select("workbook", "sheet", "col", F.trim("raw").alias("name"))
    named = wide.join(first, ["workbook", "sheet", "col"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("column_"), F.col("col").cast("string"))))
    again = F.row_number().over(sheet.partitionBy("workbook", "sheet", "name").orderBy("col")) - 1
    named = named.withColumn("k", again).select("workbook", "sheet", "col", F.when(F.col("k") > 0, F.concat("name", F.lit("."), F.col("k").cast("string"))).otherwise(F.col("name")).alias("column"))
    return cells.where("row > 1").join(named, ["workbook", "sheet", "col"]).select("workbook", "sheet", "column", "row", "raw")


def cleaned_nulls(df: DataFrame) -> DataFrame:
    """Text columns with the tokens of missing values as empty text."""
    c = lambda x: F.trim(F.regexp_replace(x, "\ufeff", ""))
    return df.select(*[F.when(F.lower(c(F.col(f"`{x}`"))).isin(*NULL_TOKENS) | F.col(f"`{x}`").isNull(), "").otherwise(c(F.col(f"`{x}`"))).alias(x.lstrip("\ufeff").strip()) for x in df.columns])


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, needs: tuple = ()) -> DataFrame:
    """All-text table with a header row, missing values as empty text.

    The delimiter is a tab for .tsv, else that of comma, tab, semicolon and blank whose count is most even over the first 4096
    characters. Columns that are needed and missing raise.
    """
    if delimiter is None:
        head = "\n".join(r[0] for r in spark.read.text(path).limit(50).collect())[:4096]
        lines = [x for x in head.split("\n") if x.strip()] or [""]
        even = lambda d: (min(x.count(d) for x in lines) > 0 and len({x.count(d) for x in lines}) == 1, min(x.count(d) for x in lines))
        delimiter = "\t" if path.endswith(".tsv") else max(",\t; ", key=even)
    df = cleaned_nulls(spark.read.csv(path, header=True, inferSchema=False, sep=delimiter, encoding="UTF-8"))
    if missing := [x for x in needs if x not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df


def load_tables(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Columns of a workbook (as displayed) or delimited file: workbook, sheet, column, row, raw."""
    kind = path.lower().rpartition(".")[2]
    if kind in ("xlsx", "xlsm", "xls"):
        cells = as_displayed(read_workbooks(spark, path))
        if sheet is not None and cells.where(F.col("sheet") == sheet).isEmpty():
            raise ValueError(f"{path} has no sheet {sheet}")
        return columns_of(cells if sheet is None else cells.where(F.col("sheet") == sheet))
    if kind in ("csv", "tsv", "txt"):
        df = read_delimited(spark, path)
        long = df.withColumn("row", F.monotonically_increasing_id() + 2).unpivot(["row"], [f"`{c}`" for c in df.columns], "column", "raw")
        return long.select(F.lit(path).alias("workbook"), F.lit("").alias("sheet"), "column", "row", "raw")
    raise ValueError(f"{path}: only xlsx, xlsm, csv, tsv and txt are read")


def melt(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long form (keys..., column, raw) of columns as text."""
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, "column", "raw")
