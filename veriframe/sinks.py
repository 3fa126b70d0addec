"""Results as tables, CSV files, a report in Markdown or HTML, and a manifest of the environment.

Tables and CSV files are written by the executors to any path that Spark writes to. Reports hold a stated number of
findings a category; their text is made on the driver from those rows alone.
"""

from __future__ import annotations

import hashlib
import html
import json
import platform
import re

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.findings import report_order, rollup, top


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for CSV."""
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes])


def write_screens(screens: dict[str, DataFrame], out: str, kind: str = "parquet") -> dict[str, str]:
    """One table a screen below out; returns their paths."""
    paths = {}
    for name, df in screens.items():
        paths[name] = f"{out}/{name}"
        writer = (flat(df) if kind == "csv" else df).write.mode("overwrite")
        writer.option("header", True).csv(paths[name]) if kind == "csv" else writer.parquet(paths[name])
    return paths


def read_screens(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(v) for k, v in paths.items()}


def file_name(workbook: str, sheet: str) -> str:
    """A file name of both, with a digest so that names that differ never meet."""
    clean = re.sub(r"[^A-Za-z0-9._-]+", "_", f"{workbook.rpartition('/')[2]}__{sheet}").strip("_")
    return f"{clean}-{hashlib.sha256(f'{workbook}|{sheet}'.encode()).hexdigest()[:8]}"


def write_sheets(cells: DataFrame, out: str) -> None:
    """Filled cells by sheet: one folder of CSV rows (row, values in column order as JSON) for each."""
    rows = cells.groupBy("workbook", "sheet", "row").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "raw"))))).alias("values"))
    named = F.udf(file_name, "string", useArrow=True)
    rows.withColumn("file", named("workbook", "sheet")).repartition("file").sortWithinPartitions("file", "row").select("file", "row", "values").write.mode("overwrite").partitionBy("file").option("header", True).csv(out)


def manifest(spark: SparkSession, settings: dict, inputs: DataFrame | None = None) -> dict:
    """Versions, settings and their digest; of inputs (path, content) the number and a digest over their sha256."""
    out = {"python": platform.python_version(), "pyspark": pyspark.__version__, "java": spark.sparkContext._jvm.System.getProperty("java.version"), "settings": settings, "settings_sha256": hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()}
    if inputs is not None:
        files = inputs.select("path", F.sha2("content", 256).alias("sha"))
        n, digest = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "sha"))).first()
        out |= {"files": n, "files_digest": digest}
    return out


def report_rows(findings: DataFrame, limit: int = 50) -> tuple[list, list]:
    """Counts of each category, and its first findings (limit of each; 0: all) in report order."""
    counts = rollup(findings).orderBy("category").collect()  # one row a category
    return counts, top(findings, ["category"], report_order(), limit).orderBy(*report_order()).collect()


def markdown(findings: DataFrame, limit: int = 50) -> str:
    """Findings: category, id, risk, place, detail."""
    counts, rows = report_rows(findings, limit)
    text = ["# Screening report", "", "Every row is a candidate for review, not a conclusion.", "", "| category | findings | high | warn |", "|---|---|---|---|"]
    text += [f"| {r['category']} | {r['total']} | {r['high']} | {r['warn']} |" for r in counts]
    for category in dict.fromkeys(r["category"] for r in rows):
        text += ["", f"## {category}", ""] + [f"- `{r['id']}` {r['risk']}: {r['place']}: {r['detail']}" for r in rows if r["category"] == category]
        shown, all_ = sum(r["category"] == category for r in rows), next(c["total"] for c in counts if c["category"] == category)
        text += [f"- {all_ - shown} more in the table"] if all_ > shown else []
    return "\n".join(text) + "\n"


def page(findings: DataFrame, limit: int = 50) -> str:
    """The same as an HTML page."""
    counts, rows = report_rows(findings, limit)
    e = lambda x: html.escape(str(x if x is not None else ""))
    table = lambda head, body: "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in body) + "</table>"
    parts = [table(("category", "findings", "high", "warn"), [(r["category"], r["total"], r["high"], r["warn"]) for r in counts])]
    for category in dict.fromkeys(r["category"] for r in rows):
        parts.append(f"<h2>{e(category)}</h2>" + table(("id", "risk", "place", "detail"), [(r["id"], r["risk"], r["place"], r["detail"]) for r in rows if r["category"] == category]))
    return "<!doctype html><meta charset=utf-8><title>Screening report</title><h1>Screening report</h1><p>Every row is a candidate for review, not a conclusion.</p>" + "".join(parts)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file at any path that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()
