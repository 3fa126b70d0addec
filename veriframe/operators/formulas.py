"""Recalculation of formulas from the cells of their sheet, by a small parser (nothing is evaluated as code)."""

from __future__ import annotations

import math
import re
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
TOKEN = re.compile(r"\s*(?:(\$?[A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?)|([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)|([-+*/()]))")
CALL = re.compile(r"([A-Z][A-Z.]*)\((.*)\)", re.S)
REFERENCE = re.compile(r"(\$?)([A-Z]{1,3})(\$?)([0-9]+)")


class Unsupported(Exception):
    pass


def number(letters: str) -> int:
    return sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters)))


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shift(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it reads elsewhere; $ pins a part."""

    def moved(m: re.Match) -> str:
        col = m[2] if m[1] else letters(number(m[2]) + cols)
        return f"{m[1]}{col}{m[3]}{m[4] if m[3] else int(m[4]) + rows}"

    return REFERENCE.sub(moved, formula)


def values(ref: str, cells: dict) -> list[float]:
    ends = [REFERENCE.fullmatch(x) for x in ref.split(":")]
    (r1, r2), (c1, c2) = sorted([int(ends[0][4]), int(ends[-1][4])]), sorted([number(ends[0][2]), number(ends[-1][2])])
    if (r2 - r1 + 1) * (c2 - c1 + 1) > len(cells):  # a range larger than the sheet: its cells in row-major order
        return [v for (r, c), v in sorted(cells.items()) if r1 <= r <= r2 and c1 <= c <= c2]
    return [cells[r, c] for r in range(r1, r2 + 1) for c in range(c1, c2 + 1) if (r, c) in cells]


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise Unsupported("UNSUPPORTED_EXPRESSION_CHARACTERS")
        out.append(("ref", m[1]) if m[1] else ("num", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    return out


def expression(toks: list, cells: dict) -> float:
    """Sums of products of signed atoms; a range counts as its sum."""

    def peek():
        return toks[0][1] if toks and toks[0][0] == "op" else None

    def total() -> float:
        x = product()
        while peek() in ("+", "-"):
            x = x + product() if toks.pop(0)[1] == "+" else x - product()
        return x

    def product() -> float:
        x = atom()
        while peek() in ("*", "/"):
            if toks.pop(0)[1] == "*":
                x *= atom()
            elif (y := atom()) == 0:
                raise Unsupported("UNSUPPORTED_EVAL_ZeroDivisionError")
            else:
                x /= y
        return x

    def atom() -> float:
        if not toks:
            raise Unsupported("UNSUPPORTED_EXPRESSION_TOKEN")
        kind, t = toks.pop(0)
        if kind == "num":
            return float(t)
        if kind == "ref":
            v = values(t, cells)
            if not v and ":" not in t:
                raise Unsupported("UNSUPPORTED_EXPRESSION_TOKEN")
            return sum(v)
        if t in "+-":
            return atom() * (1 if t == "+" else -1)
        if t == "(":
            x = total()
            if peek() == ")":
                toks.pop(0)
                return x
        raise Unsupported("UNSUPPORTED_EXPRESSION_TOKEN")

    x = total()
    if toks:
        raise Unsupported("UNSUPPORTED_EXPRESSION_TOKEN")
    return x


def recalculate(formula: str | None, cells: dict) -> tuple[float | None, str]:
    text = (formula or "").strip().lstrip("=").upper().strip()
    if not text:
        return None, "UNSUPPORTED_EMPTY_OR_SHARED_WITHOUT_ORIGIN"
    try:
        m = CALL.fullmatch(text)
        if m and ")" not in m[2]:
            nums = [v for a in m[2].split(",") for v in (values(a.strip(), cells) if re.fullmatch(r"\$?[A-Z]+\$?[0-9]+(:\$?[A-Z]+\$?[0-9]+)?", a.strip()) else [float(a)] if re.fullmatch(r"\s*-?[0-9.]+\s*", a) else [])]
            if m[1] not in ("SUM", "AVERAGE", "STDEV", "STDEV.S", "STDEVP", "STDEV.P"):
                raise Unsupported(f"UNSUPPORTED_FUNCTION_{m[1]}")
            if not nums:
                raise Unsupported("UNSUPPORTED_NO_NUMERIC_ARGUMENTS")
            if m[1] in ("STDEV", "STDEV.S") and len(nums) < 2:
                raise Unsupported("UNSUPPORTED_STDEV_N_LT_2")
            done = {"SUM": math.fsum, "AVERAGE": statistics.fmean, "STDEV": statistics.stdev, "STDEV.S": statistics.stdev}.get(m[1], statistics.pstdev)
            return done(nums), ""
        # calls inside an expression are worked out first
        while inner := re.search(r"([A-Z][A-Z.]*)\(([^()]*)\)", text):
            x, why = recalculate(inner[0], cells) if inner[0] != text else (None, "UNSUPPORTED_EXPRESSION_TOKEN")
            if x is None:
                return None, why
            text = f"{text[: inner.start()]}({x!r}){text[inner.end() :]}"
        return expression(tokens(text), cells), ""
    except Unsupported as e:
        return None, str(e)


def recheck(cells: DataFrame) -> DataFrame:
    """workbook, sheet, row, col, formula, cached, recalculated, verdict; one task a sheet, as references stay in it."""
    out = "workbook string, sheet string, row int, col int, formula string, cached string, recalculated double, verdict string"

    def run(df: pd.DataFrame) -> pd.DataFrame:
        raw = {(r, c): v for r, c, v in zip(df["row"], df["col"], df["raw"], strict=True)}
        nums = {}
        for at, v in raw.items():
            try:
                x = float(v)
            except (TypeError, ValueError):
                continue
            if math.isfinite(x):
                nums[at] = x
        f = df[df["formula"].notna()]
        origin = {i: (r, c, t) for i, r, c, t in zip(f["shared_index"], f["row"], f["col"], f["formula"], strict=True) if i and t}
        rows = []
        for r, c, t, i, v in zip(f["row"], f["col"], f["formula"], f["shared_index"], f["raw"], strict=True):
            if not t and i in origin:
                t = shift(origin[i][2], r - origin[i][0], c - origin[i][1])
            x, why = recalculate(t, nums)
            cached = nums.get((r, c))
            verdict = why or ("UNSUPPORTED_NON_NUMERIC_CACHED_OR_RESULT" if cached is None else "MATCH" if abs(x - cached) <= TOLERANCE else "MISMATCH")
            rows.append((df["workbook"].iloc[0], df["sheet"].iloc[0], r, c, t, v, x, verdict))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in out.split(", ")])

    sheets = cells.where("formula is not null").select("workbook", "sheet").distinct()
    return cells.join(sheets, ["workbook", "sheet"], "left_semi").groupBy("workbook", "sheet").applyInPandas(run, out)


def verdicts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("verdict").agg(F.count("*").alias("n"))
