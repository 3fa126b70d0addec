"""Number-text functions as Column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a missing number.
NULL_TOKENS = ("", "na", "nan", "none", "null", "inf", "-inf")
NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def cleaned(raw: Column) -> Column:
    return F.rtrim(F.replace(F.trim(raw), F.lit(","), F.lit("")), F.lit("%"))


def is_number(raw: Column) -> Column:
    """Guarded by a pattern, as a bare cast would accept '1d'; the tokens of missing numbers do not fit it."""
    return F.coalesce(cleaned(raw).rlike(NUMERIC), F.lit(False))


def to_number(raw: Column) -> Column:
    return F.when(is_number(raw), cleaned(raw).try_cast("double"))


def decimal_places(raw: Column) -> Column:
    """Digits after the point; an exponent shifts them, floor 0."""
    x = cleaned(raw)
    dot = F.instr(x, ".")
    plain = F.when(dot > 0, F.length(x) - dot).otherwise(0)
    frac = F.length(F.regexp_extract(x, r"\.([0-9]*)", 1))
    exp = F.coalesce(F.regexp_extract(x, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.when(F.contains(F.lower(x), F.lit("e")), F.greatest(F.lit(0), frac - exp)).otherwise(plain)


def last_digit(raw: Column) -> Column:
    end = F.right(raw, F.lit(1))  # most numbers end with a digit
    return F.when(end.between("0", "9"), end).otherwise(F.right(F.regexp_replace(raw, "[^0-9]", ""), F.lit(1)))


def first_digit(raw: Column) -> Column:
    start = F.left(F.ltrim(raw, F.lit(" +-0.,")), F.lit(1))
    return F.when(start.between("1", "9"), start).otherwise(F.regexp_extract(raw, "[1-9]", 0))


def decimal_tail(raw: Column) -> Column:
    frac = F.regexp_extract(cleaned(raw), r"\.([0-9]*)$", 1)
    return F.when(F.length(frac) >= 3, F.right(frac, F.lit(3)))


def float_artifact(raw: Column) -> Column:
    """A long fraction with a run of zeros or nines that is within 1e-12 of a short rounding."""
    frac, d = F.regexp_extract(cleaned(raw), r"\.([0-9]+)$", 1), cleaned(raw).try_cast("decimal(38,20)")
    near = F.array(*[F.abs(d - F.bround(d, k)) <= F.lit("0.000000000001").cast("decimal(38,20)") for k in range(7)])
    return F.coalesce((F.length(frac) > 6) & frac.rlike("000000|999999") & F.exists(near, lambda x: x), F.lit(False))


def a1(row: Column, col: Column) -> Column:
    """Spreadsheet address of 1-based row and column, up to three letters."""
    c = col - 1
    letter = lambda k: F.char((k % 26) + 65)
    two, three = F.floor(c / 26) - 1, F.floor((F.floor(c / 26) - 1) / 26) - 1
    name = F.concat(F.when(c >= 702, letter(three)).otherwise(""), F.when(c >= 26, letter(two)).otherwise(""), letter(c))
    return F.concat(name, row.cast("string"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
