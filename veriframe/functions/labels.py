"""Label functions and predicates as Column expressions, and text utilities of the findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import cleaned, is_number, to_number

# Patterns of figure labels, axis labels, axis or id labels and derived or summary labels.
FIGURE = r"(?i)(?:^|\b)(?:fig|sfig|supplementary|extended|extneded)\.?\s*[\w .,\-]*"
AXIS = r"(?i)^(?:time|timepoint|day|week|hour|hours|0w|1w|2w|4w|6w|8w|12w|w(?:\b|\d)|h(?:\b|\d)|\d+\s*[whd]?\b|wavelength|retention)"
AXIS_OR_ID = (
    r"(?i)\b(?:time|minute|min|hour|day|week|month|age|dose|dosage|concentration|conc\.?|wavelength|retention|elapsed|distance|pixel|lane|animal|mouse|rat|"
    r"sample\s*(?:id|no|number)|\bid\b|\bno\.?\b|number|replicate|well|position|coordinate|x\s*axis|y\s*axis)\b"
)
DERIVED = (
    r"(?i)\b(?:mean|average|avg|sd|sem|se\b|stderr|error|p\s*value|pval|q\s*value|ratio|fold|normalized|normalised|relative|percent|percentage|total|sum|"
    r"difference|delta|change|auc|ic50|ec50|score|index|z\s*score|log2|log10|control\s*mean)\b|%"
)


def filled(raw: Column) -> Column:
    return F.coalesce(F.trim(raw) != "", F.lit(False))


def is_text(raw: Column) -> Column:
    return filled(raw) & ~is_number(raw)


def is_figure(raw: Column) -> Column:
    return is_text(raw) & raw.rlike(FIGURE)


def is_axis(label: Column) -> Column:
    return F.coalesce(F.trim(label).rlike(AXIS), F.lit(False))


def is_axis_or_id(label: Column) -> Column:
    return F.coalesce(label.rlike(AXIS_OR_ID), F.lit(False))


def is_derived(label: Column) -> Column:
    return F.coalesce(label.rlike(DERIVED), F.lit(False))


def normalized(label: Column) -> Column:
    """No-break spaces and runs of blanks as one space, lower case, trimmed; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(F.translate(label, " ", " ")), r"\s+", " ")), F.lit(""))


def significant(x: Column, digits: int) -> Column:
    """Shortest text of a number at so many significant digits; infinite and NaN as empty text."""
    text = F.format_string(f"%.{digits - 1}e", x)  # d.ddde+xx
    power = F.regexp_extract(text, r"e([+-][0-9]+)$", 1).cast("int")
    short = F.regexp_replace(F.regexp_extract(text, r"^([^e]*)e", 1), r"\.?0+$", "")
    short = F.when(F.regexp_extract(text, r"^([^e]*)e", 1).contains("."), short).otherwise(F.regexp_extract(text, r"^([^e]*)e", 1))
    places = F.greatest(F.lit(0), F.lit(digits - 1) - power)
    plain = F.expr("1").cast("string")
    for k in range(digits + 4, -1, -1):  # one format for each number of places
        plain = F.when(places == k, F.format_string(f"%.{k}f", x)).otherwise(plain)
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    science = F.concat(short, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    out = F.when((power < -4) | (power >= digits), science).otherwise(plain)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), "").when(x == 0, "0").otherwise(out)


def shown(x: Column) -> Column:
    """A number at ten significant digits."""
    return significant(x, 10)


def value_key(raw: Column) -> Column:
    """Numbers at 15 significant digits (d.dd...e+xx, zero as 0), other texts trimmed: equal keys are equal values."""
    x = to_number(raw)
    return F.when(x == 0, "0").when(x.isNotNull(), F.format_string("%.14e", x)).otherwise(F.trim(raw))


def mixed_key(raw: Column) -> Column:
    return F.when(is_number(raw), value_key(raw)).otherwise(normalized(raw))


def column_artifact(raw: Column) -> Column:
    """Float artefact of a column value: a plain fraction of ten digits or more with a run of zeros or nines, near a short rounding."""
    frac, d = F.regexp_extract(cleaned(raw), r"\.([0-9]+)$", 1), cleaned(raw).try_cast("decimal(38,20)")
    near = F.array(*[F.abs(d - F.bround(d, k)) <= F.lit("0.000000000001").cast("decimal(38,20)") for k in range(7)])
    return F.coalesce((F.length(frac) >= 10) & frac.rlike("000000|999999") & F.exists(near, lambda x: x), F.lit(False))


def simple_ratio(x: Column, most: int = 20, rel: float = 1e-5) -> Column:
    """'p/q' of the closest fraction with q up to most, within rel; else null."""
    options = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda q: F.struct(F.abs(F.abs(x) - F.round(F.abs(x) * q) / q).alias("gap"), q.alias("q"), F.round(F.abs(x) * q).cast("long").alias("p")))
    best = F.array_min(options)
    text = F.concat(F.when(x < 0, "-").otherwise(""), best["p"].cast("string"), F.when(best["q"] > 1, F.concat(F.lit("/"), best["q"].cast("string"))).otherwise(""))
    return F.when((best["p"] > 0) & (best["gap"] <= rel * F.abs(x)), text)


def compact(text: Column, length: int = 160) -> Column:
    """Blanks joined; cut to length with an ellipsis."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(one) > length, F.concat(F.rtrim(F.substring(one, 1, length - 3)), F.lit("..."))).otherwise(one)


def split_flags(flags: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(flags, F.lit("")), r"[;,|]"), lambda x: F.trim(x)), lambda x: x != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
