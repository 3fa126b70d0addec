"""Numbers as a sheet shows them: the number format's places, percent signs and optional zeros."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation

# What a number format holds besides digits: quoted text, escaped, padded and repeated characters, brackets.
QUIET = re.compile(r'"[^"]*"?|[\\_*].?|\[[^\]]*\]')
# Formats by their built-in number.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 49: "@"}


def places(number_format: str | None) -> tuple[int, int, int] | None:
    """(most places, required places, percent signs) of the first section; None if it sets none (General, scientific, text)."""
    section = QUIET.sub("", (number_format or "").split(";")[0])
    whole, _, fraction = section.partition(".")
    if re.search("general|e", section, re.I) or not re.search("[0#?]", section):
        return None
    return len(re.findall("[0#?]", fraction)), fraction.count("0"), section.count("%")


def displayed(raw: str, number_format: str | None) -> str:
    """The text shown for a stored number; other texts and formats without places stay as they are."""
    rule = places(number_format)
    try:
        value = Decimal(raw) if rule else None
        if value is None or not value.is_finite():
            return raw
        most, least, percent = rule
        text = f"{(value * 100**percent).quantize(Decimal(1).scaleb(-most), ROUND_HALF_EVEN):.{most}f}"
    except InvalidOperation:
        return raw
    if most > least:
        head, _, tail = text.partition(".")
        tail = tail[:least] + tail[least:].rstrip("0")
        text = f"{head}.{tail}" if tail else head
    return text + "%" * bool(percent)


def unique_headers(names: list[str | None]) -> list[str]:
    """Blank names as column_1 and so on by place; a repeated name gets .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for k, name in enumerate(names, 1):
        name = (name or "").strip() or f"column_{k}"
        out.append(f"{name}.{seen[name]}" if name in seen else name)
        seen[name] = seen.get(name, 0) + 1
    return out
