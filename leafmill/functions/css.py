"""Style declarations and lengths over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import strip

#: Keys of indentation and of list hints that editors leave behind. Fixed values.
INDENT = ("margin-left", "padding-left", "text-indent")
HINTS = ("mso-list", "mso-level-number-format", "mso-level-text")
#: Types of ordered lists by style. Fixed values.
LIST_TYPES = {"upper-alpha": "A", "lower-alpha": "a", "upper-roman": "I", "lower-roman": "i", "decimal": "1"}
_LENGTH = r"^(-?\d*\.?\d+)\s*(px|pt|em|rem)?\z"


def px(value: Column) -> Column:
    """Pixels of a length in px, pt, em or rem (px if none is given); null for others."""
    v = F.lower(strip(value))
    number, unit = F.regexp_extract(v, _LENGTH, 1).try_cast("double"), F.regexp_extract(v, _LENGTH, 2)
    return F.when(unit == "pt", number * F.lit(96.0) / F.lit(72.0)).when(unit.isin("em", "rem"), number * 16).otherwise(number)


def _bucket(x: Column, steps: list[tuple[float, str]], beyond: str) -> Column:
    out = F.when(x.isNull(), None)
    for most, name in steps:
        out = out.when(x <= most, name)
    return out.otherwise(beyond)


def font_size(value: Column) -> Column:
    return _bucket(px(value), [(12, "text-xs"), (14, "text-sm"), (17, "text-base"), (20, "text-lg")], "text-xl")


def font_weight(value: Column) -> Column:
    v = F.lower(strip(value))
    number = F.regexp_extract(v, r"^([+-]?\d+)", 1).try_cast("int")
    return F.when(v == "normal", "font-normal").when(v == "bold", "font-bold").otherwise(_bucket(number, [(450, "font-normal"), (550, "font-medium"), (650, "font-semibold")], "font-bold"))


def margin(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), _bucket(px(value), [(0, "0"), (4, "1"), (8, "2"), (12, "3"), (16, "4")], "6"))


def declarations(style: Column, lower: bool = True) -> Column:
    """array<struct<prop, value>> of a style text, names in small letters if lower; parts without a colon or a name go."""
    prop = lambda p: strip(F.substring_index(p, ":", 1))
    parts = F.transform(F.split(F.coalesce(style, F.lit("")), ";"), lambda p: F.struct((F.lower(prop(p)) if lower else prop(p)).alias("prop"), strip(F.substring(p, F.instr(p, F.lit(":")) + F.lit(1), F.length(p))).alias("value"), (F.instr(p, F.lit(":")) > 0).alias("ok")))
    return F.transform(F.filter(parts, lambda d: d["ok"] & (d["prop"] != "")), lambda d: F.struct(d["prop"].alias("prop"), d["value"].alias("value")))


def style_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda d: F.concat(d["prop"], F.lit(": "), d["value"])), "; ")


def remove_keys(entries: Column, keys: tuple[str, ...] = INDENT + HINTS) -> Column:
    return F.filter(entries, lambda d: ~d["prop"].isin(*keys))


def upsert(entries: Column, key: str, value: str) -> Column:
    """The key goes from where it stands and comes last with the value."""
    return F.array_append(remove_keys(entries, (key,)), F.struct(F.lit(key).alias("prop"), F.lit(value).alias("value")))


def excess_indent(entries: Column) -> Column:
    return F.exists(entries, lambda d: d["prop"].isin(*HINTS) | (d["prop"].isin(*INDENT) & F.coalesce(F.abs(px(d["value"])) >= 24, F.lit(False))))


def list_type(style: Column) -> Column:
    found = F.lower(strip(F.regexp_extract(F.lower(style), r"list-style-type\s*:\s*([^;]+)", 1)))
    out = F.when(F.lit(False), "")
    for name, kind in LIST_TYPES.items():
        out = out.when(found == name, kind)
    return out


def add_classes(classes: Column, names: list[str]) -> Column:
    return F.array_union(F.filter(F.split(F.coalesce(classes, F.lit("")), r"\s+"), lambda c: c != ""), F.array(*map(F.lit, names)))
