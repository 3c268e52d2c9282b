"""Tests, scores and cells of extracted text lines, over columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import SPACE, collapse, strip

# Characters of a class one by one: Java looks these up in one table, and tries ranges one after another.
_listed = lambda chars: "".join(f"\\x{ord(c):02X}" for c in chars)
_PLAIN = _listed(string.ascii_letters + string.digits + " \t\n\x0b\f\r")
_KNOWN = _PLAIN + _listed(",.;:'\"!?()-_/")

# Fixed values that decide the output: patterns, limits and points of lines.
INTERNAL = "resolutionId|provider=|hash=|localId|PageTitle|PageDateTime"
_TWO_WORDS = r"^[A-Za-z]+\s[A-Za-z]+\z"
_BULLET = r"^([-*•]|\d+[.)]|[A-Za-z][.)])\s+"
# what looks ahead at the first character decides nothing: most places are left at once
_INTERNAL, _NO_TITLE = f"(?=[RrPpHhLl])(?i:{INTERNAL})", f"(?=[RrPpHhLlCc])(?i:{INTERNAL}|Calibri)"
_NEAR_DAY, _TWO_VOWELS = r"\d\s+[A-Za-z]+\s+\d{4}", r"[AEIOUaeiou][^AEIOUaeiou]*+[AEIOUaeiou]"
_CLOCK, _DAY = r"(?=\d)\b\d{1,2}:\d{2}(:\d{2})?\b", r"(?=\d)\b\d{1,2}\s+[A-Za-z]+\s+\d{4}\b"
_NAMES = r"^[A-Z][a-z]+(\s+[A-Z][a-z]+){1,3}\z"
_LOUD, _DIGITS = r"^[A-Z0-9]{3,}[!?]?\z", r"\d{2,}"
#: Content has 4 to 180 characters, a letter or digit, and none of these.
_NO_CONTENT = (r"^<.*>\z", _INTERNAL, r"(?i)^Calibri(\s|\z)", f"[^{_PLAIN}]{{3}}", _LOUD)
#: Least share of characters of a class in content; a line with two digits in a row needs the first alone.
_SHARES = {_KNOWN: 0.85, "A-Za-z": 0.25}
#: Marks of binary content.
_BINARY = (r"(?i)(?=[IJEPO%])\b(IDAT|IHDR|JFIF|Exif|PK\x03\x04|%PDF|obj|endobj)\b", r"^[A-Za-z0-9+/=_-]{10,}\z", f"[^{_KNOWN}]{{2}}")
#: Two words of 3 letters or more.
_WORDS = r"(?s)^(?>.*?[A-Za-z]{3}[A-Za-z]*+).+?[A-Za-z]{3}"
#: Points of a line for what it has; structured lines have 4.
_POINTS = ((_WORDS, 2), (_CLOCK, 1), (_DAY, 1), (r"\s", 1), (_LOUD, -2))
_BINARY_POINTS = -3
#: Priority of a metadata value by key and source; the last of a key is that of other sources.
_PRIORITY = {"title": {"line-key-value": 3, "hint": 1, "": 2}, "author": {"line-key-value": 3, "": 1}, "createdAt": {"line-key-value": 3, "line-heuristic": 2, "": 1}, "modifiedAt": {"line-key-value": 3, "line-heuristic": 2, "": 1}}
#: Canonical metadata keys by label. Fixed values.
LABELS = {
    "title": "title", "page title": "title", "section title": "title", "author": "author", "owner": "author", "created by": "author", "last edited by": "author",
    "last modified by": "author", "created": "createdAt", "created at": "createdAt", "created on": "createdAt", "creation time": "createdAt", "date created": "createdAt",
    "modified": "modifiedAt", "updated": "modifiedAt", "updated at": "modifiedAt", "updated on": "modifiedAt", "last modified": "modifiedAt", "modified at": "modifiedAt",
    "modified on": "modifiedAt", "last saved": "modifiedAt", "date modified": "modifiedAt",
}


def _two_words(v: Column) -> Column:
    return v.rlike(_TWO_WORDS) & ~v.rlike("(?i)page")


def is_title(v: Column) -> Column:
    ok = F.length(v).between(4, 80) & v.rlike("[A-Za-z]") & ~v.rlike(r"[^\x20-\x7E]") & ~v.rlike(_NO_TITLE) & ~_two_words(v)
    return F.coalesce(ok, F.lit(False))


def title_score(v: Column) -> Column:
    add = lambda test, n: F.when(test, n).otherwise(0)
    return add(v.rlike("(?i)page"), 5) + add(v.rlike(r"\d"), 3) + add(F.length(v).between(5, 50), 2) - add(_two_words(v), 3)


def says(v: Column, *words: str) -> Column:
    """Whether a line holds any of the words in any case; it may be true for letters that Unicode alone has as forms of others, so patterns follow."""
    out = F.lit(False)
    for word in words:
        out |= F.lower(v).contains(word.lower())
    return out


def _has_clock(v: Column) -> Column:
    return v.contains(":") & v.rlike(_CLOCK)


def _has_day(v: Column) -> Column:
    return v.rlike(_NEAR_DAY) & v.rlike(_DAY)


def _share(v: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(v, f"[^{keep}]", "")) / F.length(v)


def is_preview(v: Column) -> Column:
    """Whether a line is likely to be content; values that are blocked are left out by an anti-join instead."""
    ok = F.length(v).between(4, 180) & v.rlike("[A-Za-z0-9]") & (~v.rlike(_NAMES) | v.rlike("(?i)page"))
    tag, internal, font, strange, loud = _NO_CONTENT
    ok &= ~v.rlike(tag) & ~(says(v, *INTERNAL.split("|")) & v.rlike(internal)) & ~v.rlike(font) & ~v.rlike(loud)
    (known, least), (letters, some) = _SHARES.items()
    # a line of plain characters alone has no strange ones, and all that it has are known
    ok &= ~v.rlike(f"[^{_PLAIN}]") | ~v.rlike(strange) & (_share(v, known) >= least)
    ok &= v.rlike(_DIGITS) | (_share(v, letters) >= some) & v.rlike("[A-Za-z]{3,}")
    spoken = v.rlike(_TWO_VOWELS) & (v.rlike(r"\s") | (F.length(v) <= 16))
    return F.coalesce(ok & (spoken | _has_clock(v) | _has_day(v)), F.lit(False))


def looks_binary(v: Column) -> Column:
    named, coded, strange = _BINARY
    return v.rlike(coded) | v.rlike(f"[^{_KNOWN}]") & v.rlike(strange) | v.rlike(named)


def heading_level(v: Column) -> Column:
    """1 to 3 for # marks, 2 for a short label with a colon, else null."""
    return F.when(v.rlike(r"^#{1,3}\s+.+\z"), F.length(F.regexp_extract(v, "^(#{1,3})", 1))).when(v.rlike(r"^[A-Z][A-Za-z0-9\s]{2,60}:\z"), 2)


def heading_text(v: Column) -> Column:
    return F.when(v.rlike(r"^#{1,3}\s+.+\z"), strip(F.regexp_replace(v, r"^#{1,3}\s+", ""))).when(v.rlike(r"^[A-Z][A-Za-z0-9\s]{2,60}:\z"), strip(F.regexp_replace(v, r":\z", "")))


def cells(line: Column, stripped: bool = False) -> Column:
    """struct<delimiter, cells> of a table row parted by tabs, pipes or runs of spaces, in this order; null if it is none.

    stripped: line has no white space at its ends; a column of its own for that is computed once.
    """
    v = line if stripped else strip(line)
    cut = lambda mark: F.transform(F.split(v, mark), strip)
    full = lambda a: F.filter(a, lambda c: c != "")
    row = lambda kind, a: F.struct(F.lit(kind).alias("delimiter"), a.alias("cells"))
    tab, pipe, space = full(cut("\t")), full(cut(r"\|")), full(cut(r"\s{2,}"))
    piped = v.contains("|") & (F.size(pipe) >= 2) & (v.startswith("|") | v.endswith("|") | (F.size(cut(r"\|")) >= 3))
    spaced = v.rlike(r"\s{2,}") & (F.size(space) >= 2) & (F.size(F.filter(space, lambda c: c.rlike("[A-Za-z0-9]"))) >= 2)
    found = F.when(v.contains("\t") & (F.size(tab) >= 2), row("tab", tab)).when(piped, row("pipe", pipe)).when(spaced, row("space", space))
    return F.when(v.contains("\t") | v.contains("|") | v.rlike(r"\s{2}"), found)


def is_row(v: Column) -> Column:
    """Whether cells() of a line without white space at its ends are not null; cells are not made."""
    cell = SPACE.replace("[", "[^|", 1)
    piped = v.contains("|") & v.rlike(rf"{cell}[^|]*+\|{SPACE.replace('[', '[|', 1)}*+{cell}") & (v.startswith("|") | v.endswith("|") | v.rlike(r"\|[^|]*+\|"))
    spaced = v.rlike(r"\s{2}") & v.rlike(r"(?s)^[^A-Za-z0-9]*+(?>.*?\s\s).*[A-Za-z0-9]")
    return F.coalesce(v.contains("\t") | piped | spaced, F.lit(False))


def _starts_block(v: Column) -> Column:
    return v.rlike(_BULLET) | heading_level(v).isNotNull() | is_row(v)


def is_separator(a: Column) -> Column:
    return (F.size(a) >= 2) & F.forall(a, lambda c: strip(c).rlike(r"^:?-{3,}:?\z"))


def line_score(line: Column, stripped: bool = False) -> Column:
    """Points of a line; null for a blank one. stripped: line has no white space at its ends."""
    v = line if stripped else strip(line)
    tests = {_CLOCK: _has_clock(v), _DAY: _has_day(v)}
    score = F.when(looks_binary(v), _BINARY_POINTS).otherwise(0)
    for pattern, points in _POINTS:
        score += F.when(tests.get(pattern, v.rlike(pattern)), points).otherwise(0)
    structured = _starts_block(v)
    return F.when(v == "", None).when(structured, 4).otherwise(score)


def paragraph_marks(line: Column) -> dict[str, Column]:
    """What joins_paragraph() asks of a line, each of the line alone: full and ended of the one before, open and capital of the next."""
    v = strip(line)
    return {"full": v != "", "ended": v.rlike(r"[.!?;:]\z"), "open": (v != "") & ~_starts_block(v), "capital": v.rlike("^[A-Z][A-Za-z0-9]")}


def joins_marks(full: Column, ended: Column, open_: Column, capital: Column) -> Column:
    return F.coalesce(full & open_ & ~(ended & capital), F.lit(False))


def joins_paragraph(before: Column, line: Column) -> Column:
    p, n = paragraph_marks(before), paragraph_marks(line)
    return joins_marks(p["full"], p["ended"], n["open"], n["capital"])


def line_class(line: Column, stripped: bool = False, tables: bool = True) -> Column:
    """Kind of a line; without tables, for lines that are known to be no table rows."""
    v = line if stripped else strip(line)
    out = F.when(v == "", "blank")
    if tables:
        out = out.when(is_row(v), "table")
    return out.when(v.rlike(r"^[-*•]\s+"), "ul").when(v.rlike(r"^(\d+[\.)]|[A-Za-z][\.)])\s+"), "ol").when(heading_level(v).isNotNull(), "heading").otherwise("paragraph")


def is_date(v: Column) -> Column:
    v = collapse(v)
    return v.rlike(r"^\d{1,2}\s+[A-Za-z]{3,}\s+\d{4}\z") | v.rlike(r"^\d{4}-\d{2}-\d{2}\z") | v.rlike(r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\z")


def is_time(v: Column) -> Column:
    return collapse(v).rlike(r"(?i)^\d{1,2}:\d{2}(:\d{2})?(\s?[AP]M)?\z")


def metadata_label(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(label)), r"[_\-]+", " "), r"\s+", " ")


def metadata_key(label: Column) -> Column:
    v = metadata_label(label)
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, v), F.when(v.startswith("created "), "createdAt").when(v.startswith("modified ") | v.startswith("updated "), "modifiedAt"))


def metadata_priority(key: Column, source: Column) -> Column:
    table = F.create_map(*[x for k, of in _PRIORITY.items() for x in (F.lit(k), F.create_map(*[F.lit(y) for pair in of.items() for y in pair]))])
    own = F.try_element_at(table, key)
    return F.coalesce(F.try_element_at(own, source), F.try_element_at(own, F.lit("")), F.lit(0))


def metadata_date(value: Column) -> Column:
    """ISO form in UTC of a date of a known form; day-first or month-first dates without a zone, and others, as they are."""
    v = strip(value)
    local = v.rlike(r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b") & ~v.rlike(r"(?i)(z|utc|gmt|[+\-]\d{2}:?\d{2})\z")
    plain = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3,9},\s*", ""), r"(?i)\s*(gmt|utc)\z", "Z")  # without day of the week
    # forms by what each of them begins with: a form that fails is slow, so those that can't fit are not tried
    forms = {
        r"^\D?\d+-\d\d-\d\d": ("yyyy-MM-dd'T'HH:mm:ss[.SSS]X", "yyyy-MM-dd'T'HH:mm[:ss]", "yyyy-MM-dd HH:mm[:ss]", "yyyy-MM-dd"),
        r"^\d+ [A-Za-z]+ ": ("d MMMM yyyy[ HH:mm[:ss]]", "d MMM yyyy[ HH:mm[:ss]]", "d MMM yyyy HH:mm:ss[ ]XX"),
        r"^[A-Za-z]+ \d+, ": ("MMMM d, yyyy[ HH:mm[:ss]]", "MMM d, yyyy[ HH:mm[:ss]]"), r"^\D?\d+/\d\d/": ("yyyy/MM/dd",),
    }
    parsed = F.coalesce(*[F.when(plain.rlike(start), F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in some])) for start, some in forms.items()])
    return F.when(local, v).otherwise(F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), v))
