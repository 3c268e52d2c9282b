"""Changes to markup that need no tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unwrap_lists(html: Column) -> Column:
    """Bullet lists that hold nothing but one numbered list give way to it."""
    return F.regexp_replace(html, r"(?is)<ul[^>]*+>\s*+(<ol[^>]*+>(?:[^<]++|<li\b[^>]*+>|</li>)*+</ol>)\s*+</ul>", "$1")


def break_lines(html: Column) -> Column:
    return F.regexp_replace(html, r">\s*<", ">\n<")


def links(html: Column) -> Column:
    """Values of src and href attributes in quotes, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)\b(?:src|href)="([^"]*)"'), F.lit(1))


def mail_residue(html: Column) -> Column:
    """Whether headers or boundaries of mail parts are left in the text."""
    return html.rlike(r"(?im)^(mime-version|content-transfer-encoding|content-location|content-type):") | html.rlike(r"(?m)^------=_")
