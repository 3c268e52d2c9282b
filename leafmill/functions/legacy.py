"""Changes of the older cleaning, over markup as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import escape_html


def quote_dimensions(html: Column) -> Column:
    """Widths and heights of digits get quotes; control characters but for tabs and line ends go."""
    plain = F.regexp_replace(html, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.regexp_replace(plain, r"(?i)(<img\b[^>]*?\s(?:width|height))\s*=\s*(\d+)(?=[\s/>])", '$1="$2"')


def drop_empty_dimensions(html: Column) -> Column:
    """Images lose widths and heights without a number."""
    return F.regexp_replace(html, r"(?i)(<img\b[^>]*?)\s(?:width|height)\s*=\s*(?:\"\s*\"|'\s*'|(?=[\s>]))", "$1")


def narrow_spaces(html: Column) -> Column:
    """Runs of spaces and tabs are one space, runs of blank lines one line end."""
    return F.regexp_replace(F.regexp_replace(html, r"[ \t]+", " "), r"(?:\r?\n\s*){2,}", "\n")


def rebuild_head(html: Column, css: str) -> Column:
    """A head of charset, viewport, the page's title and a style sheet in place of its own."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    head = F.concat(F.lit('<head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1.0"><title>'), F.when(title == "", "Document").otherwise(title), F.lit(f'</title><link rel="stylesheet" href="{css}"></head>'))
    parts = r"(?is)^(.*?)<head\b[^>]*>.*?</head>(.*)\z"
    return F.when(html.rlike(parts), F.concat(F.regexp_extract(html, parts, 1), head, F.regexp_extract(html, parts, 2))).otherwise(html)


def complete(html: Column, name: Column, language: str = "en") -> Column:
    """Doctype, language and a title by file name, each where it lacks."""
    out = F.when(html.rlike(r"(?i)^\s*<!doctype"), html).otherwise(F.concat(F.lit("<!DOCTYPE html>\n"), html))
    out = F.when(out.rlike(r"(?i)<html\b[^>]*\blang\s*="), out).otherwise(F.regexp_replace(out, r"(?i)<html\b", f'<html lang="{language}"'))
    titled = F.concat(F.regexp_extract(out, r"(?is)^(.*?<head\b[^>]*>)", 1), F.lit("<title>"), escape_html(name), F.lit("</title>"), F.regexp_replace(out, r"(?is)^.*?<head\b[^>]*>", ""))
    return F.when(out.rlike(r"(?i)<title\b") | ~out.rlike(r"(?i)<head\b"), out).otherwise(titled)
