"""Text, name and encoding functions over columns; all stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts of web pages know it; Spark's own \s and trim cover less. Fixed value.
SPACE = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The characters of SPACE. Fixed value.
SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Names that are safe as they are: plain characters, single spaces between them.
_SAFE = r"^[0-9A-Za-z#&@!%+=~$_.,;'()\[\]{}-]++(?: [0-9A-Za-z#&@!%+=~$_.,;'()\[\]{}-]++)*+\z"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def plain_spaces(html: Column) -> Column:
    """No-break spaces, as characters or entities, become spaces; all other spacing stays."""
    return F.regexp_replace(html, r"(?i)&nbsp;|\x{00A0}", " ")


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def source_kind(name: Column, mime: Column) -> Column:
    """Kind of a file by extension, then media type."""
    n, m = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(n.endswith(".onepkg"), "onepkg")
        .when(n.endswith(".one"), "one")
        .when(n.endswith(".mht") | n.endswith(".mhtml") | m.contains("multipart/related"), "mht")
        .when(n.endswith(".html") | n.endswith(".htm") | (m == "text/html"), "html")
        .otherwise("unknown")
    )


def accepted(name: Column, mime: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    ext = F.lit(False)
    for e in (".html", ".htm", ".mht", ".mhtml", ".one", ".onepkg"):
        ext = ext | n.endswith(e)
    return ext | F.coalesce(mime, F.lit("")).isin("text/html", "message/rfc822", "application/octet-stream")


def base_name(name: Column) -> Column:
    out = F.regexp_replace(strip(F.when(F.coalesce(name, F.lit("")) == "", "input").otherwise(name)), r"\.[^./\\]+\z", "")
    return F.when(out == "", "input").otherwise(out)


def folder_safe(name: Column) -> Column:
    out = collapse(F.regexp_replace(F.coalesce(name, F.lit("item")), r'[<>:"/\\|?*\x00-\x1F]', "_"))
    return F.when(name.rlike(_SAFE), name).when(out == "", "item").otherwise(out)


def entry_path(path: Column) -> Column:
    """Slashes forward, none doubled or at the ends."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.contains("//") | p.startswith("/") | p.endswith("/"), F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"^/|/\z", "")).otherwise(p)


def decode_quoted_printable(c: Column) -> Column:
    """Soft breaks go, =HH are bytes of UTF-8; other characters stay."""
    c = F.regexp_replace(c, r"=\r?\n", "")
    c = F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(F.regexp_replace(c, "=([0-9A-Fa-f]{2})", "%$1"))


def pad_base64(c: Column) -> Column:
    c = F.regexp_replace(c, f"{SPACE}+", "")
    return F.concat(c, F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4))))


def data_uri(kind: Column, base64: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), pad_base64(base64))


def encode_base64(binary: Column) -> Column:
    return F.regexp_replace(F.base64(binary), r"[\r\n]", "")


def cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def output_name(name: Column, kind: Column) -> Column:
    return F.concat(base_name(name), F.when(kind.isin("one", "onepkg"), "_converted.zip").otherwise("_cleaned.html"))
