"""Web archives (mail messages of several parts) as rows of parts, with their images' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import data_uri, decode_quoted_printable, encode_base64
from leafmill.operators import images
from leafmill.operators.lookups import decoded


def header(block: Column, name: str) -> Column:
    """Value of the last header of a name, folded lines joined; null if there is none."""
    unfolded = F.regexp_replace(block, r"\r?\n[ \t]+", " ")
    values = F.regexp_extract_all(unfolded, F.lit(rf"(?im)^{name}\s*:[ \t]*([^\r\n]*)"), F.lit(1))
    return F.when(F.size(values) > 0, F.trim(F.element_at(values, -1)))


def parts(messages: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, part, headers, kind, encoding, location, content_id, file_name, body) of each part that is not empty.

    Parts stand between lines of two dashes and the boundary that the head names; the head itself is no part. A part
    without a blank line is all body. body is decoded text for quoted-printable, else as it stands.
    """
    text = F.replace(F.col(raw), F.lit("\r\n"), F.lit("\n"))
    boundary = F.regexp_extract(text, r"(?i)boundary=\"?([^\";\n]+)\"?", 1)
    quoted = F.concat(F.lit(r"\Q--"), boundary, F.lit(r"\E(?:--)?"))
    pieces = F.when(boundary != "", F.split(text, quoted)).otherwise(F.array(text))
    rows = messages.select(key, boundary.alias("_boundary"), F.posexplode(pieces).alias("part", "_piece"))
    rows = rows.withColumn("_piece", F.regexp_replace("_piece", r"^\s+|\s+\z", "")).where("_piece <> '' and not (part = 0 and _boundary <> '')")
    cut = F.instr("_piece", F.lit("\n\n"))
    rows = rows.withColumn("headers", F.when(cut > 0, F.substring("_piece", F.lit(1), cut - 1)).otherwise("")).withColumn("_body", F.when(cut > 0, F.substring("_piece", cut + 2, F.length("_piece"))).otherwise(F.col("_piece")))
    h = F.col("headers")
    encoding = F.lower(F.coalesce(header(h, "content-transfer-encoding"), F.lit("")))
    body = F.when(encoding == "quoted-printable", decode_quoted_printable(F.col("_body"))).otherwise(F.col("_body"))
    return rows.select(
        key, "part", "headers", F.lower(F.trim(F.regexp_extract(F.coalesce(header(h, "content-type"), F.lit("")), r"^([^;]*)", 1))).alias("kind"), encoding.alias("encoding"),
        header(h, "content-location").alias("location"), F.regexp_replace(header(h, "content-id"), "^<|>$", "").alias("content_id"), F.regexp_extract(h, r'(?i)filename="?([^";\n]+)"?', 1).alias("file_name"), body.alias("body"),
    )


def main_page(rows: DataFrame, key: str) -> DataFrame:
    """(key, html): the first HTML part of a message, else its first XHTML part."""
    rank = F.struct(F.when(F.col("kind") == "text/html", 0).otherwise(1), "part")
    pages = rows.where(F.col("kind").isin("text/html", "application/xhtml+xml"))
    html = F.when(F.col("encoding") == "base64", F.decode(F.unbase64("body"), "UTF-8")).otherwise(F.col("body"))
    return pages.groupBy(key).agg(F.min_by(html, rank).alias("html"))


def image_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, "key", uri): the names under which images and fonts are known, the last part of a name winning.

    Names are the location as it stands, without file:, without slashes in front, decoded, without its query, its last
    part, small letters of these; the content id with and without cid:; the file's name, also in small letters.
    """
    media = rows.where(F.col("kind").startswith("image/") | F.col("kind").startswith("font/") | (F.col("kind") == "application/octet-stream"))
    encoded = F.when(F.col("encoding") == "base64", F.col("body")).otherwise(encode_base64(F.col("body").cast("binary")))
    at = F.trim("location")
    last = lambda c: F.trim(F.regexp_extract(c, r"([^/\\]*)\z", 1))
    plain = F.regexp_extract(at, r"^([^?]*)", 1)
    names = F.array(
        at, F.regexp_replace(at, "^file:/+", ""), F.regexp_replace(at, "^/+", ""), decoded(at), last(at), F.lower(at), F.lower(last(at)), plain, last(plain),
        F.col("content_id"), F.concat(F.lit("cid:"), "content_id"), F.col("file_name"), F.lower("file_name"),
    )
    known = media.select(key, "part", data_uri(F.col("kind"), encoded).alias("uri"), F.explode(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))).alias("key"))
    return known.groupBy(key, "key").agg(F.max_by("uri", "part").alias("uri"))


def embedded_pages(messages: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, html, replaced, unmatched): each message's page with its images in place of the references to them (see images.embed)."""
    rows = parts(messages, key, raw)
    return images.embed(main_page(rows, key), key, "html", image_keys(rows, key))
