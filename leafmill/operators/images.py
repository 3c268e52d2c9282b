"""Images put into pages: references of tags are looked up under several keys and written back in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import data_uri, encode_base64, strip
from leafmill.operators import nodes
from leafmill.operators.lookups import decoded, resolve

#: Media types of images by extension. Fixed values.
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp"}
_ATTRS = ("src", "href")


def references(rows: DataFrame, *columns: str) -> DataFrame:
    """(_page, columns, pos, attr, ref): values of src and href of the nodes of pages."""
    values = F.filter(F.array(*[F.struct(F.lit(a).alias("attr"), nodes.get(F.col("attrs"), a).alias("ref")) for a in _ATTRS]), lambda x: F.coalesce(x["ref"], F.lit("")) != "")
    return rows.where(F.col("attrs").isNotNull()).select("_page", *columns, "pos", F.explode(values).alias("x")).select("_page", *columns, "pos", "x.*")


def write_back(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the attributes that found(_page, pos, attr, uri) names set to uri where they stand; counted by step."""
    got = found.where("uri is not null").groupBy("_page", "pos").agg(F.map_from_entries(F.collect_list(F.struct("attr", "uri"))).alias("_uris"))
    rows = rows.join(got, ["_page", "pos"], "left")
    quoted = lambda a: F.concat(a["name"], F.lit('="'), F.replace(F.col("_uris")[a["name"]], F.lit('"'), F.lit("&quot;")), F.lit('"'))
    first = lambda a, i: F.array_position(F.transform("attrs", lambda x: x["name"]), a["name"]) == i + 1
    new = F.transform("attrs", lambda a, i: F.when(F.col("_uris")[a["name"]].isNotNull() & first(a, i), F.struct(a["name"].alias("name"), F.col("_uris")[a["name"]].alias("value"), quoted(a).alias("text"))).otherwise(a))
    has = F.col("_uris").isNotNull()
    return nodes.set_attrs(rows.withColumn("#embedImages.replacements", F.coalesce(F.size("_uris"), F.lit(0))), has, new).drop("_uris")


def embed(pages: DataFrame, doc: str, html: str, keys: DataFrame, samples: int = 5) -> DataFrame:
    """(doc, html, replaced, unmatched): pages(doc, html) with the references known in keys(doc, key, uri) replaced by their uris.

    Each src, then each href, is tried under its candidates, best first. replaced counts them; where none is, unmatched
    has the first samples of the references, those of src first. Null pages are empty; keys of a null doc are not met.
    """
    rows = nodes.nodes(pages.select(F.col(doc).alias("_doc"), html), html)
    found = resolve(references(rows, "_doc"), keys.select(F.col(doc).alias("_doc"), "key", "uri"), "ref", ["_doc"])
    order = F.struct(F.when(F.col("attr") == "src", 0).otherwise(1).alias("a"), "pos", "ref")
    missed = found.groupBy("_page").agg(F.count("uri").alias("replaced"), F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("uri").isNull(), order))), lambda x: x["ref"]), 1, samples).alias("_missed"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", nodes.tag_text().alias("text"))))), lambda t: t["text"]), "")
    made = write_back(rows, found).groupBy("_page").agg(F.first("_doc").alias(doc), text.alias(html)).join(missed, "_page", "left")
    return made.select(doc, html, F.coalesce("replaced", F.lit(0)).alias("replaced"), F.when(F.coalesce("replaced", F.lit(0)) == 0, F.coalesce("_missed", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("unmatched"))


def resolved_path(page: Column, ref: Column) -> Column:
    """The path of a file that a page at a path names: relative to the page's folder, with . and .. taken, signs decoded, without query; null for addresses of other places."""
    plain = F.replace(F.regexp_extract(strip(ref), r"^([^?#]*)", 1), F.lit("\\"), F.lit("/"))
    plain = F.coalesce(decoded(plain), plain)
    own = F.regexp_replace(plain, "^file:/+", "/")
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(page, r"^(.*/)[^/]*\z", 1), own))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", "."), acc).otherwise(F.array_append(acc, p)))
    return F.when((plain != "") & (own.startswith("/") | ~plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")), F.concat(F.lit("/"), F.array_join(parts, "/")))


def from_files(pages: DataFrame, doc: str, path: str, html: str, folder: str) -> DataFrame:
    """(doc, key, uri): images that pages(doc, path, html) name and that are files of a folder, for embed(); missing ones give no row.

    The files of the folder with the extension of an image are read once, whatever the number of pages; their join with
    the names is the planner's.
    """
    refs = references(nodes.nodes(pages.select(doc, path, html), html), doc, path).select(doc, F.col("ref").alias("key"), resolved_path(F.regexp_replace(F.col(path), "^file:/*", "/"), F.col("ref")).alias("_at")).distinct()
    refs = refs.where("_at is not null")
    listed = pages.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join([*TYPES, *map(str.upper, TYPES)]) + "}").load(folder)
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    files = listed.select(F.regexp_replace(F.col("path"), "^file:/*", "/").alias("_file"), "content")
    names = refs.select(F.col("_at").alias("_file")).distinct()
    held = files.join(names, "_file", "left_semi")
    uri = data_uri(kind[F.lower(F.regexp_extract("_file", r"\.([^./]+)\z", 1))], encode_base64(F.col("content")))
    return refs.join(held.select("_file", uri.alias("uri")), F.col("_at") == F.col("_file")).select(doc, "key", "uri")
