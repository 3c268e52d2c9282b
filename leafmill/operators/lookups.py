"""Lookups by several keys, metadata resolution, hierarchies and headers, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.lines import metadata_priority
from leafmill.functions.text import strip


def decoded(c: Column) -> Column:
    """The text that percent signs encode; null where they encode none."""
    out = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(~F.contains(F.coalesce(out, F.lit("\ufffd")), F.lit("\ufffd")) | F.contains(c, F.lit("\ufffd")), out)


def candidates(ref: Column) -> Column:
    """Keys under which a reference may be known, best first."""
    raw = strip(ref)
    base = F.regexp_extract(raw, r"([^/\\]*)\z", 1)
    cid = raw.rlike("(?i)^cid:")
    keys = F.array(
        raw, decoded(raw), F.regexp_replace(raw, "^file:/+", ""), F.regexp_replace(raw, "^/+", ""), F.regexp_extract(raw, r"^([^?#]*)", 1),
        base, F.lower(base), F.lower(raw), F.when(~cid & (base != ""), F.concat(F.lit("cid:"), base)), F.when(~cid, F.regexp_replace(F.regexp_replace(base, "^<", ""), r">\z", "")),
    )
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def resolve(refs: DataFrame, keys: DataFrame, ref: str, by: list[str]) -> DataFrame:
    """Adds uri to refs: that of the first candidate of ref in keys(*by, key, uri); null where none is.

    Keys are few for a document but many for a corpus, so the join is left to the planner. Null refs find nothing.
    """
    tried = refs.select(*by, ref).distinct().select(*by, ref, F.posexplode(candidates(F.col(ref))).alias("_pos", "key"))
    hits = tried.join(keys, [*by, "key"]).groupBy(*by, ref).agg(F.min_by("uri", "_pos").alias("uri"))
    return refs.join(hits, [*by, ref], "left").select(*refs.columns, "uri")


def resolve_metadata(values: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, key, value, n_values): of values(doc, order, key, source, value) the one of highest priority, then first."""
    rank = F.struct(-metadata_priority(F.col("key"), F.col("source")), F.col(order))
    return values.groupBy(doc, "key").agg(F.min_by("value", rank).alias("value"), F.count_distinct("value").alias("n_values"))


def hierarchy(paths: DataFrame, path: str) -> DataFrame:
    """(path, parent_path, name, depth, leaf): every node of slash-parted paths, once."""
    parts = paths.select(F.filter(F.split(path, "/"), lambda p: p != "").alias("_p")).where("size(_p) > 0")
    nodes = parts.select("_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    at = F.array_join(F.slice("_p", 1, F.col("depth")), "/")
    up = F.when(F.col("depth") > 1, F.array_join(F.slice("_p", 1, F.col("depth") - 1), "/"))
    out = nodes.select(at.alias("path"), up.alias("parent_path"), F.element_at("_p", F.col("depth")).alias("name"), "depth", (F.col("depth") == F.size("_p")).alias("leaf"))
    return out.groupBy("path", "parent_path", "name", "depth").agg(F.max("leaf").alias("leaf"))


def header_columns(cells: DataFrame, table: str, column: str, text: str, fallback: bool = True) -> DataFrame:
    """(table, cue_at, notes_at, named): columns of cues and notes from the cells of a table's first row.

    Rows of one cell, and tables where both fall on one column, give none; without fallback nor do unnamed ones.
    """
    cue, note = F.lower(F.col(text)).rlike(r"\bcue(s)?\b"), F.lower(F.col(text)).rlike(r"\bnote(s)?\b")
    out = cells.groupBy(table).agg(F.count("*").alias("_n"), F.min(F.when(cue, F.col(column))).alias("_cue"), F.min(F.when(note, F.col(column))).alias("_note"))
    out = out.select(table, "_n", F.coalesce("_cue", F.lit(0)).alias("cue_at"), F.coalesce("_note", F.lit(1)).alias("notes_at"), (F.col("_cue").isNotNull() | F.col("_note").isNotNull()).alias("named"))
    out = out.where("_n >= 2 and cue_at <> notes_at").drop("_n")
    return out if fallback else out.where("named")


def compression_kind(code: Column) -> Column:
    low = code.bitwiseAND(15)
    return F.when(low == 0, "none").when(low == 1, "mszip").when(low == 2, "quantum").when(low == 3, "lzx").otherwise("unknown")
