"""Queries over the driver tables, each with its equivalent in DuckDB's SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import css, lines, text
from leafmill.operators import lists, lookups, markup, pages, segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# SQL of conditions and inputs that several oracles share
S = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"
_HAS = lambda c, p: f"regexp_matches({c}, '{p}')"
_LINES = "lines AS (SELECT doc_id, i - 1 AS pos, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) t, unnest(range(1, len(parts) + 1)) u(i))"
_LENGTH = "CASE CAST(p_size AS INT) % 5 WHEN 0 THEN p_size || 'px' WHEN 1 THEN p_size || 'pt' WHEN 2 THEN p_size || '.5em' WHEN 3 THEN p_size || '%' ELSE CAST(p_size AS VARCHAR) END"
_PX = r"""(CASE regexp_extract(v, '^(-?\d*\.?\d+)\s*(px|pt|em|rem)?$', 2)
    WHEN 'pt' THEN try_cast(regexp_extract(v, '^(-?\d*\.?\d+)\s*(px|pt|em|rem)?$', 1) AS DOUBLE) * 96.0::DOUBLE / 72.0::DOUBLE
    WHEN 'em' THEN try_cast(regexp_extract(v, '^(-?\d*\.?\d+)\s*(px|pt|em|rem)?$', 1) AS DOUBLE) * 16
    WHEN 'rem' THEN try_cast(regexp_extract(v, '^(-?\d*\.?\d+)\s*(px|pt|em|rem)?$', 1) AS DOUBLE) * 16
    ELSE try_cast(regexp_extract(v, '^(-?\d*\.?\d+)\s*(px|pt|em|rem)?$', 1) AS DOUBLE) END)"""
_TWO = r"(regexp_matches(line, '^[A-Za-z]+\s[A-Za-z]+$') AND NOT regexp_matches(line, '(?i)page'))"
_TITLE = rf"(length(line) BETWEEN 4 AND 80 AND regexp_matches(line, '[A-Za-z]') AND NOT regexp_matches(line, '[^\x20-\x7E]') AND NOT regexp_matches(line, '(?i){lines.INTERNAL}|Calibri') AND NOT {_TWO})"
_SCORE = rf"(CASE WHEN regexp_matches(line, '(?i)page') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(line, '\d') THEN 3 ELSE 0 END + CASE WHEN length(line) BETWEEN 5 AND 50 THEN 2 ELSE 0 END - CASE WHEN {_TWO} THEN 3 ELSE 0 END)"
_LEVEL = r"(CASE WHEN regexp_matches(line, '^#{1,3}\s+.+$') THEN length(regexp_extract(line, '^(#{1,3})', 1)) WHEN regexp_matches(line, '^[A-Z][A-Za-z0-9\s]{2,60}:$') THEN 2 END)"
_CUT = lambda mark: f"list_transform(regexp_split_to_array({_STRIP('line')}, '{mark}'), lambda c: {_STRIP('c')})"
_FULL = lambda mark: f"list_filter({_CUT(mark)}, lambda c: c <> '')"
_KIND = (
    rf"(CASE WHEN contains({_STRIP('line')}, '|') AND len({_FULL(chr(92) + '|')}) >= 2 AND (starts_with({_STRIP('line')}, '|') OR ends_with({_STRIP('line')}, '|') OR len({_CUT(chr(92) + '|')}) >= 3) THEN 'pipe'"
    rf" WHEN regexp_matches({_STRIP('line')}, '\s{{2,}}') AND len({_FULL(r'\s{2,}')}) >= 2 AND len(list_filter({_FULL(r'\s{2,}')}, lambda c: regexp_matches(c, '[A-Za-z0-9]'))) >= 2 THEN 'space' END)"
)
_PREVIEW = r"""coalesce(length(line) BETWEEN 4 AND 180 AND regexp_matches(line, '[A-Za-z0-9]') AND NOT regexp_matches(line, '^<.*>$') AND NOT regexp_matches(line, '(?i)resolutionId|provider=|hash=|localId|PageTitle|PageDateTime')
    AND NOT regexp_matches(line, '(?i)^Calibri(\s|$)') AND NOT (regexp_matches(line, '^[A-Z][a-z]+(\s+[A-Z][a-z]+){1,3}$') AND NOT regexp_matches(line, '(?i)page'))
    AND length(regexp_replace(line, '[^A-Za-z0-9\s,.;:''"!?()\-_/]', '', 'g')) / length(line) >= 0.85
    AND (length(regexp_replace(line, '[^A-Za-z]', '', 'g')) / length(line) >= 0.25 OR regexp_matches(line, '\d{2,}')) AND (regexp_matches(line, '[A-Za-z]{3,}') OR regexp_matches(line, '\d{2,}'))
    AND NOT regexp_matches(line, '[^A-Za-z0-9\s]{3,}') AND NOT regexp_matches(line, '^[A-Z0-9]{3,}[!?]?$')
    AND (regexp_matches(line, '\b\d{1,2}:\d{2}(:\d{2})?\b') OR regexp_matches(line, '\b\d{1,2}\s+[A-Za-z]+\s+\d{4}\b') OR (length(regexp_replace(line, '[^AEIOUaeiou]', '', 'g')) >= 2 AND (regexp_matches(line, '\s') OR length(line) <= 16))), false)"""


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


# ---- names, routing, encodings


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'onepkg' WHEN page_id % 7 = 1 THEN 'one' WHEN page_id % 7 IN (2, 5) THEN 'mht' WHEN page_id % 7 IN (3, 6) THEN 'html' ELSE 'unknown' END AS kind,
    page_id % 7 NOT IN (4, 5, 6) AS accepted FROM pages""")
def source_kind_routing(spark, d):
    k = F.col("page_id") % 7
    name = F.concat(F.col("url"), F.when(k == 0, ".ONEPKG").when(k == 1, ".one").when(k == 2, ".mhtml").when(k == 3, ".HTM").otherwise(".bin"))
    mime = F.when(k == 5, "Multipart/Related; x=y").when(k == 6, "TEXT/HTML")
    return table(spark, d, "pages").select("page_id", text.source_kind(name, mime).alias("kind"), text.accepted(name, mime).alias("accepted"))


@query(rf"""SELECT p_partkey, regexp_replace(regexp_replace(' ' || p_name || ' : a/b?' || chr(9) || chr(160) || 'x.doc', '[<>:"/\\|?*\x00-\x1F]', '_', 'g').replace(chr(160), ' '), ' +', ' ', 'g').trim() AS folder,
    regexp_replace(trim(' ' || p_name || '.one'), '\.[^./\\]+$', '') AS base FROM part""")
def folder_safe_names(spark, d):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" : a/b?\t x.doc"))
    return table(spark, d, "part").select("p_partkey", text.folder_safe(raw).alias("folder"), text.base_name(F.concat(F.lit(" "), "p_name", F.lit(".one"))).alias("base"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM documents""")
def escape_html(spark, d):
    return table(spark, d, "documents").select("doc_id", text.escape_html(F.col("text")).alias("escaped"))


@query("""SELECT doc_id, replace(text, 'e ', 'e  ') AS plain FROM documents""")
def nbsp_normalize(spark, d):
    marked = F.replace("text", F.lit("e "), F.lit("e &NBSP;"))
    return table(spark, d, "documents").select("doc_id", text.plain_spaces(marked).alias("plain"))


@query("""SELECT c_custkey, c_name || ' é=+%' AS decoded FROM customer""")
def qp_decode(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.decode_quoted_printable(F.concat(F.lit("=\r\n"), "c_name", F.lit("=20=C3=A9=3D=\n+%"))).alias("decoded"))


@query("""SELECT p_partkey, 'data:image/png;base64,' || base64(encode(p_name)) AS uri FROM part""")
def data_uri(spark, d):
    raw = F.regexp_replace(text.encode_base64(F.col("p_name").cast("binary")), "=", "")
    return table(spark, d, "part").select("p_partkey", text.data_uri(F.lit("image/png"), F.concat(F.substring(raw, 1, 3), F.lit(" \r\n"), F.substring(raw, 4, 9999))).alias("uri"))


# ---- styles


def _lengths(spark, d):
    k, s = F.col("p_size") % 5, F.col("p_size").cast("string")
    v = F.when(k == 0, F.concat(s, F.lit("px"))).when(k == 1, F.concat(s, F.lit("pt"))).when(k == 2, F.concat(s, F.lit(".5em"))).when(k == 3, F.concat(s, F.lit("%"))).otherwise(s)
    return table(spark, d, "part").select("p_partkey", v.alias("v"), "p_size")


@query(f"SELECT p_partkey, round({_PX}, 6) AS px FROM (SELECT p_partkey, {_LENGTH} AS v FROM part)")
def css_px(spark, d):
    return _lengths(spark, d).select("p_partkey", F.round(css.px(F.col("v")), 6).alias("px"))


@query(f"SELECT p_partkey, CASE WHEN px IS NULL THEN NULL WHEN px <= 12 THEN 'text-xs' WHEN px <= 14 THEN 'text-sm' WHEN px <= 17 THEN 'text-base' WHEN px <= 20 THEN 'text-lg' ELSE 'text-xl' END AS class FROM (SELECT p_partkey, {_PX} AS px FROM (SELECT p_partkey, {_LENGTH} AS v FROM part))")
def font_size_bucket(spark, d):
    return _lengths(spark, d).select("p_partkey", css.font_size(F.col("v")).alias("class"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'font-bold' WHEN p_size % 7 = 1 THEN 'font-normal' WHEN p_size % 7 = 2 THEN NULL WHEN p_size * 20 <= 450 THEN 'font-normal' WHEN p_size * 20 <= 550 THEN 'font-medium' WHEN p_size * 20 <= 650 THEN 'font-semibold' ELSE 'font-bold' END AS class FROM part")
def font_weight_bucket(spark, d):
    k = F.col("p_size") % 7
    v = F.when(k == 0, " Bold").when(k == 1, "normal").when(k == 2, "bolder").otherwise(F.concat((F.col("p_size") * 20).cast("string"), F.lit("abc")))
    return _lengths(spark, d).select("p_partkey", css.font_weight(v).alias("class"))


@query(f"SELECT p_partkey, 'mt-' || CASE WHEN px IS NULL THEN NULL WHEN px <= 0 THEN '0' WHEN px <= 4 THEN '1' WHEN px <= 8 THEN '2' WHEN px <= 12 THEN '3' WHEN px <= 16 THEN '4' ELSE '6' END AS class FROM (SELECT p_partkey, {_PX} AS px FROM (SELECT p_partkey, {_LENGTH} AS v FROM part))")
def margin_bucket(spark, d):
    return _lengths(spark, d).select("p_partkey", css.margin("mt", F.col("v")).alias("class"))


def _styles(spark, d):
    s = F.concat(F.lit("Color : red;; margin-left:"), F.col("p_size").cast("string"), F.lit("px; broken; mso-list :l0;width: 3"))
    return table(spark, d, "part").select("p_partkey", "p_size", css.declarations(s).alias("s"))


@query("SELECT p_partkey, 'color: red; width: 3' AS style FROM part")
def style_strip(spark, d):
    return _styles(spark, d).select("p_partkey", css.style_text(css.remove_keys(F.col("s"))).alias("style"))


@query("SELECT p_partkey, 'margin-left: ' || p_size || 'px; mso-list: l0; width: 3; color: blue' AS style FROM part")
def style_upsert(spark, d):
    return _styles(spark, d).select("p_partkey", css.style_text(css.upsert(F.col("s"), "color", "blue")).alias("style"))


@query("SELECT p_partkey, p_size >= 24 AS excess FROM part")
def excess_indent(spark, d):
    return _styles(spark, d).select("p_partkey", css.excess_indent(css.remove_keys(F.col("s"), ("mso-list",))).alias("excess"))


# ---- lists

_ITEMS = "items AS (SELECT *, CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN CAST(l_quantity AS INT) END AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM lineitem)"
_BY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _items(spark, d):
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", *_BY, F.when(q % 7 == 0, q).alias("v"))


@query(f"""WITH {_ITEMS}, m AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS last, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS pos FROM items WINDOW w AS (PARTITION BY l_orderkey ORDER BY rn ROWS UNBOUNDED PRECEDING))
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(last, 0) + rn - coalesce(pos, 0) AS BIGINT) AS number FROM m""")
def list_renumber(spark, d):
    return lists.renumber(_items(spark, d), ["l_orderkey"], _BY, "v").select("l_orderkey", "l_linenumber", "l_partkey", F.col("number").cast("long").alias("number"))


@query(f"""WITH {_ITEMS} SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN min(1 + l_orderkey % 2) OVER (PARTITION BY l_orderkey) = 1 AND max(1 + l_orderkey % 2) OVER (PARTITION BY l_orderkey) = 1 AND count(*) OVER (PARTITION BY l_orderkey) > 1 THEN rn ELSE 1 + l_orderkey % 2 END AS BIGINT) AS number FROM items""")
def list_renumber_all_ones(spark, d):
    out = _items(spark, d).withColumn("v", 1 + F.col("l_orderkey") % 2)
    return lists.renumber_all_ones(out, ["l_orderkey"], _BY, "v").select("l_orderkey", "l_linenumber", "l_partkey", F.col("number").cast("long").alias("number"))


@query("SELECT l_returnflag, count(*) AS kept FROM lineitem WHERE NOT (l_linestatus = 'O' AND CAST(l_quantity AS INT) % 3 = 0 AND CAST(l_quantity AS INT) % 5 <> 0) GROUP BY 1")
def remove_empty_items(spark, d):
    q = F.col("l_quantity").cast("int")
    keep = lists.keep_item(F.col("l_linestatus") == "O", F.when(q % 3 == 0, "  ").otherwise("x"), F.when(q % 5 == 0, "3").otherwise(" "), F.lit(False))
    return table(spark, d, "lineitem").where(keep).groupBy("l_returnflag").agg(F.count("*").alias("kept"))


# ---- lines


@query(rf"""WITH {_LINES} SELECT doc_id, pos, {_TITLE} AS title, CAST({_SCORE} AS BIGINT) AS score FROM lines""")
def title_scoring(spark, d):
    v = F.col("line")
    return doc_lines(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), lines.is_title(v).alias("title"), lines.title_score(v).cast("long").alias("score"))


@query(rf"""WITH {_LINES}, r AS (SELECT doc_id, 2 * pos AS pos, line FROM lines UNION ALL SELECT doc_id, 2 * pos + 1, 'PageTitle' FROM lines),
    b AS (SELECT *, max(CASE WHEN {_TITLE} THEN {{'s': {_SCORE}, 'i': pos, 'v': line}} END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS best FROM r),
    f AS (SELECT doc_id, pos, best.i AS title_at, best.v AS title FROM b WHERE line = 'PageTitle' AND best.s > 0)
    SELECT doc_id, pos AS marker_at, title_at, title FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, title ORDER BY pos) = 1""")
def best_title_window(spark, d):
    both = F.array(F.struct((2 * F.col("pos")).cast("long").alias("pos"), F.col("line")), F.struct((2 * F.col("pos") + 1).cast("long").alias("pos"), F.lit("PageTitle").alias("line")))
    r = doc_lines(spark, d).select("doc_id", F.explode(both).alias("r")).select("doc_id", "r.*")
    return segments.best_titles(r, "doc_id", "pos", "line")


_OFFSETS = f"{_LINES}, o AS (SELECT doc_id, pos, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines)"
_SEGMENTS = f"""seg AS (SELECT o.doc_id, pos, greatest(coalesce(lag(start) OVER w, 0), start - 512) AS seg_start, coalesce(lead(start) OVER w, length(text)) AS nxt, length(text) AS size FROM o JOIN documents d ON o.doc_id = d.doc_id WHERE {_TITLE} WINDOW w AS (PARTITION BY o.doc_id ORDER BY start)),
    s AS (SELECT doc_id, pos, seg_start, least(size, greatest(seg_start + 1, nxt + 256)) AS seg_end FROM seg)"""


def _offsets(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("size"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return out.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_OFFSETS}, {_SEGMENTS} SELECT doc_id, pos, seg_start, seg_end FROM s")
def page_segments(spark, d):
    return segments.page_segments(_offsets(spark, d).where(lines.is_title(F.col("line"))), "doc_id", "start", "size").select("doc_id", "pos", "seg_start", "seg_end")


@query(f"WITH {_OFFSETS}, {_SEGMENTS} SELECT s.doc_id, s.pos, count(*) AS n, CAST(sum(o.pos) AS BIGINT) AS places FROM s JOIN o ON s.doc_id = o.doc_id AND o.start + length(o.line) >= seg_start AND o.start <= seg_end GROUP BY 1, 2")
def segment_line_join(spark, d):
    rows = _offsets(spark, d)
    seg = segments.page_segments(rows.where(lines.is_title(F.col("line"))), "doc_id", "start", "size").select("doc_id", "pos", "seg_start", "seg_end")
    rec = rows.select("doc_id", F.col("pos").alias("rec"), F.col("start").alias("rec_start"), (F.col("start") + F.length("line")).alias("rec_end"))
    return segments.lines_in_segments(seg, rec, "doc_id").groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.sum("rec").alias("places"))


@query(f"WITH {_LINES} SELECT doc_id, pos FROM lines WHERE {_PREVIEW}")
def preview_line_filter(spark, d):
    return doc_lines(spark, d).where(lines.is_preview(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_LINES} SELECT doc_id, pos, {_KIND} AS delimiter, CAST(to_json(CASE {_KIND} WHEN 'pipe' THEN {_FULL(chr(92) + '|')} ELSE {_FULL(chr(92) + 's{2,}')} END) AS VARCHAR) AS cells FROM lines WHERE {_KIND} IS NOT NULL")
def table_split(spark, d):
    return doc_lines(spark, d).withColumn("v", text.strip(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"), lines.cells(F.col("v"), True).alias("c")).where("c is not null").select("doc_id", "pos", F.col("c.delimiter").alias("delimiter"), F.to_json("c.cells").alias("cells"))


@query(f"WITH {_LINES}, h AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN '## ' || line WHEN pos = 1 THEN 'Label 1:' ELSE line END AS line FROM lines) SELECT doc_id, pos, CAST({_LEVEL} AS INT) AS level FROM h WHERE {_LEVEL} IS NOT NULL")
def heading_detect(spark, d):
    v = F.when(F.col("pos") == 0, F.concat(F.lit("## "), "line")).when(F.col("pos") == 1, "Label 1:").otherwise(F.col("line"))
    return doc_lines(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), lines.heading_level(v).cast("int").alias("level")).where("level is not null")


@query(f"WITH {_LINES}, f AS (SELECT doc_id, line, min(pos) AS pos FROM lines GROUP BY 1, 2) SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM f QUALIFY rank <= 24")
def ordered_unique_lines(spark, d):
    out = segments.first_distinct(doc_lines(spark, d).withColumn("pos", F.col("pos").cast("long")), ["doc_id"], "pos", "line", 24)
    return out.select("doc_id", "pos", "line", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_LINES}, u AS (SELECT doc_id, line, min((pos % 2) * 1000000 + pos) AS k FROM lines WHERE line <> '' GROUP BY 1, 2) SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rank FROM u QUALIFY rank <= 8")
def merge_unique(spark, d):
    all_ = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("a"))
    part = lambda odd: F.filter(F.transform("a", lambda x, i: F.when((i % 2 == odd) & (x != ""), x)), lambda x: x.isNotNull())
    out = all_.select("doc_id", F.posexplode(F.slice(F.array_union(part(0), part(1)), 1, 8)).alias("rank", "line"))
    return out.select("doc_id", "line", (F.col("rank") + 1).cast("long").alias("rank"))


_BLOCK = lambda c: rf"(regexp_matches({c}, '^([-*•]|\d+[\.)]|[A-Za-z][\.)])\s+') OR {_LEVEL.replace('line', c)} IS NOT NULL OR {_KIND.replace('line', c)} IS NOT NULL)"


@query(f"""WITH {_LINES}, v AS (SELECT doc_id, pos, {_STRIP('line')} AS n, lag({_STRIP('line')}) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM lines),
    f AS (SELECT doc_id, pos, CASE WHEN p <> '' AND n <> '' AND NOT {_BLOCK('n')} AND NOT (regexp_matches(p, '[.!?;:]$') AND regexp_matches(n, '^[A-Z][A-Za-z0-9]')) THEN 0 ELSE 1 END AS new FROM v)
    SELECT doc_id, pos, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS paragraph FROM f""")
def paragraph_fold(spark, d):
    rows = doc_lines(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), text.strip(F.col("line")).alias("line"))
    return segments.paragraphs(rows, "doc_id", "pos", "line").select("doc_id", "pos", "paragraph")


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, pos, CASE WHEN {_STRIP('line')} = '' THEN 'blank' WHEN {_KIND} IS NOT NULL THEN 'table' WHEN regexp_matches({_STRIP('line')}, '^[-*•]\\s+') THEN 'ul' WHEN regexp_matches({_STRIP('line')}, '^(\\d+[\\.)]|[A-Za-z][\\.)])\\s+') THEN 'ol'
    WHEN regexp_matches({_STRIP('line')}, '^#{{1,3}}\\s+.+$') OR regexp_matches({_STRIP('line')}, '^[A-Z][A-Za-z0-9\\s]{{2,60}}:$') THEN 'heading' ELSE 'paragraph' END AS kind FROM lines),
    n AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) = kind THEN 0 ELSE 1 END AS new FROM k), i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n)
    SELECT doc_id, island, kind, min(pos) AS first_at, max(pos) AS last_at, count(*) AS n FROM i GROUP BY 1, 2, 3""")
def line_class_islands(spark, d):
    rows = doc_lines(spark, d).withColumn("v", text.strip(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"), lines.line_class(F.col("v"), True).alias("kind"))
    return segments.islands(rows, "doc_id", "pos", "kind")


# ---- dates, metadata


@query("""SELECT o_orderkey, o_orderkey % 4 IN (0, 1, 2) AS is_date, o_orderkey % 4 = 3 AS is_time FROM orders""")
def date_time_predicates(spark, d):
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, F.date_format("o_orderdate", "d MMMM yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "M/d/yy")).otherwise(F.lit(" 9:05 PM"))
    return table(spark, d, "orders").select("o_orderkey", lines.is_date(v).alias("is_date"), lines.is_time(v).alias("is_time"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 = 0 AS d, lead(o_orderkey) OVER w AS nxt, lead(o_orderkey % 3 = 1) OVER w AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, o_orderkey AS date_at, nxt AS time_at FROM p WHERE d AND t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def date_time_merge(spark, d):
    k = F.col("o_orderkey") % 3
    p = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k == 0, "3 May 2024").when(k == 1, "10:30").otherwise("text").alias("t"))
    return segments.merge_dates_and_times(p, "o_custkey", "o_orderkey", "t").select("o_custkey", "date_at", "time_at")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'author' WHEN 2 THEN 'createdAt' WHEN 3 THEN 'modifiedAt' WHEN 4 THEN 'createdAt' END AS key FROM orders""")
def metadata_keys(spark, d):
    labels = F.array(*map(F.lit, ["Page_Title", " created-by", "Date  Created", "LAST saved", "created with care", "status"]))
    return table(spark, d, "orders").select("o_orderkey", lines.metadata_key(F.element_at(labels, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("key"))


@query("""SELECT o_custkey, 'title' AS key, arg_min(o_orderkey || 'v', {'p': -CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END, 'i': o_orderkey}) AS value, count(DISTINCT o_orderkey) AS n_values FROM orders GROUP BY 1""")
def metadata_resolve(spark, d):
    k = F.col("o_orderkey") % 3
    v = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit("title").alias("key"), F.when(k == 0, "line-key-value").when(k == 1, "hint").otherwise("line-heuristic").alias("source"), F.concat(F.col("o_orderkey").cast("string"), F.lit("v")).alias("value"))
    return lookups.resolve_metadata(v, "o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'soon' END AS iso FROM orders""")
def metadata_dates(spark, d):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, F.date_format("o_orderdate", "d MMM yyyy")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", lines.metadata_date(v).alias("iso"))


# ---- links, hierarchy, headers, counts


@query(r"""SELECT page_id, i - 1 AS pos, l[i] AS link FROM (SELECT page_id, regexp_extract_all(html, '(?i)\b(?:src|href)="([^"]*)"', 1) AS l FROM pages) t, unnest(range(1, len(l) + 1)) u(i)""")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(markup.links(F.col("html"))).alias("pos", "link")).withColumn("pos", F.col("pos").cast("long"))


@query(r"""WITH r AS (SELECT page_id, i - 1 AS pos, l[i] AS link FROM (SELECT page_id, regexp_extract_all(html, '(?i)\b(?:src|href)="([^"]*)"', 1) AS l FROM pages) t, unnest(range(1, len(l) + 1)) u(i)),
    k AS (SELECT DISTINCT page_id, lower(regexp_extract(link, '([^/\\]*)$', 1)) AS base FROM r WHERE regexp_extract(link, '([^/\\]*)$', 1) LIKE '%.%')
    SELECT r.page_id, r.pos, r.link, CASE WHEN k.base IS NOT NULL AND k.base <> '' THEN 'data:' || k.base END AS uri FROM r LEFT JOIN k ON r.page_id = k.page_id AND lower(regexp_extract(link, '([^/\\]*)$', 1)) = k.base""")
def image_lookup(spark, d):
    refs = page_links(spark, d)
    base = F.lower(F.regexp_extract("link", r"([^/\\]*)\z", 1))
    keys = refs.select("page_id", base.alias("key")).where("key like '%.%'").distinct().withColumn("uri", F.concat(F.lit("data:"), "key"))
    return lookups.resolve(refs, keys, "link", ["page_id"]).select("page_id", "pos", "link", "uri")


@query("""WITH l AS (SELECT r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT DISTINCT r_name AS path, CAST(NULL AS VARCHAR) AS parent_path, r_name AS name, 1 AS depth, false AS leaf FROM l UNION ALL SELECT DISTINCT r_name || '/' || n_name, r_name, n_name, 2, false FROM l UNION ALL SELECT DISTINCT r_name || '/' || n_name || '/' || s_name, r_name || '/' || n_name, s_name, 3, true FROM l""")
def hierarchy_nodes(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lookups.hierarchy(s.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("p")), "p")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, count(*) AS n, min(CASE WHEN l_linenumber % 4 = 0 THEN l_linenumber END) AS c, min(CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber END) AS o FROM c GROUP BY 1)
    SELECT l_orderkey, coalesce(c, 0) AS cue_at, coalesce(o, 1) AS notes_at, c IS NOT NULL OR o IS NOT NULL AS named FROM t WHERE n >= 2 AND coalesce(c, 0) <> coalesce(o, 1)""")
def cornell_headers(spark, d):
    n = F.col("l_linenumber")
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("t", F.concat(F.when(n % 4 == 0, "My Cues ").otherwise(""), F.when(n % 3 == 0, "a NOTE").otherwise("footnotes")))
    return lookups.header_columns(c, "l_orderkey", "l_linenumber", "t")


@query("""SELECT CASE l_linenumber & 15 WHEN 0 THEN 'none' WHEN 1 THEN 'mszip' WHEN 2 THEN 'quantum' WHEN 3 THEN 'lzx' ELSE 'unknown' END AS kind, count(*) AS folders, count(*) FILTER (l_returnflag = 'N') AS decoded FROM lineitem GROUP BY 1""")
def folder_summary(spark, d):
    return table(spark, d, "lineitem").groupBy(lookups.compression_kind(F.col("l_linenumber")).alias("kind")).agg(F.count("*").alias("folders"), F.count_if(F.col("l_returnflag") == "N").alias("decoded"))


@query("""SELECT event_type AS code, CASE WHEN user_id % 3 = 0 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n, count(DISTINCT user_id) AS jobs FROM events GROUP BY 1, 2""")
def warning_rollup(spark, d):
    severity = F.when(F.col("user_id") % 3 == 0, "warning").otherwise("info")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("code"), severity.alias("severity")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("jobs"))


@query(r"""SELECT page_id, regexp_replace(html, '>\s*<', '>' || chr(10) || '<', 'g') AS html FROM pages""")
def legacy_linebreaks(spark, d):
    return table(spark, d, "pages").select("page_id", markup.break_lines(F.col("html")).alias("html"))


@query(r"""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    from leafmill.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- pages


@query("""SELECT 'EnsureViewport' AS step, count(*) AS pages, CAST(count(*) AS BIGINT) AS total FROM pages UNION ALL SELECT 'InjectCss', count(*), CAST(count(*) AS BIGINT) FROM pages""")
def log_rollup(spark, d):
    return pages.log_rollup(pages.clean_head(table(spark, d, "pages").select("page_id", "html"), "html"))


@query("""SELECT page_id, replace(html, '</head>', '<meta name="viewport" content="width=device-width, initial-scale=1.0"><link rel="stylesheet" href="assets/tailwind-output.css"></head>') AS output FROM pages""")
def clean_page_heads(spark, d):
    return pages.clean_head(table(spark, d, "pages").select("page_id", "html"), "html").select("page_id", "output")


@query("""SELECT p_partkey, i AS part, CASE i WHEN 1 THEN 'text/html' ELSE 'image/png' END AS kind, CASE i WHEN 1 THEN '<p>' || p_name || ' é</p>' ELSE base64(encode(p_name)) END AS body FROM part, range(1, 3) r(i)""")
def mail_parts(spark, d):
    from leafmill.sources import mail

    head = F.lit("MIME-Version: 1.0\nContent-Type: multipart/related;\n boundary=\"q+1\"\n\npreamble\n\n--q+1\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n<p>")
    raw = F.concat(head, "p_name", F.lit("=\n =C3=A9</p>\n--q+1\nContent-Transfer-Encoding: base64\nContent-Type: image/png\n\n"), text.encode_base64(F.col("p_name").cast("binary")), F.lit("\n--q+1--\n"))
    rows = mail.parts(table(spark, d, "part").withColumn("raw", raw), "p_partkey", "raw")
    return rows.select("p_partkey", F.col("part").cast("long").alias("part"), "kind", "body")


@query("""SELECT doc_id, 'wide' AS encoding, count(*) AS n, CAST(sum(2 * length(w)) AS BIGINT) AS bytes FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^a-zA-Z]', ' ', 'g'), '[a-zA-Z]{4,}')) AS w FROM documents) GROUP BY 1""")
def section_strings(spark, d):
    from leafmill.sources import binary

    words = F.regexp_replace("text", "[^a-zA-Z]", "\u0001")
    df = table(spark, d, "documents").select("doc_id", F.encode(words, "UTF-16LE").alias("content"))
    found = binary.section_strings(df, "doc_id", "content").where("encoding = 'wide'")
    return found.groupBy("doc_id", "encoding").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


_CLOCKED, _DATED = r"\b\d{1,2}:\d{2}(:\d{2})?\b", r"\b\d{1,2}\s+[A-Za-z]+\s+\d{4}\b"
_BINARY = "(" + " OR ".join(_HAS("v", p) for p in (r"(?i)\b(IDAT|IHDR|JFIF|Exif|PK\x03\x04|%PDF|obj|endobj)\b", "^[A-Za-z0-9+/=_-]{10,}$", r"[^A-Za-z0-9\s,.;:''\"!?()\-_/]{2,}")) + ")"
_POINT = lambda test, n: f"CASE WHEN {test} THEN {n} ELSE 0 END"
_SCORE = " + ".join([_POINT("len(regexp_extract_all(v, '[A-Za-z]{3,}')) >= 2", 2), _POINT(_HAS("v", _CLOCKED), 1), _POINT(_HAS("v", _DATED), 1), _POINT(_HAS("v", r"\s"), 1), _POINT(_HAS("v", "^[A-Z0-9]{3,}[!?]?$"), -2), _POINT(_BINARY, -3)])
_TOLD = "CASE (doc_id + pos) % 6 WHEN 0 THEN line || ' at 10:15' WHEN 1 THEN line || ' on 3 March ' || (2000 + doc_id % 30) WHEN 2 THEN line || ' IHDR' WHEN 3 THEN 'LOUD' || doc_id WHEN 4 THEN '| ' || doc_id || ' | --- |' ELSE line END"


@query(f"WITH {_LINES}, told AS (SELECT doc_id, pos, {_STRIP(_TOLD)} AS v FROM lines) SELECT doc_id, pos, {_BINARY} AS binary_like, CAST(CASE WHEN {_BLOCK('v')} THEN 4 ELSE {_SCORE} END AS INT) AS score FROM told WHERE v <> ''")
def line_scores(spark, d):
    """Scores of all lines, to which times, dates, marks of binary content, loud words and table rows are added by turns."""
    line, k = F.col("line"), (F.col("doc_id") + F.col("pos")) % 6
    told = F.when(k == 0, F.concat(line, F.lit(" at 10:15"))).when(k == 1, F.concat(line, F.lit(" on 3 March "), 2000 + F.col("doc_id") % 30)).when(k == 2, F.concat(line, F.lit(" IHDR")))
    told = told.when(k == 3, F.concat(F.lit("LOUD"), "doc_id")).when(k == 4, F.concat(F.lit("| "), "doc_id", F.lit(" | --- |"))).otherwise(line)
    rows = doc_lines(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), text.strip(told).alias("v")).where("v <> ''")
    return rows.select("doc_id", "pos", lines.looks_binary(F.col("v")).alias("binary_like"), lines.line_score(F.col("v")).cast("int").alias("score"))
