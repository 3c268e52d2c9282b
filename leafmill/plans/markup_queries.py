"""Queries over markup, each with its equivalent in DuckDB's SQL: inputs are made from the driver tables' columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import legacy
from leafmill.operators import blocks, nodes, pages, tree
from leafmill.operators.staging import dealt
from leafmill.plans.catalogue import _KIND, _LEVEL, _LINES, _STRIP, doc_lines, query, table
from leafmill.plans.cleaning import clean_pages, profile


def _made(df, doc, html):
    return nodes.nodes(df.select(doc, html.alias("html")), "html")


def _joined(df, doc, order, piece):
    return df.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece.alias("piece")))), lambda t: t["piece"]), "").alias("pieces"))


@query("SELECT page_id, html FROM pages")
def html_round_trip(spark, d):
    return nodes.serialise(nodes.nodes(table(spark, d, "pages").select("page_id", "html"), "html"), "page_id")


@query(r"""SELECT page_id, count(*) AS tokens, count(*) FILTER (t[1] <> '<') AS texts, count(*) FILTER (regexp_matches(t, '^</[A-Za-z]')) AS ends, count(*) FILTER (regexp_matches(lower(t), '^<p[\s>]')) AS paragraphs
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<!.*?>|</?[A-Za-z][^>]*>|[^<]+|<')) AS t FROM pages) GROUP BY 1""")
def html_tokens(spark, d):
    rows = nodes.nodes(table(spark, d, "pages").select("page_id", "html"), "html")
    return rows.groupBy("page_id").agg(F.count("*").alias("tokens"), F.count_if(~F.col("raw").startswith("<")).alias("texts"), F.count_if(F.col("raw").rlike("^</[A-Za-z]")).alias("ends"), F.count_if((F.col("name") == "p") & (F.col("kind") == "open")).alias("paragraphs"))


@query(r"""SELECT o_custkey, count(*) AS items, max(d) AS depth, CAST(sum(d) AS BIGINT) AS depths FROM (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS d FROM orders) GROUP BY 1""")
def html_enclosing(spark, d):
    item = F.when(F.col("o_orderkey") % 2 == 0, "<ul><li>inner<br></li></ul>").otherwise("<li>outer</li>")
    rows = _made(_joined(table(spark, d, "orders"), "o_custkey", "o_orderkey", item), "o_custkey", F.concat(F.lit("<ol>"), "pieces", F.lit("</ol>")))
    rows = rows.where("kind = 'open' and name = 'li'")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("items"), F.max("depth").cast("int").alias("depth"), F.sum("depth").alias("depths"))


@query("""WITH k AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 100 END AS v, o_orderkey % 5 = 1 AND o_orderkey % 4 <> 0 AS gone, CASE WHEN o_orderkey % 5 = 1 THEN ' ' ELSE o_orderstatus END AS t FROM orders),
    g AS (SELECT *, count(v) OVER w AS grp FROM k WHERE NOT gone WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    n AS (SELECT *, coalesce(first_value(v) OVER (PARTITION BY o_custkey, grp ORDER BY o_orderkey) + row_number() OVER (PARTITION BY o_custkey, grp ORDER BY o_orderkey) - 1, row_number() OVER (PARTITION BY o_custkey, grp ORDER BY o_orderkey)) AS number FROM g)
    SELECT c.o_custkey, '<ol>' || coalesce(string_agg('<li value="' || number || '">' || t || '</li>', '' ORDER BY o_orderkey), '') || '</ol>' AS html FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN n ON c.o_custkey = n.o_custkey GROUP BY 1""")
def list_repair(spark, d):
    k = F.col("o_orderkey")
    item = F.concat(F.lit("<li"), F.when(k % 4 == 0, F.concat(F.lit(" value='"), (k % 100).cast("string"), F.lit("'"))).otherwise(""), F.lit(">"), F.when(k % 5 == 1, " ").otherwise(F.col("o_orderstatus")), F.lit("</li>"))
    rows = _made(_joined(table(spark, d, "orders"), "o_custkey", "o_orderkey", item), "o_custkey", F.concat(F.lit("<ol>"), "pieces", F.lit("</ol>")))
    return nodes.serialise(tree.number_items(tree.drop_empty_items(rows)), "o_custkey")


@query("""SELECT p_partkey, '<ol' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' class="x"' END || ' style="' || CASE p_partkey % 3 WHEN 0 THEN 'color: red; ' ELSE '' END || 'margin-left: 0; padding-left: 1.2em"' || CASE p_partkey % 3 WHEN 1 THEN ' type="a"' ELSE '' END || '><li' || CASE p_partkey % 3 WHEN 1 THEN ' style="list-style-type: lower-alpha"' ELSE '' END || '>' || p_name || '</li></ol>' AS html FROM part""")
def list_indent(spark, d):
    k = F.col("p_partkey") % 3
    start = F.when(k == 0, '<ol style="margin-left:.5in;COLOR: red;mso-list:l0">').otherwise('<ol class="x">')
    item = F.when(k == 1, '<li style="text-indent:-3px;list-style-type:lower-alpha">').otherwise('<li style="padding-left: 9px">')
    rows = _made(table(spark, d, "part"), "p_partkey", F.concat(start, item, "p_name", F.lit("</li></ol>")))
    return nodes.serialise(tree.infer_list_types(tree.indent_lists(rows)), "p_partkey")


@query("""SELECT p_partkey, '<p style="font-size: ' || p_size || 'px; color: red; font-weight: ' || CASE WHEN p_partkey % 2 = 0 THEN 'bold' ELSE '500' END || '; margin-top: ' || p_size / 2 || 'px" class="a ' || CASE WHEN p_size <= 12 THEN 'text-xs' WHEN p_size <= 14 THEN 'text-sm' WHEN p_size <= 17 THEN 'text-base' WHEN p_size <= 20 THEN 'text-lg' ELSE 'text-xl' END
    || CASE WHEN p_partkey % 2 = 0 THEN ' font-bold' ELSE ' font-medium' END || CASE WHEN p_size / 2 <= 0 THEN ' mt-0' WHEN p_size / 2 <= 4 THEN ' mt-1' WHEN p_size / 2 <= 8 THEN ' mt-2' WHEN p_size / 2 <= 12 THEN ' mt-3' WHEN p_size / 2 <= 16 THEN ' mt-4' ELSE ' mt-6' END || '">x</p><i style="top:1px">y</i>' AS html FROM part""")
def style_migrate(spark, d):
    half = (F.col("p_size") / 2).cast("string")
    style = F.concat(F.lit("font-size:"), "p_size", F.lit("px;color:red; font-weight:"), F.when(F.col("p_partkey") % 2 == 0, "bold").otherwise("500"), F.lit(";margin-top:"), half, F.lit("px;"))
    rows = _made(table(spark, d, "part"), "p_partkey", F.concat(F.lit('<p class="a" style="'), style, F.lit('">x</p><i style="top:1px">y</i>')))
    return nodes.serialise(tree.migrate_styles(rows), "p_partkey")


@query("""SELECT r_regionkey, '<table class="' || CASE WHEN r_regionkey % 2 = 0 THEN 'cornell-table' ELSE 'cornell-table' END || '"><tr>' || CASE WHEN r_regionkey % 2 = 0 THEN '<td class="notes">My notes</td><td>x</td><td class="cues">Cue</td>' ELSE '<td class="cues">a</td><td class="notes">b</td><td>c</td>' END || '</tr>'
    || string_agg('<tr>' || CASE WHEN r_regionkey % 2 = 0 THEN '<td class="notes">' || n_name || '</td><td>1</td><td class="cues">2</td>' ELSE '<td class="cues">' || n_name || '</td><td class="notes">1</td><td>2</td>' END || '</tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def cornell_tagging(spark, d):
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>1</td><td>2</td></tr>"))
    made = _joined(table(spark, d, "nation"), "n_regionkey", "n_nationkey", row).withColumnRenamed("n_regionkey", "r_regionkey")
    head = F.when(F.col("r_regionkey") % 2 == 0, "<td>My notes</td><td>x</td><td>Cue</td>").otherwise("<td>a</td><td>b</td><td>c</td>")
    rows = _made(made, "r_regionkey", F.concat(F.lit("<table><tr>"), head, F.lit("</tr>"), "pieces", F.lit("</table>")))
    return nodes.serialise(tree.tag_cornell(rows), "r_regionkey")


@query("""SELECT o_orderkey, '<div><p>' || CASE WHEN o_orderkey % 3 = 0 THEN '3 May 2024<span class="created-time" style="margin-left: 0.75em">10:30</span></p>' WHEN o_orderkey % 3 = 1 THEN '3 May 2024</p><p>' || o_orderstatus || '</p>' ELSE o_orderstatus || '</p><p>10:30</p>' END || '<p>end</p></div>' AS html FROM orders""")
def date_row_markup(spark, d):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "<b>3 May</b> 2024</p><p>10:30</p>").when(k == 1, F.concat(F.lit("3 May 2024</p><p>"), "o_orderstatus", F.lit("</p>"))).otherwise(F.concat("o_orderstatus", F.lit("</p><p>10:30</p>")))
    rows = _made(table(spark, d, "orders"), "o_orderkey", F.concat(F.lit("<div><p>"), text, F.lit("<p>end</p></div>")))
    return nodes.serialise(tree.merge_date_rows(rows), "o_orderkey")


@query("""SELECT p_partkey, '<p title="a' || chr(160) || 'b">' || p_name || '</p><img src="x"' || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' width="3" style="top:1px"' ELSE ' height="4"' END || '>' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '<meta name="author" content="me">' END AS html FROM part""")
def page_tokens_cleaned(spark, d):
    k = F.col("p_partkey") % 3
    image = F.when(k == 0, " width='' height=\" \" style='mso-a:1'").when(k == 1, ' width="3" style="top:1px;mso-b:2"').otherwise(' height="4"')
    meta = F.when(F.col("p_partkey") % 2 == 0, '<meta name=Generator content="x"><META name="a" content="Microsoft Word 15">').otherwise('<meta name="author" content="me">')
    html = F.concat(F.lit('<p title="a b">'), F.replace("p_name", F.lit(" "), F.lit(" ")), F.lit('</p><img src="x"'), image, F.lit(">"), meta)
    rows = _made(table(spark, d, "part"), "p_partkey", html)
    return nodes.serialise(nodes.settle(tree.plain_texts(tree.clean_images(tree.drop_vendor_meta(rows)))), "p_partkey")


@query("""SELECT page_id, replace(html, '</head>', '<meta name="viewport" content="width=device-width, initial-scale=1.0"></head>') AS output FROM pages""")
def html_clean(spark, d):
    return clean_pages(table(spark, d, "pages").select("page_id", "html"), "page_id", "html", profile("generic", indent_all=False)).select("page_id", "output")


def _rules() -> str:
    """Which elements a start tag ends and where an end tag stops, as rows of SQL."""
    some = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]::VARCHAR[]"
    ends = ", ".join(f"('{n}', {some(a)}, {some(b)})" for n, (a, b) in nodes.ENDS.items())
    limits = ", ".join(f"('{n}', {some(b)})" for n, b in nodes.LIMITS.items())
    return f"ends(name, closes, limits) AS (VALUES {ends}), stops(name, stops) AS (VALUES {limits})"


#: Lists, paragraphs, tables and quoted signs without their end tags, by page.
_OMITTED = ["<ul><li>a<li>b<p>c<p>d<ul><li>e</ul>f</ul>g", '<table><tr><td>x<td title="a>b">y<tr><th>z</table></div>', "<dl><dt>a<dd>b<p>c<dt>d</dl><p>e<div>f</p>g", "<select><option>a<option>b</select><script>if (a<b) '</p>'</script><br/><ol><li>h"]
_QUOTED = ", ".join("'" + t.replace("'", "''") + "'" for t in _OMITTED)
_HEADS = ", ".join(f"'{n}'" for n in ("meta", "title", "link", "style", "script", "base", "noscript", "template"))


@query(rf"""WITH RECURSIVE {_rules()}, p AS (SELECT page_id, regexp_extract_all(html || ([{_QUOTED}])[CAST(page_id % 4 AS INT) + 1],
        '(?s)<!--.*?-->|<!.*?>|</?[A-Za-z](?:[^>=]|=\s*"[^"]*"|=\s*''[^'']*''|=)*>|[^<]+|<') AS raws FROM pages),
    t AS MATERIALIZED (SELECT x.*, e.closes, e.limits, coalesce(s.stops, ['td', 'th', 'caption', 'table']) AS stops FROM (
        SELECT page_id, i, name, CASE WHEN NOT regexp_matches(raw, '^<[/!A-Za-z]') THEN 'text' WHEN starts_with(raw, '</') THEN 'close'
            WHEN name = '' OR name IN ({", ".join(f"'{n}'" for n in nodes.VOID)}) OR ends_with(raw, '/>') THEN 'void' ELSE 'open' END AS kind
        FROM (SELECT page_id, i, raw, lower(regexp_extract(raw, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) AS name FROM (SELECT page_id, unnest(raws) AS raw, unnest(range(len(raws))) AS i FROM p))) x
        LEFT JOIN ends e ON e.name = x.name LEFT JOIN stops s ON s.name = x.name),
    run AS (
        SELECT page_id, CAST(-1 AS BIGINT) AS i, []::STRUCT(p BIGINT, n VARCHAR)[] AS stack, '' AS plain, '' AS name, '' AS kind, CAST(-1 AS BIGINT) AS parent, []::BIGINT[] AS left_at, CAST(-1 AS BIGINT) AS met FROM p
        UNION ALL
        SELECT page_id, i, CASE WHEN kind = 'open' THEN list_append(now, struct_pack(p := i, n := name)) ELSE now END,
            CASE WHEN kind = 'open' AND name IN ('script', 'style', 'textarea', 'title') THEN name WHEN kind = 'close' AND d > 0 THEN '' ELSE plain END, name, kind,
            CASE WHEN kind = 'close' AND d > 0 THEN stack[d].p WHEN len(now) > 0 THEN now[-1].p ELSE -1 END,
            [x.p FOR x IN stack[len(now) + 1 + CASE WHEN kind = 'close' AND d > 0 THEN 1 ELSE 0 END:]], CASE WHEN kind = 'close' AND d > 0 THEN stack[d].p ELSE -1 END
        FROM (SELECT *, CASE WHEN kind IN ('open', 'void') AND name <> '' AND len(cut) > 0 AND cut[-1].n = 'head' AND name NOT IN ({_HEADS}) THEN cut[:-2] ELSE cut END AS now
            FROM (SELECT *, CASE WHEN d > 0 THEN stack[:d - 1] ELSE stack END AS cut
                FROM (SELECT *, CASE WHEN kind = 'close' THEN coalesce(list_max([k FOR k IN range(1, len(stack) + 1) IF stack[k].n = name AND k >= b]), 0)
                        WHEN kind IN ('open', 'void') AND closes IS NOT NULL THEN coalesce(list_min([k FOR k IN range(1, len(stack) + 1) IF list_contains(closes, stack[k].n) AND k >= b]), 0) ELSE 0 END AS d
                    FROM (SELECT r.page_id, t.i, r.stack, r.plain, t.name, CASE WHEN r.plain <> '' AND NOT (t.kind = 'close' AND t.name = r.plain) THEN 'text' ELSE t.kind END AS kind, t.closes,
                        coalesce(list_max([k FOR k IN range(1, len(r.stack) + 1) IF list_contains(CASE WHEN t.kind = 'close' THEN t.stops ELSE t.limits END, r.stack[k].n)]), 0) AS b
                        FROM run r JOIN t ON t.page_id = r.page_id AND t.i = r.i + 1))))),
    left_ AS (SELECT page_id, unnest(left_at) AS pos, i - 1 AS last FROM run UNION ALL SELECT page_id, met, i FROM run WHERE met >= 0)
    SELECT r.page_id, CAST(r.i AS INT) AS pos, r.name, CAST(r.parent AS INT) AS parent, CAST(coalesce(l.last, len(p.raws) - 1) AS INT) AS last
    FROM run r JOIN p ON p.page_id = r.page_id LEFT JOIN left_ l ON l.page_id = r.page_id AND l.pos = r.i WHERE r.kind = 'open'""")
def html_nodes(spark, d):
    more = F.element_at(F.array(*map(F.lit, _OMITTED)), (F.col("page_id") % 4 + 1).cast("int"))
    rows = nodes.nodes(table(spark, d, "pages").select("page_id", F.concat("html", more).alias("html")), "html")
    return rows.where("kind = 'open'").select("page_id", "pos", "name", "parent", F.col("end").alias("last"))


@query("""SELECT p_partkey, 2 AS by_name, 3 AS by_class, 1 AS child, 1 AS deep, CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS by_value, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS listed FROM part""")
def html_selectors(spark, d):
    html = F.concat(F.lit('<div class="a b" id="i'), F.col("p_partkey") % 2, F.lit("\"><p data-x='"), F.col("p_partkey") % 3, F.lit("'>t<span class='c  b' title='class=b>'>u</span></p></div><p class=b>v</p>"))
    rows, tests = _made(table(spark, d, "part"), "p_partkey", html), {"by_name": "p", "by_class": ".b", "child": "div > p", "deep": "div span", "by_value": '[data-x="1"]', "listed": "div#i0.a p, p.b"}
    for out, selector in tests.items():
        rows = nodes.select(rows, selector, out)
    return rows.groupBy("_page").agg(F.first("p_partkey").alias("p_partkey"), *[F.count_if(c).cast("int").alias(c) for c in tests]).drop("_page")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, o_orderkey % 2 = 0 AS nested, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    l AS (SELECT *, '<li>' || s || CASE WHEN nested THEN '<ol><li>' || p || '</li></ol></li>' ELSE '' END AS item FROM o),
    g AS (SELECT o_custkey, n > 1 OR bool_or(nested) AS many, string_agg('-', '') AS rest, string_agg('<ol start="' || nth || '">' || item || '</ol>-', '' ORDER BY nth) AS whole,
        string_agg(item || CASE WHEN nested THEN '<li>' || p || '</li>' ELSE '' END, '' ORDER BY nth) AS items FROM l GROUP BY o_custkey, n)
    SELECT o_custkey, '<table><tr><td>' || CASE WHEN many THEN rest || '<ol start="1">' || items || '</ol>' ELSE whole END || '</td><td><ol><li>x</li></ol></td></tr></table>' AS html, CASE WHEN many THEN 1 ELSE 0 END AS cells FROM g""")
def merge_lists(spark, d):
    made = table(spark, d, "orders").withColumn("nth", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    item = F.concat(F.lit('<ol start="'), "nth", F.lit('"><li>'), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<ol><li>"), "o_orderpriority", F.lit("</li></ol></li>"))).otherwise(""), F.lit("</ol>-"))
    joined = _joined(made, "o_custkey", "nth", item)
    html = F.concat(F.lit("<table><tr><td>"), "pieces", F.lit("</td><td><ol><li>x</li></ol></td></tr></table>"))
    return tree.merge_lists(joined.select("o_custkey", html.alias("html")), "html", "cells")


def _note_pages(spark, d):
    """Pages with a date row, a table of cues, lists and styles to repair, by part."""
    k = F.col("p_partkey")
    html = F.concat(
        F.lit('<html><head><meta name="Generator" content="x"></head><body><div><p style="color:red">3 May 2024</p><p style="top:1px">10:30</p></div><table><tr><td style="'), F.when(k % 3 == 0, "FONT-SIZE:12px;top:2px").otherwise("top:2px"),
        F.lit('">Cues</td><td>Notes</td></tr><tr><td><ol style="'), F.when(k % 5 == 0, "list-style-type: lower-roman;").otherwise(""), F.lit('margin-left:36px"><li value="x">a'), F.when(k % 2 == 0, "<li> ").otherwise(""), F.lit("<li title='value=7 >'>"), "p_name", F.lit('</ol></td><td>n</td></tr></table><img width="" src="s"></body></html>'),
    )
    return table(spark, d, "part").select("p_partkey", html.alias("html"))


_NOTE_SQL = """SELECT p_partkey, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1.0"><title>Document</title><link rel="stylesheet" href="assets/tailwind-output.css"></head><body><div><p style="color:red">3 May 2024<span class="created-time" style="top:1px; margin-left: 0.75em">10:30</span></p></div><table class="cornell-table"><tr><td'
    || CASE WHEN p_partkey % 3 = 0 THEN ' style="FONT-SIZE: 12px; top: 2px" class="cues text-xs"' ELSE ' style="top:2px" class="cues"' END || '>Cues</td><td class="notes">Notes</td></tr><tr><td class="cues"><ol style="' || CASE WHEN p_partkey % 5 = 0 THEN 'list-style-type: lower-roman; ' ELSE '' END || 'margin-left: 0; padding-left: 1.2em" class="list-decimal list-outside pl-5"' || CASE WHEN p_partkey % 5 = 0 THEN ' type="i"' ELSE '' END
    || '><li value="1">a<li title=''value=7 >'' value="2">' || p_name || '</ol></td><td class="notes">n</td></tr></table><img src="s"></body></html>' AS output FROM part"""


@query(_NOTE_SQL)
def note_pages(spark, d):
    return clean_pages(_note_pages(spark, d), "p_partkey", "html").select("p_partkey", "output")


@query("""SELECT step, count(*) AS pages, CAST(sum(n) AS BIGINT) AS total FROM (SELECT unnest([{'step': 'EnsureCharset', 'n': 1}, {'step': 'EnsureViewport', 'n': 1}, {'step': 'EnsureTitle', 'n': 1}, {'step': 'RemoveVendorMeta', 'n': 1}, {'step': 'SanitizeImages', 'n': 1}, {'step': 'annotateCornellSemantics.tablesTagged', 'n': 1},
        {'step': 'annotateCornellSemantics.cueCellsTagged', 'n': 2}, {'step': 'annotateCornellSemantics.notesCellsTagged', 'n': 2}, {'step': 'mergeCreatedDateTimeRow.merged', 'n': 1}, {'step': 'normalizeListIndentation.normalized', 'n': 1}, {'step': 'normalizeCueColumnLists.updated', 'n': 1}, {'step': 'smartRepair.cleaned', 'n': 1}, {'step': 'smartRepair.filled', 'n': 2}, {'step': 'InjectCss', 'n': 1},
        {'step': 'migrateInlineStylesToUtilities.nodesTouched', 'n': CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END}, {'step': 'migrateInlineStylesToUtilities.declarationsMigrated', 'n': CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END}, {'step': 'removeEmptyListItems.removed', 'n': CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END}, {'step': 'inferListTypes.inferred', 'n': CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END}], recursive := true) FROM part) WHERE n > 0 GROUP BY step""")
def step_rollup(spark, d):
    return pages.log_rollup(clean_pages(_note_pages(spark, d), "p_partkey", "html"))


_CLASS = rf"(CASE WHEN line = '' THEN 'blank' WHEN {_KIND} IS NOT NULL THEN 'table' WHEN regexp_matches(line, '^[-*•]\s+') THEN 'ul' WHEN regexp_matches(line, '^(\d+[\.)]|[A-Za-z][\.)])\s+') THEN 'ol' WHEN {_LEVEL} IS NOT NULL THEN 'heading' ELSE 'paragraph' END)"


@query(f"""WITH {_LINES}, v AS (SELECT doc_id, pos, {_STRIP('line')} AS line FROM lines), c AS (SELECT doc_id, pos, line, {_CLASS} AS kind FROM v),
    p AS (SELECT *, lag(kind) OVER w AS was, lag(line) OVER w AS p FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    f AS (SELECT *, CASE WHEN was = kind AND (kind IN ('ul', 'ol') OR (kind = 'paragraph' AND NOT (regexp_matches(p, '[.!?;:]$') AND regexp_matches(line, '^[A-Z][A-Za-z0-9]')))) THEN 0 ELSE 1 END AS new FROM p WHERE kind NOT IN ('blank', 'table')),
    b AS (SELECT doc_id, kind, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM f)
    SELECT doc_id, kind, min(pos) AS first_at, count(*) AS n FROM b GROUP BY doc_id, kind, block""")
def text_blocks(spark, d):
    made = blocks.blocks(doc_lines(spark, d).withColumn("pos", F.col("pos").cast("long")), "doc_id", "pos", "line", across_lists=False)
    return made.where("kind <> 'table'").select("doc_id", "kind", "first_at", F.size("items").cast("long").alias("n"))


_MIX = "(o_orderkey * 7919 + o_custkey * 31) % 15"


def _mixed_lines(spark, d):
    """Lines of tables of several delimiters and widths, lists, headings and paragraphs, by customer."""
    k, s = F.expr(_MIX), F.col("o_orderstatus")
    cases = [F.concat(F.lit("a | b | "), s), "| --- | --- | --- |", "x | y | z | w", "p  q", "one\ttwo\tthree", F.concat(F.lit("- "), F.col("o_orderpriority")), F.concat(F.lit("2) "), s), F.concat(F.lit("## Head "), F.col("o_orderkey")), "", F.concat(F.lit(" Some words of "), s), "Ends here.", "Begins with a capital", "k | l | m | n | o", "| :--- | ---: |", "| --- | --- | --- | --- |"]
    line = F.element_at(F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cases]), (k + 1).cast("int"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", line.alias("line"))


_PUT = {"list": "CASE WHEN lk IS NULL THEN [] ELSE [{'kind': lk, 'level': NULL::INT, 'body': list_transform(li, lambda x: [x]), 'headed': false}] END", "table": "CASE WHEN len(tr) = 0 THEN [] ELSE [{'kind': 'table', 'level': NULL::INT, 'body': list_transform(tr, lambda r: r || list_transform(range(list_max(list_transform(tr, lambda q: len(q))) - len(r)), lambda z: '')), 'headed': th}] END", "par": "CASE WHEN pt IS NULL THEN [] ELSE [{'kind': 'paragraph', 'level': NULL::INT, 'body': [[pt]], 'headed': false}] END"}


@query(rf"""WITH RECURSIVE l AS MATERIALIZED (SELECT *, regexp_replace(line, '^([-*•]|\d+[\.)]|[A-Za-z][\.)])\s+', '') AS item, CASE WHEN tk IS NULL AND regexp_matches(line, '^[-*•]\s+') THEN 'ul' WHEN tk IS NULL AND regexp_matches(line, '^(\d+[\.)]|[A-Za-z][\.)])\s+') THEN 'ol' END AS ik, len(cells) >= 2 AND len(list_filter(cells, lambda c: NOT regexp_matches(c, '^:?-{{3,}}:?$'))) = 0 AS sep FROM (
        SELECT *, CASE WHEN contains(line, chr(9)) THEN 'tab' WHEN contains(line, '|') THEN 'pipe' WHEN contains(line, '  ') THEN 'space' END AS tk, list_filter(list_transform(regexp_split_to_array(line, '\t|\||\s{{2,}}'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM (
            SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, trim(([ 'a | b | ' || o_orderstatus, '| --- | --- | --- |', 'x | y | z | w', 'p  q', 'one' || chr(9) || 'two' || chr(9) || 'three', '- ' || o_orderpriority, '2) ' || o_orderstatus, '## Head ' || o_orderkey, '', ' Some words of ' || o_orderstatus, 'Ends here.', 'Begins with a capital', 'k | l | m | n | o', '| :--- | ---: |', '| --- | --- | --- | --- |'])[CAST({_MIX} AS INT) + 1]) AS line FROM orders))),
    run AS (
        SELECT DISTINCT o_custkey, CAST(0 AS BIGINT) AS n, NULL::VARCHAR AS lk, []::VARCHAR[] AS li, []::VARCHAR[][] AS tr, '' AS td, false AS th, NULL::VARCHAR AS pt, []::STRUCT(kind VARCHAR, level INT, body VARCHAR[][], headed BOOLEAN)[] AS out FROM l
        UNION ALL
        SELECT r.o_custkey, l.n, CASE WHEN ik IS NOT NULL THEN ik END, CASE WHEN ik IS NULL THEN [] WHEN lk = ik THEN li || [item] ELSE [item] END,
            CASE WHEN tk IS NULL THEN [] WHEN len(tr) = 0 AND sep THEN [] WHEN len(tr) = 1 AND sep AND len(cells) = len(tr[1]) THEN tr WHEN len(tr) > 0 AND (td = tk OR len(tr) >= 2) AND abs(len(tr[1]) - len(cells)) <= 1 THEN tr || [cells] WHEN sep THEN [] ELSE [cells] END,
            CASE WHEN len(tr) = 1 AND sep AND len(cells) = len(tr[1]) THEN td WHEN tk IS NOT NULL AND NOT (len(tr) > 0 AND (td = tk OR len(tr) >= 2) AND abs(len(tr[1]) - len(cells)) <= 1) THEN tk ELSE td END,
            CASE WHEN tk IS NULL OR len(tr) = 0 THEN false WHEN len(tr) = 1 AND sep AND len(cells) = len(tr[1]) THEN true WHEN (td = tk OR len(tr) >= 2) AND abs(len(tr[1]) - len(cells)) <= 1 THEN th ELSE false END,
            CASE WHEN ik IS NOT NULL THEN pt WHEN tk IS NOT NULL OR line = '' OR starts_with(line, '#') THEN NULL WHEN pt IS NULL OR (regexp_matches(pt, '[.!?;:]$') AND regexp_matches(line, '^[A-Z][A-Za-z0-9]')) THEN line ELSE pt || ' ' || line END,
            out || CASE WHEN ik IS NULL OR lk <> ik THEN {_PUT['list']} ELSE [] END
                || CASE WHEN tk IS NULL OR (len(tr) > 0 AND NOT (len(tr) = 1 AND sep AND len(cells) = len(tr[1])) AND NOT ((td = tk OR len(tr) >= 2) AND abs(len(tr[1]) - len(cells)) <= 1)) THEN {_PUT['table']} ELSE [] END
                || CASE WHEN ik IS NULL AND (tk IS NOT NULL OR line = '' OR starts_with(line, '#') OR (regexp_matches(pt, '[.!?;:]$') AND regexp_matches(line, '^[A-Z][A-Za-z0-9]'))) THEN {_PUT['par']} ELSE [] END
                || CASE WHEN starts_with(line, '#') THEN [{{'kind': 'heading', 'level': 2, 'body': [[substr(line, 4)]], 'headed': false}}] ELSE [] END
        FROM run r JOIN l ON l.o_custkey = r.o_custkey AND l.n = r.n + 1),
    whole AS (SELECT o_custkey, out || {_PUT['list']} || {_PUT['table']} || {_PUT['par']} AS out FROM run QUALIFY n = max(n) OVER (PARTITION BY o_custkey))
    SELECT o_custkey, CAST(i AS INT) AS block, out[i].kind AS kind, out[i].level AS level, CAST(to_json(out[i].body) AS VARCHAR) AS body, out[i].headed AS headed FROM whole, unnest(range(1, len(out) + 1)) t(i)""")
def structured_blocks(spark, d):
    made = blocks.blocks(_mixed_lines(spark, d), "o_custkey", "o_orderkey", "line")
    text = F.when(F.col("kind").isin("ul", "ol"), F.transform("items", lambda x: F.array(x))).when(F.col("kind") == "table", F.col("rows")).otherwise(F.array(F.array(F.array_join("items", " "))))
    return made.select("o_custkey", "block", "kind", "level", F.to_json(text).alias("body"), "headed")


_STATED = "(o_orderkey * 31 + o_custkey) % 11"
_CASES = ["Title: T{k3}", "Author:A{k2}", "created - 2024-05-0{k3}", "Last Modified: 3 May 2024", "updated 4 May 2024", "5 May 2024 10:3{k3}", "10:4{k3}", "Page-Title: X", "Page_Title : T{k3}", "nothing stated", "Owner: "]


def _stated_lines(spark, d):
    k = {"k2": (F.col("o_orderkey") % 2).cast("string"), "k3": (F.col("o_orderkey") % 3).cast("string")}
    made = [F.replace(F.replace(F.lit(c), F.lit("{k2}"), k["k2"]), F.lit("{k3}"), k["k3"]) for c in _CASES]
    orders = dealt(table(spark, d, "orders"), "o_custkey")
    titles = orders.where("o_custkey % 2 = 0").select("o_custkey", F.lit("T1 ").alias("title")).distinct()
    return blocks.page_metadata(orders.select("o_custkey", "o_orderkey", F.element_at(F.array(*made), (F.expr(_STATED) + 1).cast("int")).alias("line")), "o_custkey", "o_orderkey", "line", titles)


_WAS = lambda v, s, key: f"CASE WHEN key = '{key}' THEN CASE WHEN {v} IS NULL OR ({v} <> val AND {s} <> 'line-key-value') THEN val ELSE {v} END ELSE {v} END AS {v}2, CASE WHEN key = '{key}' AND ({v} IS NULL OR ({v} <> val AND {s} <> 'line-key-value')) THEN 'line-key-value' ELSE {s} END AS {s}2"
_OLD = lambda c: f"CASE key WHEN 'title' THEN t{c} WHEN 'author' THEN a{c} WHEN 'createdAt' THEN c{c} WHEN 'modifiedAt' THEN m{c} END"
_ADD = lambda label, test: f"CASE WHEN {test} AND NOT list_contains(items, {{'label': '{label}', 'value': line}}) THEN [{{'label': '{label}', 'value': line}}] ELSE [] END"
_FOLDED = rf"""WITH RECURSIVE l AS MATERIALIZED (
    SELECT o_custkey, n, line, CASE o WHEN 0 THEN 'title' WHEN 1 THEN 'author' WHEN 2 THEN 'createdAt' WHEN 3 THEN 'modifiedAt' WHEN 8 THEN 'title' END AS key,
        CASE o WHEN 0 THEN 'T' || k3 WHEN 1 THEN 'A' || k2 WHEN 2 THEN '2024-05-0' || k3 || CASE WHEN k3 > 0 THEN 'T00:00:00.000Z' ELSE '' END WHEN 3 THEN '2024-05-03T00:00:00.000Z' WHEN 8 THEN 'T' || k3 END AS val,
        CASE o WHEN 5 THEN '2024-05-05T10:3' || k3 || ':00.000Z' ELSE line END AS iso, o IN (3, 4, 5) AS day, o IN (5, 6) AS clock, o IN (3, 4) AS changed
    FROM (SELECT *, replace(replace(([{", ".join("'" + c + "'" for c in _CASES)}])[CAST(o AS INT) + 1], '{{k2}}', CAST(k2 AS VARCHAR)), '{{k3}}', CAST(k3 AS VARCHAR)) AS line
        FROM (SELECT o_custkey, {_STATED} AS o, o_orderkey % 2 AS k2, o_orderkey % 3 AS k3, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders))),
    run AS (
        SELECT DISTINCT o_custkey, CAST(0 AS BIGINT) AS n, CASE WHEN o_custkey % 2 = 0 THEN 'T1' END AS tv, CASE WHEN o_custkey % 2 = 0 THEN 'hint' END AS ts, NULL::VARCHAR AS av, NULL::VARCHAR AS "as", NULL::VARCHAR AS cv, NULL::VARCHAR AS cs, NULL::VARCHAR AS mv, NULL::VARCHAR AS ms,
            []::STRUCT("key" VARCHAR, existing VARCHAR, incoming VARCHAR, existing_source VARCHAR, incoming_source VARCHAR, resolution VARCHAR)[] AS conflicts, []::STRUCT("label" VARCHAR, "value" VARCHAR)[] AS items FROM l
        UNION ALL
        SELECT o_custkey, n, tv2, ts2, av2, as2, coalesce(cv2, CASE WHEN day AND clock THEN iso END), coalesce(cs2, CASE WHEN day AND clock THEN 'line-heuristic' END), coalesce(mv2, CASE WHEN day AND changed THEN iso END), coalesce(ms2, CASE WHEN day AND changed THEN 'line-heuristic' END),
            conflicts || CASE WHEN key IS NOT NULL AND old <> val THEN [{{'key': key, 'existing': old, 'incoming': val, 'existing_source': olds, 'incoming_source': 'line-key-value', 'resolution': CASE WHEN olds = 'line-key-value' THEN 'kept-existing' ELSE 'replaced-by-priority' END}}] ELSE [] END,
            items || {_ADD('Detected date', 'day')} || {_ADD('Detected time', 'clock')}
        FROM (SELECT r.o_custkey, l.n, l.line, l.key, l.val, l.iso, l.day, l.clock, l.changed, conflicts, items, {_OLD('v')} AS old, {_OLD('s')} AS olds, {_WAS('tv', 'ts', 'title')}, {_WAS('av', '"as"', 'author').replace('"as"2', 'as2')}, {_WAS('cv', 'cs', 'createdAt')}, {_WAS('mv', 'ms', 'modifiedAt')}
            FROM run r JOIN l ON l.o_custkey = r.o_custkey AND l.n = r.n + 1 WHERE len(r.items) < 6)),
    done AS (SELECT * FROM run QUALIFY n = max(n) OVER (PARTITION BY o_custkey))""".replace("CASE WHEN key = 'author' THEN CASE WHEN av", "CASE WHEN key = 'author' THEN CASE WHEN av").replace("WHEN 'author' THEN as ", "WHEN 'author' THEN \"as\" ")


@query(_FOLDED + """ SELECT * FROM (SELECT o_custkey, unnest([{'key': 'title', 'value': tv, 'source': ts}, {'key': 'author', 'value': av, 'source': "as"}, {'key': 'createdAt', 'value': cv, 'source': cs}, {'key': 'modifiedAt', 'value': mv, 'source': ms}], recursive := true) FROM done) WHERE "value" IS NOT NULL""")
def metadata_values(spark, d):
    return blocks.metadata_values(_stated_lines(spark, d), "o_custkey")


@query(_FOLDED + """ SELECT o_custkey, CAST(i - 1 AS INT) AS nth, conflicts[i].key AS "key", conflicts[i].existing AS existing, conflicts[i].incoming AS incoming, conflicts[i].existing_source AS existing_source, conflicts[i].incoming_source AS incoming_source, conflicts[i].resolution AS resolution FROM done, unnest(range(1, len(conflicts) + 1)) t(i)""")
def metadata_conflicts(spark, d):
    return blocks.metadata_conflicts(_stated_lines(spark, d), "o_custkey")


@query(_FOLDED + """ SELECT o_custkey, CAST(i - 1 AS INT) AS nth, all_items[i].label AS "label", all_items[i].value AS "value" FROM (SELECT o_custkey, (list_filter([{'label': 'Title', 'value': tv}, {'label': 'Created', 'value': cv}, {'label': 'Modified', 'value': mv}, {'label': 'Author', 'value': av}], lambda x: x.value IS NOT NULL) || items)[1:8] AS all_items FROM done), unnest(range(1, len(all_items) + 1)) t(i)""")
def metadata_items(spark, d):
    return _stated_lines(spark, d).select("o_custkey", F.posexplode("items").alias("nth", "i")).select("o_custkey", "nth", "i.label", "i.value")


def block_pages(spark, d):
    """Whole pages from the lines of documents."""
    docs = table(spark, d, "documents")
    made = blocks.blocks(doc_lines(spark, d), "doc_id", "pos", "line")
    return blocks.pages(made, "doc_id", docs.select("doc_id", F.concat(F.lit("Document "), "doc_id").alias("title")))


query()(block_pages)


@query("""SELECT p_partkey, '<!DOCTYPE html>' || chr(10) || '<html lang="en"><head><title>' || p_name || '</title></head><body><img src="x" width="' || p_size || '"></body></html>' AS html FROM part""")
def legacy_page(spark, d):
    html = F.concat(F.lit('<html><head></head><body><img src="x" width='), "p_size", F.lit(' height=""></body></html>'))
    return table(spark, d, "part").select("p_partkey", legacy.complete(legacy.drop_empty_dimensions(legacy.quote_dimensions(html)), F.col("p_name")).alias("html"))
