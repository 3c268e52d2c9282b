"""Changes of pages as rows of nodes (see nodes.py). Each counts what it does in columns that begin with #, by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import css
from leafmill.functions.lines import is_date, is_time
from leafmill.functions.text import collapse, escape_html, plain_spaces, strip
from leafmill.operators.lists import renumber
from leafmill.operators.nodes import drop, get, has_class, is_open, nodes, page_window, put, put_classes, select, set_attrs, settle, tag_text, within

#: Steps of a cleaning in the order in which they are logged. Fixed values.
STEPS = (
    "EnsureHead", "EnsureCharset", "EnsureViewport", "EnsureTitle", "RemoveVendorMeta", "SanitizeImages", "RemoveNbsp",
    "annotateCornellSemantics.tablesTagged", "annotateCornellSemantics.cueCellsTagged", "annotateCornellSemantics.notesCellsTagged", "mergeCreatedDateTimeRow.merged",
    "migrateInlineStylesToUtilities.nodesTouched", "migrateInlineStylesToUtilities.declarationsMigrated", "mergeStyled.mergedCount", "removeEmptyListItems.removed",
    "normalizeListIndentation.normalized", "normalizeCueColumnLists.updated", "inferListTypes.inferred", "renumber.total", "smartRepair.cleaned", "smartRepair.filled", "InjectCss", "embedImages.replacements",
)


def counted(rows: DataFrame, step: str, n: Column) -> DataFrame:
    """Adds n, a number or a test, to the step's count of each node."""
    have = F.col(f"`#{step}`") if f"#{step}" in rows.columns else F.lit(0)
    return rows.withColumn(f"#{step}", (have + F.coalesce(n.cast("int"), F.lit(0))).cast("int"))


def _tag(*names: str) -> Column:
    return F.col("kind").isin("open", "void") & F.col("name").isin(*names)


def drop_vendor_meta(rows: DataFrame) -> DataFrame:
    """Without metas that editors leave, by name or by content."""
    name, content = F.coalesce(get(F.col("attrs"), "name"), F.lit("")), F.coalesce(get(F.col("attrs"), "content"), F.lit(""))
    theirs = _tag("meta") & (name.rlike("(?i)one|mso|generator") | content.rlike("(?i)mso|word|onenote"))
    rows = rows.withColumn("_theirs", F.coalesce(theirs, F.lit(False)))
    return counted(rows, "RemoveVendorMeta", F.col("_theirs")).withColumn("gone", F.col("gone") | F.col("_theirs")).drop("_theirs")


def plain_texts(rows: DataFrame) -> DataFrame:
    """No-break characters in texts become spaces; attributes keep theirs."""
    has = (F.col("kind") == "text") & F.contains("raw", F.lit(" "))
    return counted(rows, "RemoveNbsp", has).withColumn("raw", F.when(has, F.translate("raw", " ", " ")).otherwise(F.col("raw")))


def clean_images(rows: DataFrame) -> DataFrame:
    """Images lose blank widths and heights, and declarations with mso- of their styles."""
    for name in ("width", "height"):
        blank = _tag("img") & (strip(get(F.col("attrs"), name)) == "")
        rows = set_attrs(counted(rows, "SanitizeImages", blank), blank, drop(F.col("attrs"), name))
    style = get(F.col("attrs"), "style")
    kept = F.array_join(F.filter(F.split(style, ";"), lambda d: ~F.lower(d).contains("mso-")), ";")
    has = _tag("img") & F.lower(style).contains("mso-")
    rows = counted(rows, "SanitizeImages", has)
    return set_attrs(rows, has, F.when(strip(kept) == "", drop(F.col("attrs"), "style")).otherwise(put(F.col("attrs"), "style", kept)))


def tag_cornell(rows: DataFrame, fallback: bool = True) -> DataFrame:
    """Tables of two cells or more in their first row are marked, and in each row the cells of cues and of notes.

    Rows are those of a table's bodies, or its own where it has none; cells are children of rows. The columns are those
    whose heads say so; without such heads the first two, if fallback. Tables where both fall on one column stay.
    """
    table = Window.partitionBy("_page", "table")
    bodies = F.max(is_open("tr") & (F.col("up") == "tbody")).over(table)
    rows = rows.withColumn("_of", F.when(bodies, "tbody").otherwise("table"))
    rows = rows.withColumns({"_mine": is_open("tr") & (F.col("up") == F.col("_of")), "_cell": is_open("td", "th") & (F.col("up") == "tr") & (F.col("upper") == F.col("_of"))})
    rows = rows.withColumn("_first", F.min(F.when(F.col("_mine"), F.col("pos"))).over(table))
    head = F.col("_cell") & (F.col("parent") == F.col("_first"))
    said = F.lower(collapse(plain_spaces(F.coalesce("said", F.lit("")))))
    least = lambda test: F.min(F.when(test, F.col("nth"))).over(table)
    rows = rows.withColumns({"_cue": least(head & said.rlike(r"\bcue(s)?\b")), "_note": least(head & said.rlike(r"\bnote(s)?\b")), "_n": F.count_if(head).over(table)})
    cue, note = F.coalesce("_cue", F.lit(0)), F.coalesce("_note", F.lit(1))
    use = (F.col("_n") >= 2) & (cue != note) & (F.lit(fallback) | F.col("_cue").isNotNull() | F.col("_note").isNotNull())
    marks = (("cornell-table", "tablesTagged", use & is_open("table")), ("cues", "cueCellsTagged", use & F.col("_cell") & (F.col("nth") == cue)), ("notes", "notesCellsTagged", use & F.col("_cell") & (F.col("nth") == note)))
    for name, what, test in marks:
        rows = set_attrs(counted(rows, f"annotateCornellSemantics.{what}", test), test, put_classes(F.col("attrs"), F.array(F.lit(name))))
    return rows.drop("_of", "_mine", "_first", "_cell", "_cue", "_note", "_n")


def merge_date_rows(rows: DataFrame, gap: str = "0.75em") -> DataFrame:
    """In each division the first of its own paragraphs with a date that one with a time follows takes that time in a span, with the time's style."""
    own = is_open("p") & (F.col("up") == "div")
    said = F.when(own, collapse(plain_spaces(F.col("said"))))
    w = Window.partitionBy("_page", "_of").orderBy("pos")
    rows = rows.withColumns({"_of": F.when(own, F.struct("parent", F.lit(-1).alias("x"))).otherwise(F.struct(F.lit(-1).alias("parent"), F.col("pos").alias("x"))), "_said": said})
    rows = rows.withColumns({"_next": F.lead("_said").over(w), "_style": F.lead(get(F.col("attrs"), "style")).over(w), "_last": F.lag("pos").over(w)})
    pair = F.when(own & is_date(F.col("_said")) & is_time(F.col("_next")), F.col("pos"))
    rows = rows.withColumn("_first", F.min(pair).over(Window.partitionBy("_page", "_of")))
    rows = rows.withColumns({"_pair": F.coalesce(F.col("pos") == F.col("_first"), F.lit(False)), "_time": F.coalesce(F.col("_last") == F.col("_first"), F.lit(False))})
    style = F.concat(F.when(strip(F.col("_style")) != "", F.concat("_style", F.lit("; "))).otherwise(""), F.lit(f"margin-left: {gap}"))
    made = F.concat("_said", F.lit('<span class="created-time" style="'), F.replace(style, F.lit('"'), F.lit("&quot;")), F.lit('">'), "_next", F.lit("</span>"))
    held = F.max(F.when(F.col("_pair") | F.col("_time"), F.struct("end", "_time", "pos"))).over(page_window().rowsBetween(Window.unboundedPreceding, -1))
    rows = counted(rows, "mergeCreatedDateTimeRow.merged", F.col("_pair")).withColumn("after", F.when(F.col("_pair"), made).otherwise(F.col("after"))).withColumn("_held", held)
    inside = (F.col("_held.end") >= F.col("pos")) & (F.col("_held._time") | (F.col("kind") != "close") | (F.col("parent") != F.col("_held.pos")))
    rows = rows.withColumn("gone", F.col("gone") | F.col("_time") | F.coalesce(inside, F.lit(False)))
    return settle(rows, False).drop("_of", "_said", "_next", "_style", "_last", "_first", "_pair", "_time", "_held")


def _class_of(d: Column) -> Column:
    """Utility class of a declaration; null for those that have none."""
    p = F.lower(d["prop"])
    return (
        F.when(p == "font-family", "font-sans").when(p == "font-size", css.font_size(d["value"])).when(p == "font-weight", css.font_weight(d["value"]))
        .when(p == "margin-top", css.margin("mt", d["value"])).when(p == "margin-bottom", css.margin("mb", d["value"]))
    )


def migrated(entries: Column) -> Column:
    """Utility classes of style declarations, in order, each once."""
    return F.array_distinct(F.filter(F.transform(entries, _class_of), lambda c: c.isNotNull()))


def migrate_styles(rows: DataFrame, remove: bool = False, selector: str = "[style]") -> DataFrame:
    """Selected tags with known declarations get classes for them; the style is written anew, names as they were, without those if remove."""
    rows = select(rows, selector, "_selected")
    entries = F.when(F.col("_selected"), css.declarations(get(F.col("attrs"), "style"), False))
    rows = rows.withColumn("_style", F.transform(entries, lambda d: F.struct(d["prop"].alias("prop"), d["value"].alias("value"), _class_of(d).alias("class"))))
    known = F.filter("_style", lambda d: d["class"].isNotNull())
    rest = css.style_text(F.filter("_style", lambda d: d["class"].isNull()) if remove else F.col("_style"))
    test = F.size(known) > 0
    rows = counted(counted(rows, "migrateInlineStylesToUtilities.nodesTouched", test), "migrateInlineStylesToUtilities.declarationsMigrated", F.when(test, F.size(known)))
    styled = F.when(rest == "", drop(F.col("attrs"), "style")).otherwise(put(F.col("attrs"), "style", rest))
    return set_attrs(rows, test, put_classes(styled, F.array_distinct(F.transform(known, lambda d: d["class"])))).drop("_selected", "_style")


def drop_empty_items(rows: DataFrame) -> DataFrame:
    """Without the items, and what they hold, whose nearest list is numbered and that have no text, no media or table, and no number of their own."""
    test = F.coalesce(is_open("li") & (F.col("listed") == "ol") & (F.col("inside") == 0) & (F.coalesce(strip(get(F.col("attrs"), "value")), F.lit("")) == ""), F.lit(False))
    rows = rows.withColumn("_empty", test)
    rows = counted(rows, "removeEmptyListItems.removed", F.col("_empty")).withColumn("gone", F.col("gone") | F.col("_empty"))
    return settle(rows).drop("_empty")


def _family(rows: DataFrame) -> DataFrame:
    """Adds _list: a list and its own items share one, all others have their own; and _items, whether a node is an item of a list."""
    item = is_open("li") & F.col("up").isin("ol", "ul")
    return rows.withColumns({"_items": item, "_list": F.when(is_open("ol", "ul"), F.struct("pos", F.lit(False).alias("x"))).when(item, F.struct(F.col("parent").alias("pos"), F.lit(False).alias("x"))).otherwise(F.struct("pos", F.lit(True).alias("x")))})


def indent_lists(rows: DataFrame, padding: str = "1.2em", every: bool = True) -> DataFrame:
    """Lists and their items lose indents and editors' hints, and lists get no margin and the padding: all, or those that are too far indented or have such items."""
    rows = _family(rows)
    part = F.when(is_open("ol", "ul") | F.col("_items"), css.declarations(get(F.col("attrs"), "style")))
    rows = rows.withColumn("_style", part)
    change = F.lit(True) if every else F.max(F.coalesce(css.excess_indent(F.col("_style")), F.lit(False))).over(Window.partitionBy("_page", "_list"))
    rows = rows.withColumn("_change", change & (is_open("ol", "ul") | F.col("_items")))
    kept = css.remove_keys(F.col("_style"))
    own = put(F.col("attrs"), "style", css.style_text(css.upsert(css.upsert(kept, "margin-left", "0"), "padding-left", padding)))
    item = F.when(F.size(kept) == 0, drop(F.col("attrs"), "style")).otherwise(put(F.col("attrs"), "style", css.style_text(kept)))
    rows = counted(rows, "normalizeListIndentation.normalized", F.col("_change") & ~F.col("_items"))
    styled = F.col("_change") & F.col("_items") & get(F.col("attrs"), "style").isNotNull() & (get(F.col("attrs"), "style") != css.style_text(kept))
    return set_attrs(set_attrs(rows, F.col("_change") & ~F.col("_items"), own), styled, item).drop("_items", "_list", "_style", "_change")


def infer_list_types(rows: DataFrame) -> DataFrame:
    """Numbered lists without a type get one from their own style, else from the first item whose style tells one."""
    rows = _family(rows)
    kind = css.list_type(F.coalesce(get(F.col("attrs"), "style"), F.lit("")))
    first = F.first(F.when(F.col("_items"), kind), ignorenulls=True).over(Window.partitionBy("_page", "_list").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_type", F.when(is_open("ol") & get(F.col("attrs"), "type").isNull(), F.coalesce(kind, first)))
    has = F.col("_type").isNotNull()
    return set_attrs(counted(rows, "inferListTypes.inferred", has), has, put(F.col("attrs"), "type", F.col("_type"))).drop("_items", "_list", "_type")


def number_items(rows: DataFrame, smart: bool = True) -> DataFrame:
    """Items of numbered lists get their numbers: their own where they state one, else one more than before; smart counts values that are none."""
    rows = _family(rows)
    numbered = F.col("_items") & (F.col("up") == "ol")
    value = get(F.col("attrs"), "value")
    rows = rows.withColumn("_item", numbered).withColumn("_value", F.when(F.col("_item") & value.rlike(r"^\d+\z"), value.try_cast("int")))
    rows = renumber(rows, ["_page", "_list", "_item"], ["pos"], "_value", "_number")
    filled = F.col("_item") & F.col("_value").isNull()
    if smart:
        rows = counted(counted(rows, "smartRepair.cleaned", filled & (value != "")), "smartRepair.filled", filled)
    else:
        rows = counted(rows, "renumber.total", filled)
    return set_attrs(rows, F.col("_item"), put(F.col("attrs"), "value", F.col("_number").cast("string"))).drop("_items", "_list", "_item", "_value", "_number")


def class_cue_lists(rows: DataFrame) -> DataFrame:
    """Lists in cells of class cues get the classes of their kind."""
    rows = rows.withColumn("_cued", is_open("td") & has_class(F.col("attrs"), "cues"))
    rows = rows.withColumn("_cued", within(F.col("_cued")) & is_open("ol", "ul"))
    names = F.array(F.when(F.col("name") == "ol", "list-decimal").otherwise("list-disc"), F.lit("list-outside"), F.lit("pl-5"))
    return set_attrs(counted(rows, "normalizeCueColumnLists.updated", F.col("_cued")), F.col("_cued"), put_classes(F.col("attrs"), names)).drop("_cued")


def merge_lists(pages: DataFrame, html: str, count: str) -> DataFrame:
    """Pages with several numbered lists of a table's cell made one, at the cell's end, with the first list's attributes; count has how many cells.

    The list takes the items of all lists of the cell in order, each with all it holds; items of a list within an item
    come once more after it, as they are items of a list of the cell too. Of cells within cells the outermost counts.
    """
    rows = nodes(pages, html)
    rows = rows.withColumn("_outer", is_open("td") & ~within(is_open("td")))
    cell = F.max(F.when(F.col("_outer"), F.struct("pos", "end", "closed"))).over(page_window().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_cell", F.when(cell["end"] >= F.col("pos"), cell))
    rows = rows.withColumn("_many", F.coalesce(F.col("_cell").isNotNull() & (F.count_if(is_open("ol")).over(Window.partitionBy("_page", "_cell.pos")) > 1), F.lit(False)))
    rows = rows.withColumn("_old", F.col("_many") & (is_open("ol") | within(is_open("ol"))))
    item = is_open("li") & (F.col("up") == "ol")
    held = F.array_sort(F.collect_list(F.struct("pos", "end", F.col("parent").alias("of"), item.alias("item"), is_open("ol").alias("first"), tag_text().alias("text"))))
    cells = rows.where("_many").groupBy(F.col("_page").alias("_p"), F.col("_cell.pos").alias("_c")).agg(held.alias("_held"))
    items = F.array_sort(F.transform(F.filter("_held", lambda t: t["item"]), lambda t: F.struct(t["of"].alias("of"), t["pos"].alias("pos"), t["end"].alias("end"))))
    whole = lambda i: F.array_join(F.transform(F.slice("_held", i["pos"] - F.col("_c") + 1, i["end"] - i["pos"] + 1), lambda t: t["text"]), "")
    made = F.concat(F.get(F.filter("_held", lambda t: t["first"]), 0)["text"], F.array_join(F.transform(items, whole), ""), F.lit("</ol>"))
    rows = rows.join(cells.select("_p", "_c", made.alias("_made")), (F.col("_page") == F.col("_p")) & (F.col("_cell.pos") == F.col("_c")), "left")
    text = F.when(F.col("_old"), "").otherwise(tag_text())
    last = F.col("_many") & (F.col("pos") == F.col("_cell.end"))
    text = F.when(last & F.col("_cell.closed"), F.concat("_made", text)).when(last, F.concat(text, F.col("_made"))).otherwise(text)
    parts = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", text.alias("text")))))
    kept = [c for c in pages.columns if c != html]
    return rows.groupBy("_page").agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in kept], F.array_join(F.transform(parts, lambda t: t["text"]), "").alias(html), F.count_if(F.col("_many") & F.col("_outer")).cast("int").alias(count)).drop("_page")


def finish(rows: DataFrame, columns: list[str], title: str = "Document", css_link: str | None = "assets/tailwind-output.css", doctype: bool = False) -> DataFrame:
    """(columns, output, logs): pages with whole heads, and the counts of all steps that changed something.

    A missing head is added, then charset (first in the head), viewport and title where they lack; a style sheet is
    linked unless css_link is null; no-break spaces become spaces. A head ends where its end tag is or where something
    begins that it can't hold.
    """
    attrs, in_head = F.col("attrs"), F.col("head") >= 0
    has = lambda test: F.coalesce(F.max(test), F.lit(False))
    head = F.min(F.when(is_open("head"), F.struct("pos", "end", "closed")))
    lead = (F.col("kind") == "gone") | (F.col("kind") == "void") & (F.col("name") == "") | (F.col("kind") == "text") & (strip(F.col("raw")) == "")
    sums = [F.sum(f"`{c}`").cast("long").alias(c) for c in rows.columns if c.startswith("#")]
    parts = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull() & ~F.col("gone"), F.struct("pos", tag_text().alias("text")))))
    got = rows.groupBy("_page").agg(
        *[F.first(F.col(f"`{c}`")).alias(c) for c in columns], *sums, parts.alias("_parts"), head.alias("_head"), F.min(F.when(is_open("html"), F.col("pos"))).alias("_html"), F.min(F.when(~lead, F.col("pos"))).alias("_body"),
        has(in_head & _tag("meta") & get(attrs, "charset").isNotNull()).alias("_charset"), has(in_head & _tag("meta") & (get(attrs, "name") == "viewport")).alias("_viewport"), has(in_head & is_open("title")).alias("_titled"),
        has((F.col("kind") == "void") & F.lower("raw").startswith("<!doctype")).alias("_doctype"),
    )
    first = F.when(F.col("_charset"), "").otherwise('<meta charset="utf-8">')
    last = F.concat(F.when(F.col("_viewport"), "").otherwise('<meta name="viewport" content="width=device-width, initial-scale=1.0">'), F.when(F.col("_titled"), F.lit("")).otherwise(F.concat(F.lit("<title>"), escape_html(F.lit(title)), F.lit("</title>"))), F.lit(f'<link rel="stylesheet" href="{css_link}">' if css_link else ""))
    said = lambda low, high: F.array_join(F.transform(F.filter("_parts", lambda t: (t["pos"] >= low) & (t["pos"] < high)), lambda t: t["text"]), "")
    top, beyond = F.lit(0), F.lit(2**31 - 1)
    at, end = F.col("_head.pos") + 1, F.when(F.col("_head.closed"), F.col("_head.end")).otherwise(F.col("_head.end") + 1)
    with_head = F.concat(said(top, at), first, said(at, end), last, F.when(F.col("_head.closed"), "").otherwise("</head>"), said(end, beyond))
    new = F.concat(F.lit("<head>"), first, last, F.lit("</head>"))
    with_html = F.concat(said(top, F.col("_html") + 1), new, said(F.col("_html") + 1, beyond))
    bare = F.coalesce("_body", beyond)
    wrapped = F.concat(said(top, bare), F.lit("<html>"), new, said(bare, beyond), F.lit("</html>"))
    out = plain_spaces(F.when(F.col("_head").isNotNull(), with_head).when(F.col("_html").isNotNull(), with_html).otherwise(wrapped))
    if doctype:
        out = F.when(F.col("_doctype"), out).otherwise(F.concat(F.lit("<!DOCTYPE html>\n"), out))
    counts = {"EnsureHead": F.col("_head").isNull(), "EnsureCharset": ~F.col("_charset"), "EnsureViewport": ~F.col("_viewport"), "EnsureTitle": ~F.col("_titled"), "InjectCss": F.lit(css_link is not None)}
    n = lambda step: counts[step].cast("long") if step in counts else F.col(f"`#{step}`") if f"#{step}" in rows.columns else F.lit(0).cast("long")
    logs = F.filter(F.array(*[F.struct(F.lit(step).alias("step"), n(step).alias("n")) for step in STEPS]), lambda x: x["n"] > 0)
    return got.select(*[F.col(f"`{c}`") for c in columns], out.alias("output"), logs.alias("logs"))
