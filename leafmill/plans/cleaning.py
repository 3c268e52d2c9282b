"""The cleaning of whole pages: stages over tokens, switched by a profile, then the head."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import nodes, tree


@dataclass(frozen=True)
class Profile:
    """What a cleaning does; the values are those of the profile cornell."""

    repair_lists: str | None = "smart"  # or renumber, mergeStyled; null: no list is changed
    list_padding: str = "1.2em"
    indent_all: bool = True
    cornell: bool = True
    header_fallback: bool = True
    merge_dates: bool = True
    date_gap: str = "0.75em"
    migrate_styles: bool = True
    remove_migrated: bool = False
    selector: str = "[style]"  # of tags whose styles are migrated
    doctype: bool = True
    css: str | None = "assets/tailwind-output.css"
    title: str = "Document"


PROFILES = {"cornell": Profile(), "generic": Profile(cornell=False, header_fallback=False, migrate_styles=False, css=None)}


def profile(name: str | None = None, **changes) -> Profile:
    """A named profile, cornell where the name is unknown, with changes."""
    return replace(PROFILES.get((name or "").strip().lower(), PROFILES["cornell"]), **changes)


def clean_pages(pages: DataFrame, doc: str, html: str, p: Profile = Profile()) -> DataFrame:
    """(doc, output, logs): cleaned pages, a row for each row of pages. Pages of null or empty markup get a head and nothing else.

    logs counts what each step changed. The nodes of a page are shuffled once; all stages are windows of that
    partitioning. In list mode mergeStyled pages are merged first and read again. Ids may be null or repeat.
    """
    rows = pages.select(F.col(f"`{doc}`").alias("_id"), F.col(f"`{html}`").alias("_html"))
    merge = p.repair_lists == "mergeStyled"
    if merge:
        rows = tree.merge_lists(rows, "_html", "_merged")
    rows = nodes.nodes(rows, "_html")
    if merge:
        rows = tree.counted(rows, "mergeStyled.mergedCount", F.when(F.col("pos") == 0, F.col("_merged"))).drop("_merged")
    rows = tree.plain_texts(tree.clean_images(nodes.settle(tree.drop_vendor_meta(rows), False)))
    if p.cornell:
        rows = tree.tag_cornell(rows, p.header_fallback)
    if p.merge_dates:
        rows = tree.merge_date_rows(rows, p.date_gap)
    if p.migrate_styles:
        rows = tree.migrate_styles(rows, p.remove_migrated, p.selector)
    if p.repair_lists:
        rows = tree.indent_lists(tree.drop_empty_items(rows), p.list_padding, p.indent_all)
        rows = tree.infer_list_types(tree.class_cue_lists(rows))
        if not merge:
            rows = tree.number_items(rows, p.repair_lists == "smart")
    return tree.finish(rows, ["_id"], p.title, p.css, p.doctype).withColumnRenamed("_id", doc)
