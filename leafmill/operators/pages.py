"""Heads and spaces of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import nodes, tree


def clean_head(pages: DataFrame, html: str, title: str = "Document", css: str | None = "assets/tailwind-output.css") -> DataFrame:
    """Adds output and logs (array of step and count) to pages, in place of html.

    A missing head is added, then charset (first in the head), viewport and title where they lack; vendor metas go; a
    style sheet is linked unless css is null; no-break spaces become spaces. Steps that change nothing log nothing.
    """
    kept = [c for c in pages.columns if c != html]
    rows = nodes.nodes(pages, html)
    return tree.finish(nodes.settle(tree.drop_vendor_meta(rows), False), kept, title, css)


def log_rollup(cleaned: DataFrame) -> DataFrame:
    """(step, pages, total): how many pages a step changed and how often."""
    return cleaned.select(F.explode("logs").alias("l")).groupBy(F.col("l.step").alias("step")).agg(F.count("*").alias("pages"), F.sum("l.n").alias("total"))
