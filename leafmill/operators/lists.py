"""Numbering and repair of list items as window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumber(items: DataFrame, group: list[str], order: list, value: str, out: str = "number") -> DataFrame:
    """Adds out: an item's own whole number where it has one, else one more than the item before; the first is 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rn = F.row_number().over(w)
    items = items.withColumn("_rn", rn)
    stated = F.col(value)
    last = F.last(stated, ignorenulls=True).over(so_far)
    at = F.last(F.when(stated.isNotNull(), F.col("_rn")), ignorenulls=True).over(so_far)
    return items.withColumn(out, F.coalesce(last, F.lit(0)) + F.col("_rn") - F.coalesce(at, F.lit(0))).drop("_rn")


def renumber_all_ones(items: DataFrame, group: list[str], order: list, value: str, out: str = "number") -> DataFrame:
    """Lists of more than one item whose stated numbers are all 1 are numbered from 1; others keep theirs."""
    w = Window.partitionBy(*group)
    ones = (F.min(value).over(w) == 1) & (F.max(value).over(w) == 1) & (F.count("*").over(w) > 1)
    return items.withColumn(out, F.when(F.coalesce(ones, F.lit(False)), F.row_number().over(w.orderBy(*order))).otherwise(F.col(value)))


def keep_item(ordered: Column, text: Column, value: Column, has_media: Column) -> Column:
    """False for items of ordered lists without text, media or a number."""
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{00A0}]+", "") == ""
    return ~(ordered & blank(text) & ~has_media & blank(value))
