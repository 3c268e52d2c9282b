"""What leaves the engine: files, archives, sidecars and the status of jobs, as columns and rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def html_file(html: Column) -> Column:
    """The bytes of a page: UTF-8 with its mark."""
    return F.concat(F.unhex(F.lit("EFBBBF")), F.encode(html, "UTF-8"))


def sidecar(name: Column, path: Column, metadata: Column) -> Column:
    """JSON of a page's name, path and metadata; absent values are left out."""
    return F.to_json(F.struct(name.alias("name"), path.alias("path"), metadata.alias("metadata")))


def archive_name(at: Column) -> Column:
    return F.concat(F.lit("cleaned_"), F.date_format(at, "yyyyMMdd_HHmm"), F.lit(".zip"))


def archives(files: DataFrame, doc: str) -> DataFrame:
    """(doc, archive, n): a ZIP of each document's files(doc, path, content, ord); of equal paths the last by ord. Archives without files hold a note."""
    kept = files.groupBy(doc, "path").agg(F.max_by("content", "ord").alias("content"))
    kept = files.select(doc).distinct().join(kept.where("path is not null"), doc, "left")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["path"].notna()].sort_values("path")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                z.writestr(zipfile.ZipInfo(path), bytes(content or b""), zipfile.ZIP_DEFLATED)
            if rows.empty:
                z.writestr(zipfile.ZipInfo("README.txt"), "No pages were found.")
        return pd.DataFrame({"archive": [out.getvalue()], "n": [len(rows)]})

    return kept.groupBy(doc).applyInPandas(lambda key, rows: pack(rows).assign(**{doc: key[0]})[[doc, "archive", "n"]], f"`{doc}` {dict(files.dtypes)[doc]}, archive binary, n long")


def status(error: Column, supported: Column, output: Column) -> Column:
    """unsupported, error, success or working."""
    return F.when(~supported, "unsupported").when(error.isNotNull(), "error").when(output.isNotNull(), "success").otherwise("working")


def summary(jobs: DataFrame, state: str) -> DataFrame:
    return jobs.groupBy(state).agg(F.count("*").alias("n"))


def failures(jobs: DataFrame, state: str) -> DataFrame:
    return jobs.where(F.col(state).isin("error", "unsupported"))


def register(spark: SparkSession) -> list[str]:
    """SQL functions for use in spark.sql(); they stay in code generation. Returns their names."""
    made = {
        "leaf_escape(s STRING) RETURNS STRING": "replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')",
        "leaf_plain_spaces(s STRING) RETURNS STRING": "regexp_replace(s, '(?i)&nbsp;|\\\\x{00A0}', ' ')",
        "leaf_links(s STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(s, '(?i)\\\\b(?:src|href)=\"([^\"]*)\"', 1)",
        "leaf_tokens(s STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(s, '(?s)<!--.*?-->|<!.*?>|</?[A-Za-z][^>]*>|[^<]+|<', 0)",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
