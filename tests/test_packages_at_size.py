"""Packages are read in columns, their titles by one shuffle, and what is not asked for is not kept."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import lines as L
from leafmill.functions import text
from leafmill.plans import import_queries, importers
from leafmill.sources import binary


def _found(docs):
    of, encodings, values, starts, ends = binary._all_strings([memoryview(d) for d in docs])
    return sorted(zip(of.tolist(), encodings.to_pylist(), values.to_pylist(), starts.tolist(), ends.tolist(), strict=True))


def test_strings_of_documents_together_are_those_of_each():
    r = random.Random(7)
    for _ in range(500):
        docs = [bytes(r.choices(r.choice([b"ab ", b"ab \0", b"a\0b\0 \0\1\0", b"\xff~ \0"]), k=r.randint(0, 40))) for _ in range(r.randint(1, 8))]
        assert _found(docs) == sorted((i, *row) for i, d in enumerate(docs) for row in binary.strings(d))


def test_sections_and_others_in_one_batch(spark):
    page = binary.SECTION + "\1My page title\1".encode("utf-16le") + b"\x89PNG\r\n\x1a\n" + b"x" * 60 + b"IEND1234"
    rows = [(1, page), (2, b"none"), (3, None), (4, binary.SECTION), (5, page + b"!")]
    got = binary.section_parts(spark.createDataFrame(rows, "id int, content binary").coalesce(1), "id", "content").collect()
    assert sorted((r["id"], r["size"]) for r in got if r["encoding"] is None and r["kind"] is None) == [(1, len(page)), (2, None), (3, None), (4, 16), (5, len(page) + 1)]
    assert sorted((r["id"], r["encoding"], r["value"], r["start"], r["end"]) for r in got if r["encoding"]) == sorted((i, *x) for i, d in rows if i in (1, 4, 5) for x in binary.strings(d))
    assert sorted((r["id"], r["kind"], r["extension"], r["name"], r["mime"], r["start"], bytes(r["file"])) for r in got if r["kind"]) == [(i, *x) for i, d in rows if i in (1, 5) for x in binary.carve(d)]


def test_spans_of_sections_take_one_shuffle(spark):
    parts = spark.createDataFrame([(1, "a", 100, None, None, None), (1, "a", None, "wide", "Page one 1", 20), (1, "a", None, "wide", "PageTitle", 40), (1, "a", None, "ascii", "Page two 2", 60), (2, "b", 50, None, None, None), (2, "b", None, "ascii", "Page two 2", 20), (3, "c", None, None, None, None)], "k int, _section string, size long, encoding string, value string, start long")
    spans = importers.section_spans(parts, "k")
    assert spans._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, spans.select("k", "_section", "page", "title", "titled", "seg_start", "seg_end").collect())) == [(1, "a", 1, "Page one 1", True, 0, 100), (2, "b", 1, "Page 1", False, 0, 50)]


def test_notices_keep_entries_and_titles_only(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(importers, "kept", lambda df, keep=importers.kept: tables.append(df.columns) or keep(df))
    files = import_queries._package_files(spark, "/root/testdata/sf0.001").where("o_orderkey in (3, 4)").unionByName(spark.createDataFrame([(5, "x.onepkg", b"none")], "o_orderkey long, file string, content binary"))
    got = {r["o_orderkey"]: r for r in importers.packages(files, "o_orderkey", "content", "file")["notices"].collect()}
    assert [t for t in tables if "value" in t or "seg_start" in t] == [] and len(tables) == 2
    assert [n["message"] for n in got[3]["notices"]] == ["4 entries in 1 folders.", "3 sections, 3 pages.", "0 sections read.", "0/1 folders decoded.", "Not decoded: lzx", "Placeholders stand for sections of compression lzx", "A decoder of LZX is needed for these sections."]
    assert got[4]["error"] is None and (got[5]["notices"], got[5]["error"]) == (None, "fatal: no cabinet")


@pytest.mark.parametrize("value", ["a CALIBRI 1", "x HASH= y z", "my localid 3", "resolutionid", "a page title 2", "pagetitle", "Calibr", "provider = x"])
def test_words_of_no_title_are_found_in_any_case(spark, value):
    found = spark.createDataFrame([(value,)], "v string").select(L.is_title(F.col("v"))).first()[0]
    assert found == (not re.search(f"(?i){L.INTERNAL}|Calibri", value))


def test_paths_of_entries(spark):
    paths = ["a", "\\a\\\\b\\", "/a//b", "a/b/", "//", "", None, "a\\b.one"]
    got = spark.createDataFrame(list(enumerate(paths)), "i int, p string").select("i", text.entry_path(F.col("p")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == ["a", "a/b", "a/b", "a/b", "", "", None, "a/b.one"]


def test_pools_are_read_for_pages_without_lines(spark):
    spans = spark.createDataFrame([(1, 1, "T1", 0, 50), (1, 2, "T2", 60, 90), (2, 1, "T3", 0, 50)], "k int, page int, title string, seg_start long, seg_end long")
    line = "Some content of line {} in the page"
    records = spark.createDataFrame([(1, "wide", line.format(11), 5, 20), (1, "wide", line.format(12), 21, 40), (1, "ascii", line.format(11), 41, 45), (2, "wide", line.format(13), 5, 20)], "k int, encoding string, value string, rec_start long, rec_end long")
    lines, sizes = importers.section_lines(spans, records, "k")
    first, second = line.format(11), line.format(12)
    assert sorted(map(tuple, lines.collect())) == [(1, 1, 1, first, False), (1, 1, 2, second, False), (1, 2, 1, first, True), (1, 2, 2, second, True), (2, 1, 1, line.format(13), False)]
    assert sorted(map(tuple, sizes().collect())) == [(1, 2, 0), (2, 1, 0)]


def test_joins_of_packages_carry_paths_not_names(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(importers, "kept", lambda df, keep=importers.kept: tables.append(df.columns) or keep(df))
    files = import_queries._package_files(spark, "/root/testdata/sf0.001").where("o_orderkey = 4")
    got = importers.packages(files, "o_orderkey", "content", "file")["pages"].select("section", "path", F.col("metadata")["sectionPath"].alias("at")).collect()
    assert not any({"names", "folders"} & set(t) for t in tables)
    assert sorted(map(tuple, got)) == [("Bad", "Book 4/Work/Plans/Bad/Bad.html", "Book 4/Work/Plans/Bad"), ("One 4", "Book 4/Work/Plans/One 4/Page of order 4.html", "Book 4/Work/Plans/One 4"), ("Two", "Book 4/Work/Two/Page of order 4.html", "Book 4/Work/Two")]
