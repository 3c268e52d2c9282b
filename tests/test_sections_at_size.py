"""Sections of many lines: metadata is made when asked for, lines are scored once, bytes without text are passed over."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import lines as L
from leafmill.operators import blocks
from leafmill.plans import import_queries, importers
from leafmill.sources import binary

DATA = "/root/testdata/sf0.001"
WORDS = ["Kind of lines", "hash= 12 a b", "HASH= 12 a b", "haſh= 12 a b", "provider=x yz 12", "PAGETITLE ab 12", "pagetitİe ab 12", "localId 3 abc", "at 10:15 we met", "10:15", "310:15 and so", "3 March 2020", "on 3  March 20201 x", "13 May 2020 obj", "a IDAT b c", "xidaty abc", "%pdf abc def", "Calibri Light", "calibri", "<b>bold 12</b>", "a,b.c;d:e 12", "a***b 12 ee", "ééé abc ea", "a é b e 1", "ABCDE1!", "no vwls 12", "one o", "rhythm e", "rhythm", "a  b 1 2 ee", "|a|b|", "- item one", "1. item one", "# Head line", "Label one:", "YWJjZGVmZ2hp", "Jon Smith", "Page One", "object one", "a file.PDF here", "see x.docx", "pac\u212aage", "icoN", "a" * 181, "ab", "", " ", "abc def " * 20, "12,13;14 15", "!!! 12 ae", "a_b-c/d(e) 1"]


def _rows(spark):
    r = random.Random(5)
    made = ["".join(r.choices("aeE bcd19 .:;|-é*#\t", k=r.randint(1, 30))) for _ in range(400)]
    return spark.createDataFrame([(x,) for x in [*WORDS, *made, None]], "v string")


def _differ(spark, a, b):
    return [r["v"] for r in _rows(spark).select("v", a.alias("a"), b.alias("b")).collect() if r["a"] != r["b"]]


def test_likely_content_stays(spark):
    v = F.col("v")
    ok = F.length(v).between(4, 180) & v.rlike("[A-Za-z0-9]") & (~v.rlike(L._NAMES) | v.rlike("(?i)page"))
    for pattern in L._NO_CONTENT:
        ok &= ~v.rlike(pattern)
    (known, least), (letters, some) = L._SHARES.items()
    ok &= (L._share(v, known) >= least) & (v.rlike(L._DIGITS) | (L._share(v, letters) >= some) & v.rlike("[A-Za-z]{3,}"))
    spoken = (F.length(F.regexp_replace(v, "[^AEIOUaeiou]", "")) >= 2) & (v.rlike(r"\s") | (F.length(v) <= 16))
    old = F.coalesce(ok & (v.rlike(L._CLOCK) | v.rlike(L._DAY) | spoken), F.lit(False))
    old = F.when(F.length(v) > 0, old)
    assert _differ(spark, F.when(F.length(v) > 0, L.is_preview(v)), old) == []
    assert 40 < _rows(spark).where(old).count() < 400


def test_scores_stay(spark):
    v = L.strip(F.col("v"))
    points = (*L._POINTS, ("|".join(f"(?:{p})" for p in L._BINARY), -3))
    score = sum((F.when(v.rlike(pattern), n).otherwise(0) for pattern, n in points), F.lit(0))
    old = F.when(v == "", None).when(L._starts_block(v), 4).otherwise(score)
    assert _differ(spark, L.line_score(F.col("v")), old) == [] and _differ(spark, L.line_score(v, True), old) == []


def test_hints_stay(spark):
    records = _rows(spark).select(F.monotonically_increasing_id().alias("k"), F.lit("wide").alias("encoding"), F.col("v").alias("value"), F.lit(0).alias("rec_start"))
    old = r"(?i)(attachment|embedded file|embedded object|object|ole|package|icon)|\b[^<>:\"/\\|?*\s]+\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|txt|csv|rtf)\b"
    want = sorted(r["value"] for r in records.where(F.col("value").rlike(old)).collect())
    assert sorted(r["hints"][0] for r in importers.placeholder_hints(records, "k").collect()) == want and len(want) == 4


@pytest.mark.parametrize("kind", ["u1", "<u2"])
def test_runs_are_those_of_every_unit(kind):
    r = random.Random(3)
    for n in range(400):
        units = np.array(r.choices(r.choice([[0x20, 0x7E, 0x61, 0x1F, 0x7F], [0, 1, 0x61], [0x61], [0, 0xFF, 0x41]]), k=r.randint(0, 50)), kind)
        text = "".join("x" if 0x20 <= u <= 0x7E else "." for u in units.tolist())
        assert binary._runs(units).tolist() == [list(m.span()) for m in re.finditer("x{4,}", text)]
    assert binary._runs(np.array([0x6100, 0x61FF, 0xFF61, 0x7F00] * 3, "<u2")).tolist() == []


def test_files_are_found_behind_others(spark):
    files = {k: k + b"x" * 70 + end for k, end in {b"\x89PNG\r\n\x1a\n": b"IEND1234", b"\xff\xd8": b"\xff\xd9", b"GIF89a": b"\x3b", b"%PDF": b"%%EOF\r\n"}.items()}
    rows = [(i, binary.SECTION + b"\xff" * (i % 3) + f + b"\xff" * (i % 2)) for i, f in enumerate([*files.values(), b"\xd8", b"none"])]
    got = binary.section_parts(spark.createDataFrame(rows, "id int, content binary").coalesce(1), "id", "content").where("kind is not null").collect()
    assert sorted((r["id"], bytes(r["file"])) for r in got) == [(i, x[-1]) for i, d in rows for x in binary.carve(d)] and len(got) == 4


def test_pages_make_no_metadata_unless_asked(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("metadata is not asked for")

    monkeypatch.setattr(blocks, "page_metadata", unwanted)
    pages = importers.sections(import_queries._section_files(spark, DATA).where("l_orderkey < 40"), "l_orderkey", "content", "file")["pages"]
    assert "modified|updated" not in pages.select("l_orderkey", "title", "n_lines")._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["metadata"]["title"] == r["title"] and r["title"] in r["html"] for r in pages.collect())


def test_lines_are_scored_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(L, "line_score", lambda *a, score=L.line_score: asked.append(a) or score(*a))
    made = importers.sections(import_queries._section_files(spark, DATA).where("l_orderkey < 40"), "l_orderkey", "content", "file")
    plans = [made[name]._jdf.queryExecution().optimizedPlan().toString() for name in ("pages", "notices")]
    assert len(asked) == 1 and not any("IHDR" in p for p in plans)


def test_notices_gather_lines_of_pages_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(importers, "kept", lambda df, keep=importers.kept: tables.append(df.columns) or keep(df))
    titles = "\1".join(["Page one of 12", "PageTitle", "Title: Some other title of it 12", "Title: Yet another title of it 12", "Author: Someone of the team", "see the object 12"])
    rows = [(1, "a.one", binary.SECTION + f"\1{titles}\1".encode("utf-16le")), (2, "b.one", binary.SECTION), (3, "c.one", b"none")]
    made = importers.sections(spark.createDataFrame(rows, "k long, file string, content binary"), "k", "content", "file")
    notices = made["notices"]
    assert not any("conflicts" in t or "known" in t for t in tables)
    plan = notices._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(CASE WHEN") + plan.count("collect_list(_said") == 1 and "Join FullOuter" not in plan
    got = {r["k"]: (r["notices"] and [n["message"] for n in r["notices"]], r["error"]) for r in notices.collect()}
    assert got[1][0][1:4] == ["1 pages from 1 titles.", "4 lines in the pool, 0 left out, used on 0 pages.", "2 conflicts of metadata, 1 replaced by priority."] and got[1][0][5] == "1 hints of embedded objects."
    assert got[2][0][1:3] == ["1 pages from 0 titles.", "0 lines in the pool, 0 left out, used on 1 pages."] and got[3] == (None, "no section signature")
    assert sorted(tuple(r)[2:] for r in made["conflicts"].collect()) == [(0, "title", "Page one of 12", "Some other title of it 12", "hint", "line-key-value", "replaced-by-priority"), (1, "title", "Some other title of it 12", "Yet another title of it 12", "line-key-value", "line-key-value", "kept-existing")]
