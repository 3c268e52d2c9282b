"""Blocks, importers, sinks and registered functions on small inputs."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from leafmill.functions import legacy, notices
from leafmill.operators import blocks
from leafmill.plans import cleaning, importers
from leafmill.sources import binary, sinks


def test_blocks_and_pages(spark):
    text = ["## Head", "", "a b", "c d", "- one", "- two", "", "| x | y |", "| --- | --- |", "| 1 |  2 | 3 |"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc int, pos int, line string")
    made = blocks.blocks(df, "doc", "pos", "line")
    html = {r["kind"]: r["h"] for r in made.withColumn("h", blocks.block_html()).collect()}
    assert html["heading"] == "<h2>Head</h2>" and html["paragraph"] == "<p>a b c d</p>" and html["ul"] == "<ul><li>one</li><li>two</li></ul>"
    assert html["table"].startswith("<table><thead><tr><th>x</th><th>y</th><th></th></tr></thead>") and "<td>3</td>" in html["table"]
    page = blocks.pages(made, "doc", spark.createDataFrame([(1, "T&"), (2, "none")], "doc int, title string")).collect()
    assert any("<h1>T&amp;</h1><h2>Head</h2>" in r["html"] for r in page) and any("No readable text" in r["html"] for r in page)


def test_tables_are_folded(spark):
    def made(*text):
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc int, pos int, line string")
        return [(r["kind"], r["rows"] or r["items"], r["headed"]) for r in blocks.blocks(df, "doc", "pos", "line").orderBy("block").collect()]

    two, three, four, five = "a | b |", "a | b | c", "a | b | c | d", "a | b | c | d | e"
    assert [len(rows) for _, rows, _ in made(two, three, four, five)] == [2, 2]  # widths are compared with the first row's
    assert made(two, "| --- | --- |", "x  y")[0] == ("table", [["a", "b"]], True)
    assert [k[1] for k in made(two, two, "x\ty")] == [[["a", "b"], ["a", "b"], ["x", "y"]]]  # two rows hold another delimiter
    assert [k[1] for k in made(two, "x\ty")] == [[["a", "b"]], [["x", "y"]]]
    assert made("| --- | --- |", two, "| --- | --- | --- |")[0][1] == [["a", "b", ""], ["---", "---", "---"]]
    assert [k[:2] for k in made("one", "- x", "goes on", None, "- y", "Other.", "New one")] == [("ul", ["x"]), ("paragraph", ["one", "goes on"]), ("ul", ["y"]), ("paragraph", ["Other."]), ("paragraph", ["New one"])]


def test_metadata(spark):
    text = ["at 3 May 2024 10:30 by me", "Author:Ann", None, "created at: 4 May 2024", "Author - Bob", "Author: Ann", "Title: T", "modified 5 May 2024"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, "none")], "doc int, pos int, line string")
    made = blocks.page_metadata(df, "doc", "pos", "line", spark.createDataFrame([(1, "Hint"), (3, " "), (4, "Alone")], "doc int, title string"))
    got = {(r["doc"], r["key"]): (r["value"], r["source"]) for r in blocks.metadata_values(made, "doc").collect()}
    assert got == {(1, "author"): ("Ann", "line-key-value"), (1, "createdAt"): ("2024-05-04T00:00:00.000Z", "line-key-value"), (1, "title"): ("T", "line-key-value"), (1, "modifiedAt"): ("modified 5 May 2024", "line-heuristic"), (4, "title"): ("Alone", "hint")}
    wrong = [(r["key"], r["existing"], r["incoming"], r["existing_source"], r["resolution"]) for r in blocks.metadata_conflicts(made, "doc").orderBy("nth").collect()]
    assert wrong == [
        ("createdAt", "at 3 May 2024 10:30 by me", "2024-05-04T00:00:00.000Z", "line-heuristic", "replaced-by-priority"),
        ("author", "Ann", "Bob", "line-key-value", "kept-existing"), ("title", "Hint", "T", "hint", "replaced-by-priority"),
    ]
    assert [x["label"] for x in made.where("doc = 1").first()["items"]] == ["Title", "Created", "Modified", "Author", "Detected date", "Detected time", "Detected date", "Detected date"]


def section(*wide, ascii=b""):
    return bytearray(binary.SECTION + b"\0\0" + "\u0001".join(wide).encode("utf-16le") + b"\0\0" + ascii)


def test_section_and_package(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 80 + b"IEND1234"
    one = section("My page title", "PageTitle", "Some content line of the page", "Author: Ann Bee", "see the attachment plan.pdf", ascii=b"single bytes are content too\0" + png)
    files = spark.createDataFrame([("a#b", one, "Work #1.one"), ("other", bytearray(b"other"), None), ("bare", section("x" * 100 + " words of text"), "B.one"), ("none", section(), "N.one")], "id string, content binary, file string")
    out = importers.sections(files, "id", "content", "file")
    pages = {r["id"]: r for r in out["pages"].collect()}
    assert set(pages) == {"a#b", "bare", "none"} and (pages["a#b"]["title"], pages["a#b"]["path"], pages["a#b"]["metadata"]["author"]) == ("My page title", "Work #1/My page title.html", "Ann Bee")
    html = pages["a#b"]["html"]
    assert "Some content line of the page" in html and "single bytes are content too" in html and "<dt>Author</dt><dd>Ann Bee</dd>" in html and '<img src="_resources/image-01.png"' in html and "<li>see the attachment plan.pdf</li>" in html
    assert (pages["none"]["title"], pages["none"]["n_lines"], pages["none"]["fallback"]) == ("Page 1", 0, True) and importers.NO_TEXT in pages["none"]["html"] and pages["bare"]["n_lines"] == 1
    told = {r["id"]: r for r in out["notices"].collect()}
    assert len(told["a#b"]["notices"]) == 6 and told["a#b"]["notices"][4]["context"] == {"images": "1", "attachments": "0"} and told["other"]["error"] and told["other"]["notices"] is None
    assert {r["path"] for r in out["resources"].collect()} == {"Work #1/_resources/image-01.png"} and out["conflicts"].count() == 0
    got = importers.packages(files, "id", "content")
    assert all(r["error"] and r["notices"] is None for r in got["notices"].collect()) and got["pages"].count() == 0
    tree = importers.nested(out["hierarchy"].where("id = 'a#b'"), "id").collect()
    assert [json.loads(r["json"]) for r in tree] == [{"kind": "section", "name": "Work #1", "path": "Work #1/", "children": [{"kind": "page", "name": "My page title", "path": "Work #1/My page title.html", "children": []}]}]
    assert importers.nested(out["hierarchy"].where("false"), "id").count() == 0


def test_archives(spark):
    files = spark.createDataFrame([(1, "a.html", bytearray(b"old"), 0), (1, "a.html", bytearray(b"new"), 1), (2, None, None, 0)], "id int, path string, content binary, ord int")
    got = {r["id"]: r for r in sinks.archives(files, "id").collect()}
    assert zipfile.ZipFile(io.BytesIO(got[1]["archive"])).read("a.html") == b"new" and got[1]["n"] == 1
    assert zipfile.ZipFile(io.BytesIO(got[2]["archive"])).namelist() == ["README.txt"]


def test_columns(spark):
    row = spark.range(1).select(
        sinks.html_file(F.lit("é")).alias("file"), sinks.sidecar(F.lit("a"), F.lit("p"), F.struct(F.lit(None).cast("string").alias("author"), F.lit("t").alias("title"))).alias("json"),
        sinks.archive_name(F.lit("2024-05-03 10:30:00").cast("timestamp")).alias("zip"), sinks.status(F.lit(None).cast("string"), F.lit(True), F.lit("x")).alias("state"),
        notices.messages(F.array(notices.notice("ONEPKG_NO_FOLDER_DECODE", F.lit("m")), notices.notice("X", F.lit("")))).alias("m"), legacy.narrow_spaces(F.lit("a  b\n\n\nc")).alias("s"),
        legacy.rebuild_head(F.lit("<html><head><title>T</title><style>x</style></head><body></body></html>"), "c.css").alias("head"),
    ).first()
    assert bytes(row["file"]) == b"\xef\xbb\xbf\xc3\xa9" and row["json"] == '{"name":"a","path":"p","metadata":{"title":"t"}}' and row["zip"] == "cleaned_20240503_1030.zip"
    assert row["state"] == "success" and row["m"] == ["m"] and row["s"] == "a b\nc" and "<title>T</title><link" in row["head"] and "style>" not in row["head"]
    assert "leaf_links" in sinks.register(spark)
    assert spark.sql("SELECT leaf_links('<a href=\"x\">') AS l, leaf_escape('<&') AS e").first() == (["x"], "&lt;&amp;")


def test_cleaning_profiles(spark):
    df = spark.createDataFrame([(1, "<html><body><table><tr><td>Cues</td><td>Notes</td></tr><tr><td><ol><li>a</li><li> </li></ol></td><td>x</td></tr></table></body></html>"), (2, None)], "id int, html string")
    got = {r["id"]: r["output"] for r in cleaning.clean_pages(df, "id", "html").collect()}
    assert 'class="cornell-table"' in got[1] and '<li value="1">a</li></ol>' in got[1] and "list-decimal list-outside pl-5" in got[1] and "<title>Document</title>" in got[2]
    plain = {r["id"]: r["output"] for r in cleaning.clean_pages(df, "id", "html", cleaning.profile("generic")).collect()}
    assert "cornell-table" not in plain[1] and cleaning.profile("unknown") == cleaning.PROFILES["cornell"]
