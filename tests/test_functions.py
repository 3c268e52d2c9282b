from pyspark.sql import functions as F

from leafmill.functions import css, lines, text
from leafmill.operators import lists, lookups, markup, segments


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first()["x"]


def many(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    assert many(spark, text.collapse, ["  a \t b ", ""]) == ["a b", ""]
    assert many(spark, text.decode_quoted_printable, ["caf=C3=A9 a+b 100%% x=3Dy", "so=\r\nft"]) == ["café a+b 100%% x=y", "soft"]
    assert many(spark, text.folder_safe, ['a<b>:"c', None, "  "]) == ["a_b___c", "item", "item"]
    assert many(spark, text.base_name, ["x/y.tar.gz", None, ".one"]) == ["x/y.tar", "input", "input"]
    assert many(spark, text.pad_base64, ["YQ", "YWI=", "YW\r\nJj"]) == ["YQ==", "YWI=", "YWJj"]
    assert many(spark, text.entry_path, ["\\a\\\\b/", "/x//y"]) == ["a/b", "x/y"]


def test_css(spark):
    assert many(spark, css.px, ["12pt", "1.5em", " 10PX ", "3in", "5%", "-.5"]) == [16.0, 24.0, 10.0, None, None, -0.5]
    style = lambda f: lambda v: css.style_text(f(css.declarations(v)))
    assert many(spark, style(css.remove_keys), ["Margin-Left: 3px;color:red; bad ;x:url(a:b)", None]) == ["color: red; x: url(a:b)", ""]
    assert many(spark, style(lambda e: css.upsert(e, "a", "1")), ["a: 0; b: 2"]) == ["b: 2; a: 1"]
    assert many(spark, lambda v: css.excess_indent(css.declarations(v)), ["margin-left: -18pt", "margin-left: 17pt", "mso-list: x"]) == [True, False, True]
    assert many(spark, css.list_type, ["LIST-STYLE-TYPE : Lower-Roman; x", "list-style-type: disc"]) == ["i", None]


def test_lines(spark):
    assert many(spark, lines.is_title, ["Plan 2024", "Two Words", "Two Page", "abc", "naïve text 1"]) == [True, False, True, False, False]
    assert many(spark, lines.heading_level, ["## x", "Summary:", "#### x", "x:"]) == [2, 2, None, None]
    got = many(spark, lines.cells, ["a\tb", "|a|b|", "a | b", "a  b1", "one two", "| --- | :--: |"])
    assert [r and (r["delimiter"], list(r["cells"])) for r in got] == [("tab", ["a", "b"]), ("pipe", ["a", "b"]), None, ("space", ["a", "b1"]), None, ("pipe", ["---", ":--:"])]
    assert many(spark, lines.metadata_date, ["2024-05-06T07:08:09Z", "05/06/2024", "6 May 2024", "soon"]) == ["2024-05-06T07:08:09.000Z", "05/06/2024", "2024-05-06T00:00:00.000Z", "soon"]
    assert many(spark, lines.is_time, ["10:30", "9:05:01 pm", "10"]) == [True, True, False]
    assert many(spark, lambda v: lines.joins_paragraph(F.lit("An end."), v), ["Next one", "and so", "- item"]) == [False, True, False]


def test_lists(spark):
    rows = spark.createDataFrame([("l", i, v) for i, v in enumerate([None, None, 5, None, None, 9, None])], "l string, i int, v int")
    assert [r["number"] for r in lists.renumber(rows, ["l"], ["i"], "v").orderBy("i").collect()] == [1, 2, 5, 6, 7, 9, 10]


def test_segments(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["Page one 1", "Page two 2", "x", "PageTitle", "PageTitle"])], "d int, i int, v string")
    assert [(r["marker_at"], r["title"]) for r in segments.best_titles(rows, "d", "i", "v").collect()] == [(3, "Page two 2")]


def test_lookups(spark):
    assert one(spark, lookups.candidates(F.col("r")), r="file:///a/My%20Pic.PNG?x=1")[:3] == ["file:///a/My%20Pic.PNG?x=1", "file:///a/My Pic.PNG?x=1", "a/My%20Pic.PNG?x=1"]
    refs = spark.createDataFrame([(1, "x/A.png"), (1, "cid:q"), (2, "x/A.png")], "d int, ref string")
    keys = spark.createDataFrame([(1, "a.png", "U1"), (1, "A.png", "U2"), (1, "cid:q", "U3")], "d int, key string, uri string")
    assert sorted((r["d"], r["ref"], r["uri"]) for r in lookups.resolve(refs, keys, "ref", ["d"]).collect()) == [(1, "cid:q", "U3"), (1, "x/A.png", "U2"), (2, "x/A.png", None)]


def test_markup(spark):
    assert many(spark, markup.unwrap_lists, ["<ul>\n<ol><li>a</li></ol></ul>"]) == ["<ol><li>a</li></ol>"]
    assert many(spark, markup.mail_residue, ["<p>x</p>", "MIME-Version: 1.0\n"]) == [False, True]
