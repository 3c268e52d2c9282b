"""Elements, attributes, selectors and cleaning of markup that leaves end tags out, quotes signs, or lacks a head."""

import pytest

from leafmill.operators import markup, nodes, pages, tree
from leafmill.plans.cleaning import clean_pages, profile


def rows_of(spark, *htmls):
    return nodes.nodes(spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "id int, html string"), "html")


def cleaned(spark, html, **changes):
    p = profile("generic", css=None, doctype=False, **changes)
    return clean_pages(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html", p).first()["output"]


HEAD = '<head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1.0"><title>Document</title></head>'


@pytest.mark.parametrize(
    "html, want",
    [
        ("<ul><li>a<li>b</ul>c", [(0, "ul", -1, 5), (1, "li", 0, 2), (3, "li", 0, 4)]),
        ("<p>a<div>b</p>c</div>", [(0, "p", -1, 1), (2, "div", -1, 6)]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", [(0, "table", -1, 9), (1, "tr", 0, 5), (2, "td", 1, 3), (4, "td", 1, 5), (6, "tr", 0, 8), (7, "td", 6, 8)]),
        ("<td><div></td></div>x", [(0, "td", -1, 2), (1, "div", 0, 1)]),
        ("<li>a<ol><li>b</ol>c<li>d", [(0, "li", -1, 6), (2, "ol", 0, 5), (3, "li", 2, 4), (7, "li", -1, 8)]),
        ("<b>a</i></b>", [(0, "b", -1, 3)]),
        ("<script>if (a<b) '</p>'</script><p>x", [(0, "script", -1, 4), (5, "p", -1, 6)]),
        ("<head><title>t</title><p>x", [(0, "head", -1, 3), (1, "title", 0, 3), (4, "p", -1, 5)]),
        ('<p title="a>b">x</p>', [(0, "p", -1, 2)]),
    ],
)
def test_elements(spark, html, want):
    got = rows_of(spark, html).where("kind = 'open'").orderBy("pos").collect()
    assert [(r["pos"], r["name"], r["parent"], r["end"]) for r in got] == want


def test_attributes(spark):
    row = rows_of(spark, "<li title=\"a value=7 b\" VALUE = 'x>\"y' checked class=a/b data-e=\"\">").select("attrs", nodes.get(nodes.F.col("attrs"), "value").alias("v"), nodes.get(nodes.F.col("attrs"), "checked").alias("c"), nodes.get(nodes.F.col("attrs"), "none").alias("n")).first()
    assert [(a["name"], a["value"]) for a in row["attrs"]] == [("title", "a value=7 b"), ("value", 'x>"y'), ("checked", None), ("class", "a/b"), ("data-e", "")]
    assert (row["v"], row["c"], row["n"]) == ('x>"y', "", None)
    rows = rows_of(spark, "<br/>", '<img src=x value="1" />', None, "")
    made = nodes.set_attrs(rows, nodes.F.lit(True), nodes.put(nodes.F.col("attrs"), "value", nodes.F.lit('"')))
    assert [r["html"] for r in nodes.serialise(made, "id").orderBy("id").collect()] == ['<br value="&quot;"/>', '<img src=x value="&quot;"/>', "", ""]


def test_selectors(spark):
    html = '<div class="a b" id="i"><p data-x="1">t<span class=c>u</span></p></div><p class="b">v</p>'
    for selector, want in {"p": 2, ".b": 2, "div > p": 1, "div > span": 0, "div span": 1, "#i.a p, p.b": 2, "[data-x='1']": 1, "div > p > span.c": 1, "*": 4}.items():
        assert nodes.select(rows_of(spark, html), selector, "hit").where("hit").count() == want
    for bad in ("", "p:first-child", "> p", "p ~ p"):
        with pytest.raises(ValueError):
            nodes.select(rows_of(spark, html), bad, "hit")


def test_nothing_is_lost(spark):
    assert cleaned(spark, "<html><body><ol><li>a<li></ol><hr></body></html>", list_padding="1em") == f'<html>{HEAD}<body><ol style="margin-left: 0; padding-left: 1em"><li value="1">a</ol><hr></body></html>'
    assert cleaned(spark, '<html><head><title>x</title><body><p title="a>b">c', repair_lists=None) == f'<html>{HEAD.replace("<title>Document</title></head>", "")}'.replace('<meta charset="utf-8">', '<meta charset="utf-8"><title>x</title>') + '</head><body><p title="a>b">c'
    assert cleaned(spark, '<ol><li title="a value=7 b">x</ol>', indent_all=False) == f'<html>{HEAD}<ol><li title="a value=7 b" value="1">x</ol></html>'
    assert '<p title="a>b" style="font-size: 12px" class="text-xs">' in cleaned(spark, '<p title="a>b" style="font-size:12px">', migrate_styles=True)


def test_pages_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "<b><p>aaa"), (1, "<b>bbb</b>"), (None, "<i>x"), (None, None)], "id int, html string")
    got = sorted(r["output"].partition("</head>")[2] for r in clean_pages(df, "id", "html", profile("generic")).collect())
    assert got == ["</html>", "<b><p>aaa</html>", "<b>bbb</b></html>", "<i>x</html>"]


def test_head_without_end_keeps_the_page(spark):
    df = spark.createDataFrame([(1, "<!DOCTYPE html>\n<html><head><title>x</title>İ<p>y")], "id int, html string")
    got = pages.clean_head(df, "html", css="c.css").first()
    assert got["output"] == '<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>x</title>İ<meta name="viewport" content="width=device-width, initial-scale=1.0"><link rel="stylesheet" href="c.css"></head><p>y'
    assert [(x["step"], x["n"]) for x in got["logs"]] == [("EnsureCharset", 1), ("EnsureViewport", 1), ("InjectCss", 1)]


def test_dates_take_own_paragraphs_and_styles(spark):
    html = '<div><section><p>3 May 2024</p><p>10:30</p></section><p>4 May 2024</p><p style="color:red">11:30</p><p>5 May 2024</p><p>12:30</p></div>'
    got = nodes.serialise(tree.merge_date_rows(rows_of(spark, html)), "id").first()["html"]
    assert got == '<div><section><p>3 May 2024</p><p>10:30</p></section><p>4 May 2024<span class="created-time" style="color:red; margin-left: 0.75em">11:30</span></p><p>5 May 2024</p><p>12:30</p></div>'


def test_rows_of_heads_do_not_count(spark):
    html = "<table><thead><tr><th>Notes<th>Cue</thead><tbody><tr><td>a<td>b</table>"
    assert nodes.serialise(tree.tag_cornell(rows_of(spark, html)), "id").first()["html"] == '<table class="cornell-table"><thead><tr><th>Notes<th>Cue</thead><tbody><tr><td class="cues">a<td class="notes">b</table>'


def test_styles_keep_names_and_what_has_no_class(spark):
    html = '<p style="FONT-size:large; Font-Weight:bold;x:y">a</p>'
    assert nodes.serialise(tree.migrate_styles(rows_of(spark, html), True), "id").first()["html"] == '<p style="FONT-size: large; x: y" class="font-bold">a</p>'


def test_merged_lists(spark):
    html = '<td><ol type="a"><li>1<li>2</ol>x<ol><li>3<ol><li>4</ol></ol><td><ol><li>5</ol></td>'
    got = tree.merge_lists(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "html", "n").orderBy("id").collect()
    assert [(r["html"], r["n"]) for r in got] == [('<td>x<ol type="a"><li>1<li>2<li>3<ol><li>4</ol><li>4</ol><td><ol><li>5</ol></td>', 1), ("", 0)]
    assert "mergeStyled.mergedCount" in {x["step"] for x in clean_pages(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html", profile("generic", repair_lists="mergeStyled")).first()["logs"]}


def test_long_lists_are_unwrapped(spark):
    html = "<ul>\n<ol>" + "<li>a</li> " * 20_000 + "</ol></ul>"
    assert spark.createDataFrame([(html,)], "html string").select(markup.unwrap_lists(nodes.F.col("html")).alias("h")).first()["h"] == html[5:-5]
