"""Images in place of references: of mail messages, and of files beside pages."""

from pyspark.sql import functions as F

from leafmill.operators import images
from leafmill.sources import mail

MESSAGE = """MIME-Version: 1.0
Content-Type: multipart/related; boundary="b1"

--b1
Content-Type: text/html

<img SRC='/My%20Pic.PNG' src="x.png"><a href=PIC.png>a</a><img src="cid:one">
--b1
Content-Type: image/png
Content-Location: /My%20Pic.PNG

QUJD
--b1
Content-Type: image/gif
Content-Transfer-Encoding: base64
Content-ID: <one>
Content-Disposition: inline; filename=Pic.PNG

QUJDRA
--b1--
"""


def test_embedded_pages(spark):
    df = spark.createDataFrame([(1, MESSAGE), (2, MESSAGE.replace("%20Pic.PNG'", "%20Other.PNG'").replace("PIC.png", "none").replace("cid:one", "cid:two")), (3, None)], "id int, raw string")
    got = {r["id"]: r for r in mail.embedded_pages(df, "id", "raw").collect()}
    assert set(got) == {1, 2}
    assert got[1]["html"] == '<img src="data:image/png;base64,UVVKRA==" src="x.png"><a href="data:image/gif;base64,QUJDRA==">a</a><img src="data:image/gif;base64,QUJDRA==">'
    assert (got[1]["replaced"], got[1]["unmatched"]) == (3, []) and (got[2]["replaced"], got[2]["unmatched"]) == (0, ["/My%20Other.PNG", "cid:two", "none"])


def test_resolved_paths(spark):
    cases = {"a.png": "/w/x/a.png", "../a%20b.png?q#f": "/w/a b.png", "./p/../a.png": "/w/x/a.png", "/r/a.png": "/r/a.png", "../../../a.png": "/a.png", "sub\\a.png": "/w/x/sub/a.png", "http://h/a.png": None, "data:x": None, "": None, "file:///c/a.png": "/c/a.png"}
    df = spark.createDataFrame(list(cases), "string").select("value", images.resolved_path(F.lit("/w/x/page.html"), F.col("value")).alias("p"))
    assert {r["value"]: r["p"] for r in df.collect()} == cases


def test_images_of_files(spark, tmp_path):
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "a b.png").write_bytes(b"ABC")
    (tmp_path / "notes.txt").write_bytes(b"no image")
    html = '<img src="../pics/a%20b.png"><img src="../pics/missing.png"><img src="../notes.txt"><img src="http://host/pics/a%20b.png">'
    pages = spark.createDataFrame([(1, f"file:{tmp_path}/pages/p.html", html), (2, f"{tmp_path}/pages/q.html", "no images"), (3, None, None)], "id int, path string, html string")
    keys = images.from_files(pages, "id", "path", "html", str(tmp_path))
    assert [tuple(r) for r in keys.collect()] == [(1, "../pics/a%20b.png", "data:image/png;base64,QUJD")]
    got = {r["id"]: r for r in images.embed(pages, "id", "html", keys).collect()}
    assert got[1]["html"] == html.replace("../pics/a%20b.png", "data:image/png;base64,QUJD") and got[1]["replaced"] == 1
    assert (got[2]["html"], got[2]["unmatched"], got[3]["html"]) == ("no images", [], "")
