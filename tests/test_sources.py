import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.sources import binary, mail

MESSAGE = """MIME-Version: 1.0
Content-Type: multipart/related;
 boundary="b1"

preamble

--b1
Content-Type: text/html; charset="utf-8"
Content-Transfer-Encoding: quoted-printable
Content-Location: file:///C:/x/page.htm

<p>caf=C3=A9 so=
ft</p>
--b1
Content-Type: image/png
Content-Transfer-Encoding: base64
Content-Location: file:///C:/x/My%20Pic.PNG
Content-ID: <pic@1>

QUJD
REU
--b1--
"""


def test_mail(spark):
    df = spark.createDataFrame([(1, MESSAGE), (2, "no parts at all"), (3, None), (4, MESSAGE.replace("\n", "\r\n"))], "id long, raw string")
    parts = mail.parts(df, "id", "raw")
    got = {(r["id"], r["part"]): r for r in parts.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 0), (4, 1), (4, 2)}
    assert got[1, 1]["body"] == got[4, 1]["body"] == "<p>café soft</p>" and got[1, 2]["content_id"] == "pic@1"
    assert {r["id"]: r["html"] for r in mail.main_page(parts, "id").collect()} == {1: "<p>café soft</p>", 4: "<p>café soft</p>"}
    keys = {r["key"]: r["uri"] for r in mail.image_keys(parts.where("id = 1"), "id").collect()}
    assert keys["cid:pic@1"] == keys["my%20pic.png"] == "data:image/png;base64,QUJDREU="


def cab(kind, blocks, names, reserve=b""):
    data = b"".join(struct.pack("<IHH", 0, len(p), n) + p for p, n in blocks)
    head = struct.pack("<HBB", len(reserve), 0, 0) + reserve if reserve else b""
    folder_at = 36 + len(head)
    files_at = folder_at + 8
    files = b"".join(struct.pack("<IIHHHH", at, size, 0, 0, 0, 0) + n.encode() + b"\0" for n, size, at in names)
    start = files_at + len(files)
    top = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, start + len(data), 0, files_at, 0, 3, 1, 1, len(names), 4 if reserve else 0, 0, 0)
    return top + head + struct.pack("<IHH", start, len(blocks), kind) + files + data


def deflated(block, before=b""):
    c = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=before) if before else zlib.compressobj(9, zlib.DEFLATED, -15)
    return b"CK" + c.compress(block) + c.flush(), len(block)


def test_cabinets(spark):
    a, b = b"hello section " * 20, b"hello section again " * 9
    plain = cab(0, [(a, len(a))], [("s/one.one", 14, 14), ("far", 10, 9999)])
    zipped = cab(1, [deflated(a), deflated(b, a)], [("x", len(a) + len(b), 0)], b"rrrr")
    lzx = cab(3, [(a, len(a))], [("l", 5, 0)])
    df = spark.createDataFrame([(1, plain), (2, zipped), (3, lzx), (4, b"MSCFxx"), (5, None)], "id long, content binary")
    got = {(r["id"], r["name"]): r for r in binary.cabinet_files(df, "id", "content").collect()}
    assert bytes(got[1, "s/one.one"]["data"]) == b"hello section " and got[1, "far"]["warning"] == "no data"
    assert bytes(got[2, "x"]["data"]) == a + b
    assert got[3, "l"]["compression"] == "lzx" and got[3, "l"]["warning"] == "unsupported compression"
    assert got[4, None]["warning"].startswith("fatal") and got[5, None]["warning"].startswith("fatal")


def test_sections(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 80 + b"IEND1234"
    data = binary.SECTION + "Page  one".encode("utf-16-le") + b"\0\0" + b"ascii text\0ab\0" + png + b"\xff\xd8 no end"
    df = spark.createDataFrame([(1, data), (2, b"")], "id long, content binary")
    assert [r["x"] for r in df.select("id", binary.is_section(F.col("content")).alias("x")).orderBy("id").collect()] == [True, False]
    got = [(r["encoding"], r["value"]) for r in binary.section_strings(df, "id", "content").collect()]
    assert ("wide", "Page one") in got and ("ascii", "ascii text") in got and ("ascii", "ab") not in got
    files = binary.embedded_files(df, "id", "content").collect()
    assert [(r["name"], bytes(r["file"])) for r in files] == [("image-01.png", png)]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=600))
def test_carved_ranges_are_disjoint(data):
    end = 0
    for *_, start, content in binary.carve(data * 3):
        assert start >= end and data * 3 != b"" and (data * 3)[start : start + len(content)] == content
        end = start + len(content)
