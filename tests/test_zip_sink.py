"""Archives written by tasks and committed together."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.plans import importers
from leafmill.sources import binary, zip_sink


def test_archives_of_sections(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 80 + b"IEND1234"
    section = lambda *wide, more=b"": bytearray(binary.SECTION + b"\0\0" + "\u0001".join(wide).encode("utf-16le") + b"\0\0" + more)
    files = spark.createDataFrame([(1, section("My page title", "PageTitle", "Some content line of the page", more=png), "one"), (2, bytearray(b"none"), "two")], "id int, content binary, name string")
    zip_sink.register(spark)
    rows = zip_sink.entries(importers.sections(files, "id", "content", "name"), "id", files)
    rows.write.format("leaf_zip").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["one_converted.zip", "two_converted.zip"]
    one = zipfile.ZipFile(tmp_path / "out" / "one_converted.zip")
    assert sorted(one.namelist()) == ["one/My page title.html", "one/My page title.metadata.json", "one/_resources/image-01.png"]
    assert one.read("one/_resources/image-01.png") == png and one.read("one/My page title.html").startswith(b"\xef\xbb\xbf<!doctype html>")
    assert json.loads(one.read("one/My page title.metadata.json")) == {"name": "My page title", "path": "one/My page title.html", "metadata": {"title": "My page title"}}
    assert "no section signature" in zipfile.ZipFile(io.BytesIO((tmp_path / "out" / "two_converted.zip").read_bytes())).read("README.txt").decode()
    with pytest.raises(Exception, match="exists"):
        rows.write.format("leaf_zip").mode("append").save(str(tmp_path / "out"))
    rows.write.format("leaf_zip").mode("overwrite").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["one_converted.zip", "two_converted.zip"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    zip_sink.register(spark)
    rows = spark.range(200, numPartitions=4).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("archive"), F.lit("x").alias("path"), F.when(F.col("id") == 150, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"y")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("leaf_zip").mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []
    rows.where("id < 150").write.format("leaf_zip").mode("append").save(str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 150
