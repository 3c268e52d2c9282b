"""What a task holds and how work is dealt, and results beyond sizes that the small tables have."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.operators import nodes
from leafmill.plans import importers
from leafmill.sources import binary


def test_python_memory_of_nodes_is_bounded(monkeypatch):
    monkeypatch.setattr(nodes, "_AT_ONCE", 1 << 14)
    page = "<div><p>some words</p><ul><li>a<li>b</ul></div>" * 40

    def peak(n):
        tracemalloc.start()
        nodes._matched.func(pa.array([page] * n))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(1)  # modules that are loaded at first use
    assert peak(80) < 1.3 * peak(20)


def test_few_bytes_of_markup_are_dealt_over_all_tasks(spark):
    rows = nodes.nodes(spark.range(400).selectExpr("id", "'<p>x</p>' AS html"), "html")
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sections_keep_all_their_titles(spark):
    titles = [f"Part no {i} of 7" for i in range(20)]
    data = bytearray(binary.SECTION + b"\0\0" + "\u0001".join(titles).encode("utf-16le") + b"\0\0")
    pages = importers.sections(spark.createDataFrame([(1, data)], "id int, content binary"), "id", "content")["pages"]
    assert [r["title"] for r in pages.orderBy("page").collect()] == titles


def test_contents_are_read_once(spark):
    """The columns of which a section is made are evaluated in one job, whatever is asked of the result."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def content(i):
        calls.add(1)
        return bytes(binary.SECTION + b"\0\0" + "My page title\u0001PageTitle\u0001Some content line of the page\0".encode("utf-16le"))

    out = importers.sections(spark.range(3).select("id", content("id").alias("content")), "id", "content")
    assert out["pages"].count() == 3 and out["notices"].count() == 3 and out["hierarchy"].count() == 6 and calls.value == 3
