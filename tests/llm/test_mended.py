"""Cases that once failed: headers that differ by case, many rows without doc_id, clauses with long gaps."""

import pytest
from pyspark.sql import functions as F

from leafmill.llm import jaccard, licenses, revisits


def test_header_names_that_differ_by_case(spark):
    entries = "record_id long, kind string, url string, time long, h array<struct<key:string,value:string>>, digest string"
    rows = [
        (1, "response", "http://a.example/", 1, [("ETag", '"x"'), ("etag", '"y"')], None),
        (2, "revisit", "http://a.example/", 2, [("etag", '"y"'), ("DATE", "old"), ("Date", "new")], None),
        (2, "revisit", "http://a.example/", 2, [("etag", '"y"'), ("DATE", "old"), ("Date", "new")], None),
        (None, "revisit", None, None, None, None),
    ]
    records = spark.createDataFrame(rows, entries).withColumn("headers", F.map_from_entries("h")).withColumn("canonical", F.lit("z"))
    got = revisits.resolve_revisits(records).orderBy("record_id").collect()
    assert [(r["record_id"], r["status"], r["headers"]) for r in got] == [(None, "missing", {}), *[(2, "resolved", {"etag": '"y"', "date": "new"})] * 2]


def test_many_rows_without_doc_id_meet_themselves_alone(spark):
    docs = spark.createDataFrame([(None, f"row number {i} has its own words {7 * i} and {13 * i} and more") for i in range(400)] + [(None, "the same text of six words here")] * 30, "doc_id long, text string")
    members = jaccard.sketches(docs, jaccard.ChosenPath()).withColumnRenamed("doc_id", "low").select("low", F.col("at").alias("_at"))
    assert jaccard._texts(docs).join(members, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("at") == F.col("_at"))).count() == 400 + 30 * 30
    assert sorted(r["n_links"] for r in jaccard.join_documents(docs).collect()) == [0] * 400 + [29] * 30


@pytest.mark.parametrize(
    "text, label",
    [
        ("neither the name of {} nor the names of its contributors", "bsd"),
        ("either version 2 of the license or any later version {} gnu general public license", "gpl"),
        ("change date {} change license", "bsl"),
        ("to the extent possible under law {} waived all copyright {} cc0", "cc0"),
        ("unauthorized copying {} strictly prohibited", "proprietary"),
    ],
)
def test_gaps_of_any_length(spark, text, label):
    gap = " ".join(f"word{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text.replace("{}", gap)), (2, text.replace("{}", "words")), (3, text.partition("{}")[0] * 2000)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.digest(licenses.scan_licenses(docs)).collect()}
    assert label in got[1] and label in got[2] and label not in got[3]
