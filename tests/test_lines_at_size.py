"""Tests of lines that make no cells agree with those that do."""

from pyspark.sql import functions as F

from leafmill.functions import lines, text

LINES = [
    "", "a\tb", "a\t\tb", "|a|", "|a|b", "a|b", "a|b|", "a | b | c", "| |", "||", "|a| |b|", "a||b", "| a", "a |", "| |a|", "|a|　|b|", "a  b", "a \tb", "a  -", "-  b", "--  a  b", "a b  c", "!  a  !  b", "a  !  b", "a   b   c",
    "a\n\nb", "a  b", "# Title", "Label 1:", "- item", "1. x", "a) x", "plain words here", "abc def", "abc1def", "ab cde", "abcdef", "abc 12 de", "abc - xyz", "é abc é def", "x at 10:15", "310:15", "3 March 2020", "on 13 March 20201", "IHDR", "xIHDR", "a idat b", "obj", "x%PDF y", "%PDF", "PK\x03\x04a",
    "ABC!", *(f"x{chr(i)}{chr(i)}{chr(i)}x" for i in range(1, 260)), "YWJjZGVmZ2g=", "a éé b", " a ", "|", "a|", "1 | 2  3", "  ", None,
]


def test_rows_are_told_without_cells(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "line string").withColumn("v", text.strip(F.col("line")))
    got = rows.select("v", lines.is_row(F.col("v")).alias("a"), lines.cells(F.col("v"), True).isNotNull().alias("b")).collect()
    assert [r["v"] for r in got if r["a"] != r["b"]] == []


def test_points_of_lines_stay(spark):
    words = F.regexp_count("v", F.lit("[A-Za-z]{3,}")) >= 2
    pairs = [(F.col("v").rlike(lines._WORDS), words), *((F.col("v").rlike(p), F.col("v").rlike(p.replace(r"(?=\d)", "").replace("(?=[IJEPO%])", ""))) for p in (lines._CLOCK, lines._DAY, *lines._BINARY))]
    pairs += [(F.col("v").rlike(lines._BINARY[2]), F.col("v").rlike(r"[^A-Za-z0-9\s,.;:'\"!?()\-_/]{2,}")), (F.col("v").rlike(lines._NO_CONTENT[3]), F.col("v").rlike(r"[^A-Za-z0-9\s]{3,}"))]
    rows = spark.createDataFrame([(x,) for x in LINES], "line string").withColumn("v", text.strip(F.col("line")))
    for a, b in pairs:
        assert [r["v"] for r in rows.select("v", a.alias("a"), b.alias("b")).collect() if r["a"] != r["b"]] == []


def test_scores_make_no_cells(spark):
    plan = spark.createDataFrame([("a",)], "line string").select(lines.line_score(F.col("line")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "transform(" not in plan and "regexp_count(" not in plan
