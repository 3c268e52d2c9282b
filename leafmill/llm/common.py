"""What the operators of this subpackage share: staging, exact global prefix sums, link components, byte hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def schema_of(ddl: str, row: DataType | None = None) -> StructType:
    """The schema that ddl names, with a column row of the given type, whose field names may be any."""
    out = StructType.fromDDL(ddl)
    return out.add("row", row) if row is not None else out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and the rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Removes what stage() wrote, once nothing reads it any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], block: str, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same group that come earlier by (block, order).

    Three levels keep it distributed: the rows of one block meet in a window, then the sums of 4,096 blocks, then one
    sum for each of those. block must be a number that coarsens the order wanted; nulls in group columns form a group.
    """
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, keys, by: F.coalesce(F.sum(c).over(earlier(keys, by)), F.lit(0))
    same = lambda a, b, keys: [a[c].eqNullSafe(b[c]) for c in keys]
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("_sum")).withColumn("_many", F.floor(F.col(block) / 4096))
    tops = sums.groupBy(*group, "_many").agg(F.sum("_sum").alias("_all")).withColumn("_top", before("_all", group, ["_many"])).drop("_all")
    sums = sums.withColumn("_mid", before("_sum", [*group, "_many"], [block]))
    sums = sums.join(tops, same(sums, tops, [*group, "_many"])).select(*[sums[c] for c in group], sums[block], (F.col("_mid") + F.col("_top")).alias("_base"))
    left = df.withColumn("_in", before(value, [*group, block], order))
    return left.join(sums, same(left, sums, [*group, block])).select(*[left[c] for c in df.columns], (F.col("_in") + F.col("_base")).alias(out))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (u, v): component is the smallest id reachable.

    Alternating large-star and small-star steps; every step is a map-side combined minimum and an equi-join of which
    neither side is broadcast, and each round is staged. Only counts and checksums come to the driver.
    """
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        sides = both(edges)
        low = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges, old = stage(small, "edges"), edges
        unstage(old)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def union_edges(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of n items the smallest item linked to it through pairs (k x 2 indexes)."""
    root = np.arange(n)
    if len(pairs):
        a, b = pairs[:, 0], pairs[:, 1]
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return root


def batched(rows: Iterable, size, limit: int) -> Iterator[list]:
    """Lists of rows whose sizes sum to limit at most; a longer row comes alone."""
    out, total = [], 0
    for row in rows:
        n = size(row)
        if out and total + n > limit:
            yield out
            out, total = [], 0
        out.append(row)
        total += n
    if out:
        yield out


# Wrapping polynomial hashes of byte spans: prefix[i] is the sum of (byte + 1) * BASE ** j over j < i, modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i < n at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))):
            step = np.full(size, base)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0], _powers[1]


def byte_prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finisher of the public splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all spans of k bytes."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    p = byte_prefix(data)
    return mix((p[k:] - p[:-k]) * powers(len(p))[1][: len(p) - k])


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased UTF-8 bytes: runs of letters, digits, _ and bytes from 128 on."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of data."""
    s, e = word_spans(data)
    p = byte_prefix(data)
    return s, mix((p[e] - p[s]) * powers(len(p))[1][s])
