"""Operator 6: mixing sources to target weights, by blocks of tokens and pseudorandom index permutations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import prefix_sums, read, stage

#: A word of a text: what stands between these white spaces.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """cycle: weights of the sources by code point, null last, repeating. repeats: most passes over a source.

    block: words a block. shard: slots an output shard. split: rows of a source that meet in one window at most,
    about. seed: of draws and permutations.
    """

    cycle: tuple[float, ...] = (5.0, 2.0, 1.0)
    repeats: int = 3
    block: int = 32
    shard: int = 1 << 16
    split: int = 4_000
    seed: int = 6


def _rank(names: DataFrame) -> DataFrame:
    """Adds rank from 0 by _source; rows are dealt to ranges between a few sampled names, so no task gets all."""
    bounds = sorted(r[0] for r in names.where("_source is not null").orderBy(F.xxhash64("_source"), "_source").limit(64).select("_source").collect())
    low = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<string>")
    names = names.withColumn("_range", F.when(F.col("_source").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(low, lambda b: b <= F.col("_source")))))
    sums = names.groupBy("_range").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_source")) - 1
    return names.withColumn("_own", own).join(sums, "_range").withColumn("rank", F.col("_own") + F.col("_base")).drop("_range", "_own", "_base")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(_source, source_size, target) of sizes(_source, size).

    All sizes are shared by weight; where a share is over repeats times its source's size it stops there, and the
    excess goes to the others by weight until none is over. Each pass is one aggregate; two numbers reach the driver.
    """
    out = _rank(sizes.groupBy("_source").agg(F.sum("size").alias("source_size")))
    cycle = F.array(*map(F.lit, mix.cycle))
    out = stage(out.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(mix.cycle) + 1).cast("int"))), "sources")
    cap = F.col("source_size") * float(mix.repeats)
    total = float(out.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        over = F.col("weight") * level > cap
        kept, weight = out.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        new = (total - (kept or 0.0)) / weight if weight else level
        if new <= level:
            break
        level = new
    return out.withColumn("target", F.least(cap, F.col("weight") * level)).drop("rank", "weight")


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key, by a four-round Feistel network with cycle walking."""
    index, n, key = (np.asarray(x, np.uint64).copy() for x in (index, n, key))
    half = np.ones_like(n)
    while (short := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half[short] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(index))
    while len(todo):
        left, right = index[todo] >> half[todo], index[todo] & mask[todo]
        for k in range(4):
            f = right * np.uint64(0x9E3779B97F4A7C15) + key[todo] + np.uint64(k * 0xD1B54A32D192ED03 % (1 << 64))
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask[todo])
        index[todo] = (left << half[todo]) | right
        todo = todo[index[todo] >= n[todo]]
    return index


def key_of(name: str | None, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{'-' if name is None else '+' + name}".encode(), digest_size=8).digest(), "little")


#: Shards of a group: a source's slots are drawn for groups of shards first, then within each group.
GROUP = 1024
#: Slots that one row stands for until they are dealt to tasks.
RUN = 4096


def shard_counts(blocks: DataFrame, mix: Mix) -> DataFrame:
    """(_source, n_blocks, shard, first, count): the slots that each output shard gives each source, where it gives any.

    A source gets its target in units of its mean block. Which shard each of these slots falls to is drawn from a
    multinomial, first over groups of shards, then over the shards of each group, so a shard's counts of sources are
    multinomial, their totals meet the targets, and nothing about sources or shards passes the driver but three
    numbers. first is the number of a source's slots in earlier shards; a source stops at repeats passes.
    """
    rows = blocks.where("n_blocks > 0").select("_source", "n_blocks", F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5).cast("long").alias("count"))
    total = rows.agg(F.sum("count")).first()[0] or 0
    n_shards, seed = max(1, round(total / mix.shard)), mix.seed
    groups = -(-n_shards // GROUP)

    def over_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.diff(np.minimum(np.arange(groups + 1) * GROUP, n_shards)) / n_shards
        for batch in batches:
            for name, n, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                drawn = np.random.default_rng([seed, key_of(name, seed)]).multinomial(count, share)
                yield _drawn(name, n, np.arange(groups), drawn)

    def over_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, group, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shards = np.arange(group * GROUP, min((group + 1) * GROUP, n_shards))
                drawn = np.random.default_rng([seed, key_of(name, seed), group + 1]).multinomial(count, np.full(len(shards), 1 / len(shards)))
                yield _drawn(name, n, shards, drawn)

    schema = "_source string, n_blocks long, shard long, count long"
    drawn = rows.mapInArrow(over_groups, schema).repartition("_source", "shard").mapInArrow(over_shards, schema)
    drawn = prefix_sums(drawn.withColumn("_group", F.floor(F.col("shard") / GROUP)), ["_source"], ["shard"], "_group", "count", "first").drop("_group")
    room = F.col("n_blocks") * mix.repeats - F.col("first")
    return drawn.withColumn("count", F.greatest(F.lit(0), F.least("count", room)))


def _drawn(name: str | None, n_blocks: int, shards: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    some = count > 0
    k = int(some.sum())
    return pa.RecordBatch.from_pydict({"_source": [name] * k, "n_blocks": [n_blocks] * k, "shard": shards[some], "count": count[some]}, schema=_DRAWN)


def mix_plan(blocks: DataFrame, mix: Mix) -> DataFrame:
    """(_source, shard, slot, block): the block of its source that each slot of each shard takes."""
    seed = mix.seed

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("_source").to_pylist()
            keys = {x: key_of(x, seed) for x in set(names)}
            at, n = (batch.column(c).to_numpy() for c in ("at", "n_blocks"))
            # each pass over a source has a permutation of its own
            key = np.array([keys[x] for x in names], np.uint64) + (at // n).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
            block = permute(at % n, n, key).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"_source": names, "shard": batch.column("shard"), "slot": at, "block": block}, schema=_PLAN)

    runs = shard_counts(blocks, mix).where("count > 0").withColumn("_run", F.explode(F.expr(f"sequence(first, first + count - 1, {RUN})")))
    runs = runs.withColumn("_stop", F.least(F.col("_run") + RUN, F.col("first") + F.col("count"))).repartition("_source", "_run")
    slots = runs.select("_source", "n_blocks", "shard", F.explode(F.expr("sequence(_run, _stop - 1)")).alias("at"))
    return slots.mapInArrow(place, "_source string, shard long, slot long, block long")


_DRAWN = pa.schema([("_source", pa.string()), ("n_blocks", pa.int64()), ("shard", pa.int64()), ("count", pa.int64())])
_PLAN = pa.schema([("_source", pa.string()), ("shard", pa.int64()), ("slot", pa.int64()), ("block", pa.int64())])


#: What tells a row of documents: rows of one doc_id differ in their texts' hashes, equal rows in their number.
KEY = ["doc_id", "_hash", "_nth"]


def _met(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a with the other columns of b, by KEY."""
    b = b.withColumnsRenamed({c: f"_of{c}" for c in KEY})
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in KEY], how).drop(*[f"_of{c}" for c in KEY])


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy(F.lit(0))))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, _source, size, _hash, _nth) of docs(doc_id, text, source); null texts have no words."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    source = F.col("source").cast("string")
    return _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("_source"), size.alias("size"), F.xxhash64("text", source).alias("_hash")))


def mix_sources(sizes: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The mix over staged sizes(doc_id, _source, size, _hash, _nth).

    Returns (pieces, totals). pieces has, for each document and block that share words and each use of the block:
    doc_id, _hash, _nth, _source, start (word in the document), length, shard, slot, block. totals is targets(). Each
    source's words stand in line by hash of doc_id and are cut into blocks of mix.block words (the last is shorter);
    documents without words have no piece. An empty table gives none.
    """
    goals = stage(targets(sizes, mix), "targets")
    blocks = goals.withColumn("n_blocks", F.ceil(F.col("source_size") / mix.block))
    uses = mix_plan(blocks, mix)
    rows = sizes.where("size > 0")
    buckets = max(1, -(-sizes.count() // mix.split))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
    rows = prefix_sums(rows, ["_source"], KEY, "_bucket", "size", "_at")
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(_at div {mix.block}, (_at + size - 1) div {mix.block})")))
    first = F.greatest(F.col("_at"), F.col("block") * mix.block)
    last = F.least(F.col("_at") + F.col("size"), (F.col("block") + 1) * mix.block)
    parts = rows.select(F.col("_source").alias("_of"), F.col("block").alias("_b"), *KEY, (first - F.col("_at")).alias("start"), (last - first).alias("length"))
    met = uses.hint("merge").join(parts, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_b")))
    return met.select(*KEY, "_source", "start", "length", "shard", "slot", "block"), goals


_WORDS = re.compile(WORD)


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs(doc_id, text, source, ...), with its columns, as the mix takes them: a row for each pass over a document, with the words it takes.

    Where a pass takes all words the text is unchanged; else it holds the stretches taken, joined by a space. n_chars,
    if there, is set anew. Documents without words (null and empty texts too), and those that the mix leaves out, go. An
    empty table gives none. Other columns may have any names.
    """
    sizes = stage(sized(docs), "sizes")
    pieces, _ = mix_sources(sizes, mix)
    uses = pieces.groupBy(*KEY, "start").agg(F.max("length").alias("length"), F.count("*").alias("uses"))
    uses = uses.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "length", "uses"))).alias("_uses"))
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text", F.col("source").cast("string")).alias("_hash")))
    rows = _met(rows, uses).select("_row", "text", "_uses")
    rows = rows.withColumn("_pass", F.explode(F.expr("sequence(1, array_max(transform(_uses, u -> u.uses)))")))
    rows = rows.withColumn("_uses", F.filter("_uses", lambda u: u["uses"] >= F.col("_pass")))

    @F.pandas_udf("string")
    def taken(texts: pd.Series, uses: pd.Series) -> pd.Series:
        return pd.Series([_stretches(t, [(u["start"], u["start"] + u["length"]) for u in us]) for t, us in zip(texts, uses, strict=True)])

    rows = rows.select("_row", taken("text", "_uses").alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text")}
    kinds = dict(docs.dtypes)
    return rows.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _stretches(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of text in spans, which ascend, with what stands between them; all of it if all words are in."""
    at = [m.span() for m in _WORDS.finditer(text)]
    out: list[list[int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    if out == [[0, len(at)]]:
        return text
    return " ".join(text[at[a][0] : at[b - 1][1]] for a, b in out)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stage(sized(read(spark, sf_dir, "documents")), "sizes")
    pieces, goals = mix_sources(sizes)
    taken = pieces.groupBy(*KEY).agg(F.sum("length").alias("taken"))
    out = _met(sizes, taken, "left").drop("_hash", "_nth")
    out = out.join(goals.select(F.col("_source").alias("_of"), "source_size", "target"), F.col("_source").eqNullSafe(F.col("_of")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("_source").alias("source"))
