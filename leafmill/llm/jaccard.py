"""Operator 4: n-gram Jaccard join by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import batched, components, mix, read, stage, union_edges, unstage, word_hashes


@dataclass(frozen=True)
class ChosenPath:
    """words: of a shingle. jaccard: least of a link. recall: target for pairs at that threshold, through all splits. tokens: of a sketch.

    bucket: most sets that are compared by brute force at once. depth: splits at most; what is larger then is compared
    in tiles of that size. slack: how far a sketch's estimate may be below the threshold.
    """

    words: int = 5
    jaccard: float = 0.8
    recall: float = 0.999
    tokens: int = 64
    bucket: int = 2048
    depth: int = 3
    slack: float = 0.22
    seed: int = 4

    @property
    def runs(self) -> int:
        """Least number for which a pair at the threshold meets with the chance recall, even where each of its buckets is split down to depth.

        A pair has a binomial number of equal tokens. At each level a path goes on with each of them that is chosen, so
        the chance that a path lasts to the end follows level by level; all runs must end for a pair to be missed.
        """
        n = self.tokens
        equal = [math.comb(n, k) * self.jaccard**k * (1 - self.jaccard) ** (n - k) for k in range(n + 1)]
        chosen = min(1.0, 1 / (self.jaccard * n))
        lasts = [1.0] * (n + 1)
        for _ in range(self.depth):
            lasts = [1 - (1 - chosen * x) ** k for k, x in enumerate(lasts)]
        least = equal[0] + 1e-15  # without an equal token nothing meets
        runs = 1
        while sum(e * (1 - x) ** runs for e, x in zip(equal, lasts, strict=True)) > max(1 - self.recall, least):
            runs += 1
        return runs


_FIVE = np.uint64(0x9E6C63D0876A9A99)


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of each text, sorted, one text after another.

    Words are runs of letters, digits and _ of the lower-cased text, as UTF-8. A text of fewer words, but some, is one shingle.
    """
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    starts, hashes = word_hashes(data)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    at = np.searchsorted(starts, begin)
    n = np.diff(at)
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        rolled[: len(hashes) - k] = rolled[: len(hashes) - k] * _FIVE + hashes[k:] if k < len(hashes) else rolled[: len(hashes) - k]
    rolled = mix(rolled)
    out, ends = [], []
    total = 0
    for i, k in enumerate(n.tolist()):
        if k >= words:
            some = np.sort(rolled[at[i] : at[i] + k - words + 1])
            some = some[np.concatenate([[True], some[1:] != some[:-1]])]
        elif k:
            h = np.uint64(k)
            with np.errstate(over="ignore"):
                for x in hashes[at[i] : at[i] + k]:
                    h = h * _FIVE + x
            some = mix(np.array([h], np.uint64))
        else:
            some = np.zeros(0, np.uint64)
        out.append(some)
        total += len(some)
        ends.append(total)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(ends, np.int64)


def minhashes(sets: np.ndarray, starts: np.ndarray, tokens: int) -> np.ndarray:
    """tokens least 32-bit hashes of each set (none empty)."""
    rng = np.random.default_rng(tokens)
    a, b = rng.integers(0, 1 << 63, (2, tokens), np.uint64)
    out = np.empty((len(starts), tokens), np.uint32)
    for k in range(tokens):
        x = sets * (a[k] * np.uint64(2) + np.uint64(1))
        x += b[k]
        x >>= np.uint64(32)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.binary())])


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, at): at, a hash of the text, tells rows of one doc_id apart."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("at", F.xxhash64("text"))


def sketches(docs: DataFrame, config: ChosenPath) -> DataFrame:
    """(doc_id, at, size, h1, h2, sketch) of docs: hash of the text, number of shingles, a hash of the whole set, sketch (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for some in batched(rows, lambda r: len(r[1]), 1 << 20):
                sets, ends = shingle_sets([r[1] for r in some], config.words)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                size = ends - starts
                full = np.flatnonzero(size)
                h = np.zeros((2, len(some)), np.uint64)
                sketch: list = [None] * len(some)
                if len(full):
                    h[0, full], h[1, full] = np.add.reduceat(sets, starts[full]), np.bitwise_xor.reduceat(mix(sets), starts[full])
                    for i, s in zip(full.tolist(), minhashes(sets, starts[full], config.tokens), strict=True):
                        sketch[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int64()), pa.array(size), *(pa.array(x.view(np.int64)) for x in h), pa.array(sketch, pa.binary())], schema=_SKETCH)

    return _texts(docs).mapInArrow(run, "doc_id long, at long, size long, h1 long, h2 long, sketch binary")


def _choose(sets: DataFrame, config: ChosenPath, level: int) -> DataFrame:
    """(_rid, path) of the tokens that each set chooses: at level 0 from each run, later from each path it is on."""
    runs = mix(np.arange(config.runs, dtype=np.uint64) + np.uint64(config.seed << 32))
    most = np.uint64(int((1 << 64) / (config.jaccard * config.tokens)) if config.jaccard * config.tokens > 1 else (1 << 64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                n = some.num_rows
                x = np.frombuffer(b"".join(some.column("sketch").to_pylist()), np.uint32).reshape(n, -1).astype(np.uint64)
                x = mix(x + (np.arange(x.shape[1], dtype=np.uint64) << np.uint64(32)))
                paths = np.broadcast_to(runs, (n, len(runs))) if not level else some.column("path").to_numpy().view(np.uint64)[:, None]
                h = mix(x[:, None, :] ^ paths[:, :, None])
                at = np.nonzero(h < most)
                yield pa.RecordBatch.from_arrays([pa.array(some.column("_rid").to_numpy()[at[0]]), pa.array(mix(h[at] + np.uint64(level)).view(np.int64))], ["_rid", "path"])

    return sets.mapInArrow(run, "_rid long, path long")


def _buckets(reps: DataFrame, config: ChosenPath) -> tuple[DataFrame, list[DataFrame]]:
    """((_rid, path, parts), what it is staged in): sets that meet at the ends of their paths; parts is over 1 only for what depth left large."""
    sets, out, staged = reps.select("_rid", "sketch"), None, []
    for level in range(config.depth):
        paths = stage(_choose(sets, config, level).distinct(), "paths")
        counts = paths.groupBy(F.col("path").alias("_path")).agg(F.count("*").alias("_n")).where("_n > 1")
        met = stage(paths.join(counts, F.col("path") == F.col("_path")).select("_rid", "path", "_n"), "met")
        unstage(paths)
        staged.append(met)
        last = level == config.depth - 1
        small = (met if last else met.where(F.col("_n") <= config.bucket)).select("_rid", "path", F.ceil(F.col("_n") / config.bucket).cast("int").alias("parts"))
        out = small if out is None else out.union(small)
        large = met.where(F.col("_n") > config.bucket)
        if last or large.isEmpty():
            break
        sets = large.select("_rid", "path").join(reps.select("_rid", "sketch"), "_rid").select("_rid", "path", "sketch")
    return out, staged


def tiled(rows: DataFrame, key: str) -> DataFrame:
    """Deals rows(key, parts, _rid, ...) to tiles (key, a, b), a <= b: each pair of a key's rows meets in one tile at least, and counts in the tile of its parts."""
    rows = rows.withColumn("s", F.pmod(F.xxhash64("_rid"), F.col("parts")).cast("int"))
    to = F.expr("transform(sequence(0, parts - 1), o -> named_struct('a', least(s, o), 'b', greatest(s, o)))")
    out = rows.withColumn("_t", F.explode(to)).withColumns({"a": F.col("_t.a"), "b": F.col("_t.b")}).drop("_t", "parts")
    return out.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b")


def tiles_of(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each tile, from sorted batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in key], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            now = tuple(keys[i])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _near(sketch: np.ndarray, i: int, js: np.ndarray, least: float) -> np.ndarray:
    return js[(sketch[js] == sketch[i]).mean(1) >= least]


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_LINK = pa.schema([("_rid", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])


def candidates(reps: DataFrame, config: ChosenPath) -> DataFrame:
    """Staged (u, v): links that span the sets whose sketches are alike enough within some bucket."""
    least = config.jaccard - config.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for t in tiles_of(batches, ["path", "a", "b"]):
            rid = t.column("_rid").to_numpy()
            n = len(rid)
            if n < 2:
                continue
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(n, -1)
            if n == 2:
                if (sketch[0] == sketch[1]).mean() >= least:
                    found.append(rid[None, :])
            else:
                order = np.argsort(rid)
                rid, sketch = rid[order], sketch[order]
                pairs = []
                free = np.arange(n)
                while len(free) > 1:  # a set that is tied to an earlier one need not be tied to it again, but to others
                    js = _near(sketch, int(free[0]), free[1:], least)
                    pairs.append(np.stack([np.full(len(js), free[0]), js], 1))
                    free = free[1:]
                root = union_edges(np.concatenate(pairs), n)
                tied = np.flatnonzero(root != np.arange(n))
                found.append(np.stack([rid[tied], rid[root[tied]]], 1))
            if len(found) >= 2000:
                e = np.concatenate(found)
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=_EDGE)
        if found:
            e = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=_EDGE)

    buckets, staged = _buckets(reps, config)
    met = buckets.join(reps.select("_rid", "sketch"), "_rid").select("path", "parts", "_rid", "sketch")
    out = stage(tiled(met, "path").select("path", "a", "b", "_rid", "sketch").mapInArrow(run, "u long, v long"), "candidates")
    unstage(*staged)
    return out


def tile_links(rid: np.ndarray, mult: np.ndarray, part: np.ndarray, sets: list[np.ndarray], sketch: np.ndarray, a: int, b: int, config: ChosenPath) -> tuple[np.ndarray, ...]:
    """Of one tile: (ids, smallest id linked through the tile, links counted with copies), from exact intersections."""
    keep = np.unique(rid, return_index=True)[1]
    rid, mult, part, sketch, sets = rid[keep], mult[keep], part[keep], sketch[keep], [sets[i] for i in keep]
    n = len(rid)
    size = np.array([len(s) for s in sets])
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(len(names), bool)
    links = np.zeros(n, np.int64)
    edges = []
    for i in range(n - 1):
        js = np.arange(i + 1, n)
        if a != b:
            js = js[part[js] != part[i]]
        js = js[(np.minimum(size[js], size[i]) >= config.jaccard * np.maximum(size[js], size[i]) - 1e-9)]
        js = _near(sketch, i, js, config.jaccard - config.slack)
        if not len(js):
            continue
        own = token[starts[i] : ends[i]]
        mark[own] = True
        at = np.repeat(starts[js] - np.concatenate([[0], np.cumsum(size[js])[:-1]]), size[js]) + np.arange(size[js].sum())
        both = np.add.reduceat(mark[token[at]].astype(np.int64), np.cumsum(size[js]) - size[js])
        mark[own] = False
        js = js[both >= config.jaccard * (size[i] + size[js] - both) - 1e-9]
        links[i] += mult[js].sum()
        links[js] += mult[i]
        edges.append(np.stack([np.full(len(js), i), js], 1))
    if not links.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    root = union_edges(np.concatenate(edges), n)
    got = np.flatnonzero(links)
    return rid[got], rid[root[got]], links[got]


def _verified(docs: DataFrame, reps: DataFrame, clusters: DataFrame, config: ChosenPath) -> DataFrame:
    """(_rid, root, n) of the tiles of each cluster of candidates, with sets made anew from the texts."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for some in batched(rows, lambda r: len(r[0]), 1 << 20):
                sets, ends = shingle_sets([r[0] for r in some], config.words)
                out = []
                for r, i, j in zip(some, [0, *ends.tolist()], ends.tolist(), strict=False):
                    s = sets[i:j]
                    if int(np.add.reduce(s).view(np.int64)) == r[1]:  # not another text of the same doc_id and hash
                        out.append((*r[2:], s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())], ["_rid", "cluster", "parts", "mult", "sketch", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles_of(batches, ["cluster", "a", "b"]):
            if t.num_rows < 2:
                continue
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(t.num_rows, -1)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            found = tile_links(t.column("_rid").to_numpy(), t.column("mult").to_numpy(), t.column("s").to_numpy(), sets, sketch, t.column("a")[0].as_py(), t.column("b")[0].as_py(), config)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=_LINK)

    sizes = clusters.groupBy(F.col("component").alias("cluster")).agg(F.ceil(F.count("*") / config.bucket).cast("int").alias("parts"))
    members = clusters.withColumnRenamed("component", "cluster").join(sizes, "cluster").withColumnRenamed("id", "_rid")
    members = members.join(reps, "_rid").select("_rid", "cluster", "parts", "mult", "sketch", "low", F.col("at").alias("_at"), "h1")
    met = _texts(docs).join(members, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("at") == F.col("_at"))).select("text", "h1", "_rid", "cluster", "parts", "mult", "sketch")
    sets = met.mapInArrow(sets_of, "_rid long, cluster long, parts int, mult long, sketch binary, set binary")
    rows = tiled(sets, "cluster").select("cluster", "a", "b", "s", "_rid", "mult", "sketch", "set")
    return rows.mapInArrow(run, "_rid long, root long, n long")


def join_documents(docs: DataFrame, config: ChosenPath = ChosenPath()) -> DataFrame:
    """(doc_id, n_shingles, copy_id, component_id, n_links), a row for each row of docs(doc_id, text).

    Links are pairs of other documents whose word shingles have a Jaccard similarity of config.jaccard or more.
    Documents of equal shingle sets are folded (copy_id: their smallest doc_id) and counted by number. Sketches of the
    folded sets choose paths; sets that end on one path and look alike form clusters, and within clusters all pairs
    that look alike are verified on whole sets. Tiles return counts and spanning links, not pairs. component_id is the
    smallest doc_id reachable by links. Texts without words (null, empty, only signs) link with nothing and are their
    own component; a null doc_id is the smallest of none unless its group has no other. An empty table gives no rows; a
    text of any length is one set. Other columns of docs are not read.
    """
    all_rows = stage(sketches(docs, config), "sketches")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("row")
    reps = all_rows.where("size > 0").groupBy("size", "h1", "h2").agg(row, F.count("*").alias("mult"), F.first("sketch").alias("sketch"))
    reps = reps.select("size", "h1", "h2", F.col("row.doc_id").alias("low"), F.col("row.at").alias("at"), "mult", "sketch")
    reps = stage(reps.withColumn("_rid", F.monotonically_increasing_id()), "sets")
    found = candidates(reps, config)
    clusters = stage(components(found), "clusters")
    links = stage(_verified(docs, reps, clusters, config), "links")
    unstage(found, clusters)
    joined = components(links.select(F.col("_rid").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("_rid").agg(F.sum("n").alias("n"))
    known = reps.drop("sketch", "at").join(counts, "_rid", "left").join(joined.withColumnRenamed("id", "_rid"), "_rid", "left").withColumn("component", F.coalesce("component", "_rid"))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "component").select(F.col("size").alias("_size"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("low").alias("copy_id"), "component_id")
    out = all_rows.drop("sketch", "at").join(known, (F.col("size") == F.col("_size")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(read(spark, sf_dir, "documents"))
