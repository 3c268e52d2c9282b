"""Operator 8: embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import components, read, stage, union_edges


@dataclass(frozen=True)
class Pigeonhole:
    """cosine: least of a link. blocks: subspaces. grid: leading coordinates of a block that its cells are made of.

    tile: vectors of one side that meet in a task at most, about. seed: of the rotation.
    """

    cosine: float = 0.9
    blocks: int = 4
    grid: int = 2
    tile: int = 16384
    seed: int = 8


class Frame:
    """Rotation and blocks for vectors of one width.

    Unit vectors a, b with a cosine of c or more have a squared distance of 2 - 2c at most. It is shared by the blocks
    in proportion to their width, so in some block the two are within that block's share.
    """

    def __init__(self, width: int, config: Pigeonhole):
        q, r = np.linalg.qr(np.random.default_rng([config.seed, width]).standard_normal((width, width)))
        self.rotation = q * np.sign(np.diag(r))
        n = min(config.blocks, width)
        self.edges = [width * i // n for i in range(n + 1)]
        total = max(2 - 2 * config.cosine, 1e-12)
        self.budget = np.array([total * (b - a) / width for a, b in zip(self.edges, self.edges[1:])]) * (1 + 1e-9)
        self.grid = config.grid

    def rotate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return x, x @ self.rotation

    def cells(self, y: np.ndarray, block: int) -> np.ndarray:
        a, b = self.edges[block], self.edges[block + 1]
        at = np.zeros((len(y), self.grid), np.int64)
        k = min(self.grid, b - a)
        at[:, :k] = np.floor(y[:, a : a + k] / (np.sqrt(self.budget[block]) * (1 + 1e-6)))
        return at


def _forward(grid: int) -> list[tuple[int, ...]]:
    """Offsets to neighbouring cells that come later; (0, 0, ...) first, for the own cell."""
    out = sorted(np.ndindex(*[3] * grid))
    zero = (0,) * grid
    return [zero, *(o for x in out if (o := tuple(int(v) - 1 for v in x)) > zero)]


_frames: dict[tuple, Frame] = {}


def _frame(width: int, config: Pigeonhole) -> Frame:
    if (width, config) not in _frames:
        _frames[width, config] = Frame(width, config)
    return _frames[width, config]


def _placed(reps: DataFrame, config: Pigeonhole, *carried: str) -> DataFrame:
    """Each vector, by its id and the columns carried, in its own cell of each block, and in the later neighbouring cells as a visitor."""
    offsets, kept, kinds = np.array(_forward(config.grid)), ["_rid", "width", *carried], dict(reps.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                pick = np.flatnonzero(widths == width)
                some = batch.take(pa.array(pick))
                x = np.array(some.column("vector").values.to_numpy(zero_copy_only=False)).reshape(len(pick), width)
                frame = _frame(int(width), config)
                y = frame.rotate(x)[1]
                keys = np.stack([frame.cells(y, b)[:, None, :] + offsets for b in range(len(frame.budget))], 1)  # vector, block, offset, coordinate
                n, blocks, k, grid = keys.shape
                cell = np.zeros((n, blocks, k), np.int64)
                for g in range(grid):
                    cell = cell * (1 << 20) + keys[..., g] + (1 << 19)
                ends = np.arange(0, n * blocks * k + 1, blocks * k, dtype=np.int32)
                item = pa.StructArray.from_arrays([pa.array(np.tile(np.repeat(np.arange(blocks, dtype=np.int32), k), n)), pa.array(cell.ravel()), pa.array(np.tile(np.arange(k) == 0, n * blocks))], ["block", "cell", "home"])
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(ends), item)], [*kept, "keys"])

    out = reps.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", keys array<struct<block:int,cell:long,home:boolean>>")
    return out.select(*kept, F.explode("keys").alias("k")).select(*kept, "k.*")


#: Cells whose counts go to all tasks; more are joined by a shuffle. A limit of memory; it decides nothing.
_CELLS = 1 << 16
_LINKS = pa.schema([("_rid", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])


def tile_links(rid: np.ndarray, mult: np.ndarray, role: np.ndarray, x: np.ndarray, block: int, same: bool, frame: Frame, cosine: float, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one tile: (ids, the smallest id of those linked through the tile, links counted with copies).

    role 0: first side; 1: the first side's cell's other part; 2: visitors. A pair counts in the first block where it
    is within the budget, so each pair counts once over all blocks. same: the first side is compared with itself too.
    """
    x, y = frame.rotate(x)
    order = np.argsort(role, kind="stable")
    rid, mult, x, y = rid[order], mult[order], x[order], y[order]
    first, n = int((role == 0).sum()), len(rid)
    links, edges = np.zeros(n, np.int64), []
    a0, b0 = frame.edges[block], frame.edges[block + 1]
    # one product gives the squared distances: (-2 y, |y|^2, 1) . (y', 1, |y'|^2)
    part = y[:, a0:b0].astype(np.float32)
    sq, one = (part**2).sum(1)[:, None], np.ones((n, 1), np.float32)
    left, right = np.hstack([-2 * part, sq, one]), np.ascontiguousarray(np.hstack([part, one, sq]).T)
    loose = np.float32(frame.budget[block] + 1e-5)
    for i in range(0, first, step):
        ie = min(i + step, first)
        for j in range(i if same else first, n, step):
            je = min(j + step, n)
            s, t = np.divmod(np.flatnonzero(left[i:ie] @ right[:, j:je] <= loose), je - j)
            s, t = s + i, t + j
            ordered = s < t
            s, t = s[ordered], t[ordered]
            kept = []
            for k in range(0, len(s), 1 << 16):  # candidates on whole vectors, in double precision
                u, v = s[k : k + (1 << 16)], t[k : k + (1 << 16)]
                close = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                u, v = u[close], v[close]
                apart = np.add.reduceat((y[u] - y[v]) ** 2, frame.edges[:-1], axis=1) <= frame.budget
                own = apart[:, block] & ~apart[:, :block].any(1)
                kept.append(np.stack([u[own], v[own]], 1))
            if kept and len(pairs := np.concatenate(kept)):
                np.add.at(links, pairs[:, 0], mult[pairs[:, 1]])
                np.add.at(links, pairs[:, 1], mult[pairs[:, 0]])
                items, local = np.unique(pairs, return_inverse=True)
                root = union_edges(local.reshape(-1, 2), len(items))
                edges.append(np.stack([items, items[root]], 1))
    got = np.flatnonzero(links)
    if not len(got):
        return got, got, got
    # ids ascend with indexes for union_edges
    rank = np.argsort(rid)
    back = np.empty(n, np.int64)
    back[rank] = np.arange(n)
    root = union_edges(back[np.concatenate(edges)], n)
    return rid[got], rid[rank[root[back[got]]]], links[got]


def link_vectors(vectors: DataFrame, config: Pigeonhole = Pigeonhole()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors(vec_id, embedding): links are pairs of a cosine >= config.cosine.

    Equal vectors are folded first and counted by number. Folded vectors are rotated; in each block those in the same
    or neighbouring cells meet in tiles, each pair in one; pairs within the block's budget are verified in double
    precision on the whole vectors. Tiles give counts and spanning links, never all pairs. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of other widths; rows that share a
    vec_id are vectors of their own. A row of null vec_id links with nothing and has a null component. Vectors may have
    any width; an empty table gives no rows; other columns may have any names. Cells are counted first, then vectors are
    sent to their tiles; only counts of cells may be broadcast, and those of _CELLS cells at most.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    reps = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"))
    reps = stage(reps.withColumn("width", F.size("vector")).withColumn("_rid", F.monotonically_increasing_id()), "vectors")
    key = ["width", "block", "cell"]
    sizes = _placed(reps, config).groupBy(*key).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits"))
    parts = lambda c: F.ceil(F.col(c) / config.tile).cast("int")
    sizes = stage(sizes.where("homes > 0 and homes + visits > 1").select(*key, parts("homes").alias("parts"), parts("visits").alias("visit_parts")), "cells")
    sizes = F.broadcast(sizes) if sizes.count() <= _CELLS else sizes.hint("merge")
    put = _placed(reps, config, "mult", "vector").join(sizes, key).withColumn("s", F.pmod(F.xxhash64("_rid"), F.when(F.col("home"), F.col("parts")).otherwise(F.col("visit_parts"))).cast("int"))
    # tile (a, b): part a of a cell's own vectors with themselves (a = b) or with part b > a, and with part b of its visitors
    tiles = F.expr(
        """if(home,
            concat(transform(filter(sequence(0, greatest(parts, visit_parts) - 1), b -> b >= s or b < visit_parts), b -> named_struct('a', s, 'b', b, 'role', 0)),
                   if(s > 0, transform(sequence(0, s - 1), a -> named_struct('a', a, 'b', s, 'role', 1)), array())),
            transform(sequence(0, parts - 1), a -> named_struct('a', a, 'b', s, 'role', 2)))"""
    )
    put = put.select(*key, "_rid", "mult", "vector", F.explode(tiles).alias("t")).select(*key, "t.*", "_rid", "mult", "vector")
    group = [*key, "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held)
            held.clear()
            width, block, _, a, b = (t.column(c)[0].as_py() for c in group)
            role = t.column("role").to_numpy()
            if len(role) < 2 or not (role == 0).any():
                return None
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("vector").chunks]).reshape(len(role), width)
            found = tile_links(t.column("_rid").to_numpy(), t.column("mult").to_numpy(), role, x, block, a == b, _frame(width, config), config.cosine)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], schema=_LINKS) if len(found[0]) else None

        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in group], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                now = tuple(keys[i])
                if held and now != last and (out := flush()) is not None:
                    yield out
                held.append(batch.slice(i, j - i))
                last = now
        if held and (out := flush()) is not None:
            yield out

    links = stage(put.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "_rid long, root long, n long"), "links")
    joined = components(links.select(F.col("_rid").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("_rid").agg(F.sum("n").alias("n"))
    # files of ids are small, their rows are not: none of these tables may pass the driver to be broadcast
    whole = lambda df: df.hint("merge")
    known = reps.join(whole(counts), "_rid", "left").join(whole(joined.withColumnRenamed("id", "_rid")), "_rid", "left").withColumn("component", F.coalesce("component", "_rid"))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(whole(lowest), "component").select(F.col("vector").alias("_vector"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.where("vector is not null").join(whole(known), F.col("vector") == F.col("_vector"))
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    # those that link with nothing are no key of a join
    return out.union(rows.where("vector is null").select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings"))
