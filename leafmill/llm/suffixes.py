"""Operator 9: removal of repeated passages with suffix arrays."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from leafmill.llm.common import batched, gram_hashes, mix, read, schema_of, shared_dir, stage, unstage
from leafmill.llm.jaccard import tiles_of


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a repeated string. gram: bytes of the hashed spans whose least in a window names it.

    pack: bytes of texts packed in one row. shard: bytes of one suffix array.
    """

    length: int = 100
    gram: int = 40
    pack: int = 1 << 20
    shard: int = 1 << 20


# ---- suffix arrays --------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes: Larsson-Sadakane refinement.

    Suffixes start sorted by 7 bytes. Each pass sorts only within groups that are still tied, by the rank of the suffix
    as many bytes further as are sorted already, which doubles the sorted length. A rank is its group's first place.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    padded[:n] += np.uint64(1)  # the end of the text sorts first; 9 bits a byte
    key = np.zeros(n, np.uint64)
    h = 7
    for k in range(h):
        key = (key << np.uint64(9)) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    places = np.arange(n)

    def starts(sorted_keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        return at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]

    rank = np.empty(n, np.int64)
    rank[order] = starts(key[order], places) if n else places
    while h < n:
        step = h
        place_rank = rank[order]
        tied = np.zeros(n, bool)
        same = place_rank[1:] == place_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        p = order[at]
        second = np.where(p + step < n, rank[np.minimum(p + step, n - 1)] + 1, 0)
        both = place_rank[at] * np.int64(n + 1) + second
        again = np.argsort(both, kind="stable")
        order[at] = p[again]
        rank[order[at]] = starts(both[again], at)
        h += step
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Of each suffix in order, the length of the prefix it shares with the one before, most at most: Kasai's scan.

    Text positions are dealt to lanes that are scanned side by side: in each, the shared length falls by one at most
    from one position to the next.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    width = -(-n // min(lanes, n))
    first = np.arange(0, n, width)
    h = np.zeros(len(first), np.int64)
    shared = np.zeros(n, np.int64)
    for k in range(width):
        p = first + k
        live = p < n
        p, h = p[live], h[live]
        first = first[live]
        q = before[p]
        h = np.where(q < 0, 0, np.maximum(h - 1, 0))
        todo = np.flatnonzero((q >= 0) & (h < most))
        while len(todo):
            a, b = p[todo] + h[todo], q[todo] + h[todo]
            ok = (a < n) & (b < n)
            ok[ok] = text[a[ok]] == text[b[ok]]
            todo = todo[ok]
            h[todo] += 1
            todo = todo[h[todo] < most]
        shared[p] = h
    out[:] = shared[order]
    return out


def repeated_starts(text: np.ndarray, eligible: np.ndarray, length: int, shard: int) -> np.ndarray:
    """Marks the eligible positions whose next length bytes also stand at an earlier eligible position.

    The text is cut into shards (eligible strings are whole in each). A shard's suffix array puts equal strings side by
    side, which the common prefixes tell; all but the first are repeats. First ones are looked up in the sorted first
    ones of earlier shards by binary search.
    """
    marked = np.zeros(len(text), bool)
    firsts: list[np.ndarray] = []
    for a in range(0, len(text), shard):
        b = min(a + shard, len(text))
        part = text[a : min(b + length - 1, len(text))]
        order, _ = suffix_array(part)
        group = np.cumsum(common_prefixes(part, order, length) < length)
        keep = (order < b - a) & eligible[a + np.minimum(order, b - a - 1)]
        order, group = order[keep], group[keep]
        if not len(order):
            continue
        low = np.full(int(group[-1]) + 1, len(text), np.int64)
        np.minimum.at(low, group, order)
        is_first = low[group] == order
        marked[a + order[~is_first]] = True
        if len(text) > shard:
            own = order[is_first]  # sorted by their strings
            strings = np.lib.stride_tricks.sliding_window_view(part, length)[own]
            strings = np.ascontiguousarray(strings).view(f"S{length}").ravel()
            fresh = np.ones(len(own), bool)
            for old in firsts:
                at = np.minimum(np.searchsorted(old, strings), len(old) - 1)
                fresh &= old[at] != strings
            marked[a + own[~fresh]] = True
            if fresh.any():
                firsts.append(strings[fresh])
    return marked


# ---- windows and their names ----------------------------------------------------------------------------------


def named_runs(data: np.ndarray, ends: np.ndarray, config: Repeats, slice_bytes: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, count): runs of successive windows with one name in packed texts that end at ends.

    A window is config.length bytes of one text; its name comes from the least hash of its grams, so equal windows have equal
    names wherever they stand.
    """
    length, span = config.length, config.length - config.gram + 1
    n = len(data)
    valid = np.ones(n, bool)
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    last = np.maximum(begin, ends - length + 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, last, 1)
    np.add.at(edge, ends, -1)
    valid = np.cumsum(edge[:-1]) == 0
    first = np.zeros(n + 1, bool)
    first[begin] = True
    names, at, counts = [], [], []
    for a in range(0, n - length + 1, slice_bytes):
        b = min(a + slice_bytes, n - length + 1)
        low = gram_hashes(data[a : b + length - 1], config.gram)
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if span > size:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        ok = valid[a:b]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | ~ok[:-1]]) & ok
        new |= first[a:b] & ok
        s = np.flatnonzero(new)
        if not len(s):
            continue
        run = np.cumsum(new)[ok] - 1
        names.append(mix(low[s]))  # least hashes are small; their leading bits are to deal names evenly
        at.append(s + a)
        counts.append(np.bincount(run, minlength=len(s)))
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(at), np.concatenate(counts)


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of data, one after another."""
    total = int(size.sum())
    if not total:
        return data[:0]
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
    return data[at]


# ---- jobs -----------------------------------------------------------------------------------------------------


def _i64(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def _of(raw: bytes | None, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(raw or b"", kind)


def pack_shards(docs: DataFrame, config: Repeats, carry: bool) -> DataFrame:
    """Packed documents, bucketed by shard: joins by shard move only the other side. The catalog keeps no entry of them."""
    spark = docs.sparkSession
    names = ["shard", "ids", "null_ids", "ends", "data", *(["row"] if carry else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [pa.list_(f.type) for f in list(batch.schema)[2:]]
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for some in batched(rows, lambda r: len(r[1]), config.pack):
                ids = np.array([r[0] or 0 for r in some], np.int64)
                none = np.array([r[0] is None for r in some], np.int8)
                ends = np.cumsum([len(r[1]) for r in some])
                data = [[ids.tobytes()], [none.tobytes()], [_i64(ends)], [b"".join(r[1] for r in some)]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in data), *(pa.array([[r[2 + i] for r in some]], k) for i, k in enumerate(kinds))], names[1:])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if carry else []))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = texts.mapInArrow(run, schema_of("ids binary, null_ids binary, ends binary, data binary", ArrayType(texts.schema["row"].dataType) if carry else None)).select(F.monotonically_increasing_id().alias("shard"), "*")
    name = f"leafmill_shards_{uuid.uuid4().hex}"
    packed.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/leafmill/{name}").bucketBy(max(1, -(-size // (16 << 20))), "shard").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and out knows them and their buckets
    return out


def _bits(shards: DataFrame) -> int:
    """Leading bits of a name that make a bucket: one bucket for each 2 MB of text or so."""
    size = shards.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    return min(30, max(4, (size >> 21).bit_length()))


def _names(shards: DataFrame, config: Repeats, bits: int) -> DataFrame:
    """(bucket, shard, names): the distinct names of each shard, by the leading bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ends, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.unique(named_runs(np.frombuffer(data, np.uint8), _of(ends), config)[0])
                bucket = (found >> np.uint64(64 - bits)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(found)] if len(found) else []
                parts = [(int(bucket[i]), found[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([shard] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["bucket", "shard", "names"])

    return shards.select("shard", "ends", "data").mapInArrow(run, "bucket int, shard long, names binary")


def _shared_names(names: DataFrame) -> DataFrame:
    """(shard, shared): for each shard, those of its names that other shards have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles_of(batches, ["bucket"]):
            lists = [_of(x, np.uint64) for x in t.column("names").to_pylist()]
            every = np.sort(np.concatenate(lists))
            twice = every[1:][every[1:] == every[:-1]]
            twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice
            if not len(twice):
                continue
            hits = []
            for x in lists:
                at = np.minimum(np.searchsorted(twice, x), len(twice) - 1)
                hits.append(x[twice[at] == x].tobytes())
            yield pa.RecordBatch.from_arrays([t.column("shard").combine_chunks(), pa.array(hits, pa.binary())], ["shard", "shared"])

    found = names.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "shard long, shared binary").where(F.octet_length("shared") > 0)
    return found.groupBy("shard").agg(F.collect_list("shared").alias("shared"))


_SEGMENTS = ["bucket", "shard", "order", "local", "start", "count", "text"]
_LAST = np.iinfo(np.int64).max


def _segments(shards: DataFrame, shared: DataFrame, config: Repeats, bits: int) -> DataFrame:
    """The runs whose names stand elsewhere too, with their texts, by bucket; bucket -1: spans that repeat within their shard."""
    over = config.length - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, none, ends, data, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, ends = np.frombuffer(data, np.uint8), _of(ends)
                name, at, count = named_runs(data, ends, config)
                if not len(name):
                    continue
                names = np.sort(np.concatenate([_of(x, np.uint64) for x in known])) if known else np.zeros(0, np.uint64)
                order = np.sort(name)
                names = np.concatenate([names, order[1:][order[1:] == order[:-1]]])
                pick = np.flatnonzero(np.isin(name, names) | _self_repeat(data, at, count, config))
                if not len(pick):
                    continue
                name, at, count = name[pick], at[pick], count[pick]
                local = np.searchsorted(ends, at, "right")
                doc = np.where(_of(none, np.int8)[local] == 1, _LAST, _of(ids)[local])
                start = at - np.where(local > 0, ends[np.maximum(local - 1, 0)], 0)
                by = np.lexsort((start, local, doc))
                seen: dict[bytes, int] = {}
                raw = data.tobytes()
                new = np.array([seen.setdefault(raw[a : a + c + over], i) == i for i, a, c in zip(by.tolist(), at[by].tolist(), count[by].tolist())], bool)
                again = by[~new]
                out = [(-1, shard, b"", _i64(local[again]), _i64(start[again]), _i64(start[again] + count[again] + over), b"")] if len(again) else []
                by = by[new]
                where = (name[by] >> np.uint64(64 - bits)).astype(np.int64)
                sort = np.argsort(where, kind="stable")
                by, where = by[sort], where[sort]
                cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(by)]
                for i, j in zip(cuts, cuts[1:]):
                    k = by[i:j]
                    head = np.stack([name[k].view(np.int64), doc[k]])
                    out.append((int(where[i]), shard, head.tobytes(), _i64(local[k]), _i64(start[k]), _i64(count[k]), _take(data, at[k], count[k] + over).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], _SEGMENTS)

    met = shards.select("shard", "ids", "null_ids", "ends", "data").join(shared.hint("shuffle_hash"), "shard", "left")
    return met.select("shard", "ids", "null_ids", "ends", "data", "shared").mapInArrow(run, "bucket int, shard long, order binary, local binary, start binary, count binary, text binary")


def _self_repeat(data: np.ndarray, at: np.ndarray, count: np.ndarray, config: Repeats) -> np.ndarray:
    """Marks the runs that may hold one window twice.

    Equal windows d apart share all grams of their overlap at that distance; in a run of no more windows than a window
    has grams, the gram where the last window starts is one of them. Longer runs are always marked.
    """
    span = config.length - config.gram + 1
    out = count > span
    h = gram_hashes(data, config.gram)
    some = np.flatnonzero((count > 1) & ~out)
    for d in range(1, span):
        some = some[count[some] > d]
        if not len(some):
            break
        p = at[some] + count[some] - 1
        hit = h[p] == h[np.minimum(p + d, len(h) - 1)]
        out[some[hit]] = True
        some = some[~hit]
    return out


def _spans(segments: DataFrame, config: Repeats) -> DataFrame:
    """(shard, local, start, end): spans that repeat earlier ones, from each bucket's segments."""
    over = config.length - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles_of(batches, ["bucket"]):
            sizes = [len(x) // 8 for x in t.column("local").to_pylist()]
            shard = np.repeat(t.column("shard").to_numpy(), sizes)
            head = [_of(x).reshape(2, -1) for x in t.column("order").to_pylist()]
            name, doc = np.concatenate([x[0] for x in head]), np.concatenate([x[1] for x in head])
            local, start, count = (np.concatenate([_of(x) for x in t.column(c).to_pylist()]) for c in ("local", "start", "count"))
            raw = b"".join(t.column("text").to_pylist())
            size = count + over
            end = np.cumsum(size)
            by = np.lexsort((start, local, shard, doc))
            seen: dict[bytes, int] = {}
            new = np.array([seen.setdefault(raw[b - n : b], i) == i for i, b, n in zip(by.tolist(), end[by].tolist(), size[by].tolist())], bool)
            del seen
            again, first = by[~new], by[new]
            found = [(shard[again], local[again], start[again], start[again] + size[again])]
            # names of two different segments at least, and segments that may repeat themselves
            sort = np.sort(name[first])
            twice = np.unique(sort[1:][sort[1:] == sort[:-1]])
            text = np.frombuffer(raw, np.uint8)
            may = np.isin(name[first], twice)
            for some in batched(np.flatnonzero(~may & (count[first] > 1)).tolist(), lambda i: int(size[first[i]]), 1 << 19):
                k = first[some]  # segments of one kind only, which may still repeat themselves
                may[some] = _self_repeat(_take(text, (end - size)[k], size[k]), np.cumsum(size[k]) - size[k], count[k], config)
            pick = first[may]
            if len(pick):
                joined = _take(text, (end - size)[pick], size[pick])
                stop = np.cumsum(size[pick])
                seg = np.repeat(np.arange(len(pick)), size[pick])
                eligible = np.arange(len(joined)) < (stop - over)[seg]
                marked = repeated_starts(joined, eligible, config.length, config.shard)
                at = np.flatnonzero(marked)
                if len(at):
                    run_start = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]])])
                    a = at[run_start]
                    b = at[np.concatenate([run_start[1:], [True]])]
                    owner = pick[seg[a]]
                    shift = start[owner] - (stop - size[pick])[seg[a]]
                    found.append((shard[owner], local[owner], a + shift, b + shift + config.length))
            cols = [np.concatenate(c) for c in zip(*found, strict=True)]
            if len(cols[0]):
                sort = np.argsort(cols[0], kind="stable")
                cols = [c[sort] for c in cols]
                cuts = [0, *(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist(), len(cols[0])]
                rows = [(int(cols[0][i]), *(_i64(c[i:j]) for c in cols[1:])) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], ["shard", "local", "start", "end"])

    own = segments.where("bucket < 0").select("shard", "local", "start", F.col("count").alias("end"))
    far = segments.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "shard long, local binary, start binary, end binary")
    return own.union(far)


def dedup_passages(docs: DataFrame, config: Repeats = Repeats(), carry: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, kept_text): documents without the bytes of repeated passages.

    A byte goes if some string of config.length bytes over it also starts earlier: in a document of smaller doc_id, or
    earlier in the same one. Null doc_ids come last; rows of one doc_id follow each other in some order. Null texts are
    empty. kept holds the remaining bytes; kept_text them as text, without what is left of characters that were cut.
    carry: add the rows but for their text as a struct, row. An empty table gives none; a text of any length is one piece.

    Windows of config.length bytes are named by the least hash of their grams, so equal windows share a name. Names
    that stand in one place only are dropped; runs of the others go, as texts, to shards by name. There equal runs are
    folded, and suffix arrays tell which windows of the others are equal. All documents are packed once, in a table
    bucketed for the two joins that bring names and spans back to the texts.
    """
    shards = pack_shards(docs, config, carry)
    bits = _bits(shards)
    shared = stage(_shared_names(_names(shards, config, bits)), "shared")
    segments = stage(_segments(shards, shared, config, bits), "segments")
    spans = stage(_spans(segments, config).groupBy("shard").agg(F.collect_list(F.struct("local", "start", "end")).alias("spans")), "spans")
    unstage(shared, segments)
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("kept_text", pa.string()), *([("row", None)] if carry else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = [k or batch.schema.field("row").type.value_type for _, k in kinds]
            for ids, none, ends, data, spans, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, none, ends = _of(ids), _of(none, np.int8), _of(ends)
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                gone = np.zeros(len(data) + 1, np.int32)
                for s in spans or []:
                    local = _of(s["local"])
                    np.add.at(gone, begin[local] + _of(s["start"]), 1)
                    np.add.at(gone, begin[local] + _of(s["end"]), -1)
                gone = np.cumsum(gone[:-1]) > 0
                bytes_ = np.frombuffer(data, np.uint8)
                out: list[list] = [[] for _ in kinds]
                for i, (a, b) in enumerate(zip(begin.tolist(), ends.tolist())):
                    mask = gone[a:b]
                    removed = int(mask.sum())
                    kept = bytes_[a:b][~mask].tobytes() if removed else data[a:b]
                    n_spans = int((mask[1:] & ~mask[:-1]).sum() + mask[0]) if removed else 0
                    values = (None if none[i] else int(ids[i]), b - a, removed, n_spans, hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore"), *(r[i] for r in rest))
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kind, strict=True)], [k for k, _ in kinds])

    met = shards.join(spans.hint("shuffle_hash"), "shard", "left").select("ids", "null_ids", "ends", "data", "spans", *(["row"] if carry else []))
    return met.mapInArrow(run, schema_of("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string", shards.schema["row"].dataType.elementType if carry else None))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(read(spark, sf_dir, "documents")).drop("kept", "kept_text")
