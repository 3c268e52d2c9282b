"""Operator 3: cross-entropy difference between matched target and background n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import mix, read, stage, word_hashes
from leafmill.llm.jaccard import tiles_of
from leafmill.llm.suffixes import Repeats, pack_shards


@dataclass(frozen=True)
class Models:
    """prior: weight of single words in the chance of a pair. pack: bytes of texts that are counted together before
    the shuffle. bucket: bytes of text for each bucket of counts."""

    prior: float = 50.0
    pack: int = 3 << 20
    bucket: int = 4 << 20


#: What stands before the first and after the last word of a text.
_EDGE = np.uint64(0x5851F42D4C957F2D)
#: What the last bit of a key tells: a pair of words or a word.
PAIR, WORD = np.uint64(0), np.uint64(1)


def _key(h: np.ndarray, kind: np.uint64) -> np.ndarray:
    return (mix(h + kind) & ~np.uint64(1)) | kind


def tokens(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, word, last, document) of packed texts: the keys of all words and of the pairs they end, the keys of the
    pairs of the last words and the texts' ends followed by as many keys of such ends, and each word's document."""
    starts, hashes = word_hashes(np.frombuffer(data, np.uint8))
    doc = np.searchsorted(ends, starts, "right")
    first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
    before = np.concatenate([[_EDGE], hashes[:-1]])[: len(hashes)]
    before[first] = _EDGE
    step = np.uint64(0x9E3779B97F4A7C15)
    last = hashes[np.concatenate([first[1:], [True]])[: len(doc)]]
    edges = np.concatenate([_key(last * step ^ _EDGE, PAIR), _key(np.full(len(last), _EDGE), WORD)])
    return _key(before * step ^ hashes, PAIR), _key(hashes, WORD), edges, doc


def lowered(data: bytes, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts in small letters, each followed by a space, and their new ends."""
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    parts = [data[a:b].decode().lower().encode() + b" " for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
    return b"".join(parts), np.cumsum([len(p) for p in parts])


def _of(raw: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _member(ids: bytes, none: bytes, target: list | None) -> np.ndarray:
    return np.isin(_of(ids), np.array(target or [], np.int64)) & (_of(none, np.int8) == 0)


def _counted(shards: DataFrame, bits: int) -> DataFrame:
    """(bucket, shard, keys, n, t): the distinct keys of each shard with their counts in all and in target documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, none, ends, data, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, word, last, doc = tokens(*lowered(data, _of(ends)))
                member = _member(ids, none, target)
                every, at = np.unique(np.concatenate([pair, word, last]), return_inverse=True)
                n = np.bincount(at, minlength=len(every)).astype(np.int32)
                t = np.bincount(at, np.concatenate([member[doc], member[doc], member[np.unique(doc)], member[np.unique(doc)]]), len(every)).astype(np.int32)
                bucket = (every >> np.uint64(64 - bits)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(every)] if len(every) else []
                out = [(int(bucket[i]), shard, every[i:j].tobytes(), n[i:j].tobytes(), t[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "shard", "keys", "n", "t"])

    return shards.mapInArrow(run, "bucket int, shard long, keys binary, n binary, t binary")


def _totals(counted: DataFrame) -> DataFrame:
    """(shard, bucket, wide, n, t): for the keys of each shard in a bucket their counts over all shards, of 8 bytes if
    wide, else 4; and a row of shard -1 with the bucket's distinct words, words and target words, ends of texts among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches, ["bucket"]):
            lists = [_of(x, np.uint64) for x in tile.column("keys").to_pylist()]
            every, at = np.unique(np.concatenate(lists), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([_of(x, np.int32) for x in tile.column(c).to_pylist()]), len(every)).astype(np.int64) for c in ("n", "t")]
            words = every & np.uint64(1) == WORD
            facts = [int(words.sum()), int(sums[0][words].sum()), int(sums[1][words].sum())]
            stop = np.cumsum([len(x) for x in lists]).tolist()
            wide = bool(len(every) and sums[0].max() >= 1 << 31)
            cells = [[s[at[i:j]].astype(np.int64 if wide else np.int32).tobytes() for i, j in zip([0, *stop], stop, strict=False)] for s in sums]
            bucket = tile.column("bucket")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([*tile.column("shard").to_pylist(), -1]), pa.array([bucket] * (len(lists) + 1), pa.int32()), pa.array([wide] * (len(lists) + 1)), pa.array([*cells[0], np.array(facts).tobytes()]), pa.array([*cells[1], b""])], ["shard", "bucket", "wide", "n", "t"])

    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "shard long, bucket int, wide boolean, n binary, t binary")


def losses(pair: np.ndarray, word: np.ndarray, before: np.ndarray, size: np.ndarray, vocabulary: int, scale: float, prior: float) -> np.ndarray:
    """Of each word, its negative log chance by a model with counts of its pair, of itself, of the word before and of all words."""
    single = (word * scale + 1) / (size * scale + vocabulary)
    return -np.log((pair * scale + prior * single) / (before * scale + prior))


def score_documents(docs: DataFrame, target: DataFrame, config: Models = Models()) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for each row of docs(doc_id, text).

    The background model counts all docs, the target model those whose doc_id is in target(doc_id). Both have one
    vocabulary, all words of docs, and one smoothing; counts are scaled to the smaller of their totals. Counts of words
    and of pairs of words are exact: shards of texts count their own keys, buckets by key sum them and send the sums
    back to the shards, so all that is gathered grows with the input and stays spread. A document is scored by models
    without its own counts. Each text ends with one more word, so that chances sum to 1. Losses are means of nats a token; difference is background less target, so higher means
    more like the target. Texts without words (null, empty) have 0 tokens and zeros. Rows of one doc_id are documents of
    their own; a null one is in no target. An empty table gives no rows. A text of any length is one piece.
    """
    shards = pack_shards(docs.select("doc_id", "text"), Repeats(pack=config.pack), True)
    size = shards.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = min(30, max(4, (size // config.bucket).bit_length()))
    members = shards.select("shard", F.explode("row.doc_id").alias("doc_id")).where("doc_id is not null").join(target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")
    members = stage(members.groupBy("shard").agg(F.collect_set(F.col("doc_id").cast("long")).alias("target")), "members")
    texts = shards.join(members.hint("shuffle_hash"), "shard", "left").select("shard", "ids", "null_ids", "ends", "data", "target")
    totals = stage(_totals(_counted(texts, bits)), "totals")
    facts = totals.where("shard < 0").select("n").mapInArrow(_summed, "words long, n long, t long").agg(F.sum("words"), F.sum("n"), F.sum("t")).first()
    vocabulary, all_n, all_t = (x or 0 for x in facts)
    total = min(all_n, all_t)
    scales = [total / all_t if all_t else 0.0, total / all_n if all_n else 0.0]
    prior = config.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, none, ends, data, target, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, word, last, doc = tokens(*lowered(data, _of(ends)))
                member, n_docs = _member(ids, none, target), len(ends) // 8
                length = np.bincount(doc, minlength=n_docs)
                every, at = np.unique(np.concatenate([pair, word, last]), return_inverse=True)
                edge, at = at[-1:], at[: 2 * len(doc)].reshape(2, -1)
                del pair, word, last
                parts = sorted(parts or [], key=lambda p: p["bucket"])
                n, t = (np.concatenate([_of(p[c], np.int64 if p["wide"] else np.int32) for p in parts] or [np.zeros(0, np.int64)]) for c in ("n", "t"))
                _, of, times = np.unique(doc * max(len(every), 1) + at, return_inverse=True, return_counts=True)
                mine = times[of].reshape(at.shape)
                first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
                means = []
                for count, size, inside, scale in ((t, all_t, member[doc], scales[0]), (n, all_n, np.ones(len(doc), bool), scales[1])):
                    left = np.maximum(count[at] - mine * inside, 0)
                    before = np.concatenate([[0], left[1][:-1]])[: len(doc)]
                    before[first] = np.maximum(count[edge] - inside[first], 0)
                    loss = losses(left[0], left[1], before, np.maximum(size - (length[doc] + 1) * inside, 0), vocabulary, scale, prior)
                    means.append(np.bincount(doc, loss, n_docs) / np.maximum(length, 1))
                shown = pa.array(_of(ids), mask=_of(none, np.int8) == 1)
                yield pa.RecordBatch.from_arrays([shown, pa.array(length.astype(np.int64)), *map(pa.array, means), pa.array(means[1] - means[0])], ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    back = totals.where("shard >= 0").groupBy("shard").agg(F.collect_list(F.struct("bucket", "wide", "n", "t")).alias("parts"))
    met = shards.join(members.hint("shuffle_hash"), "shard", "left").join(back.hint("shuffle_hash"), "shard", "left").select("ids", "null_ids", "ends", "data", "target", "parts")
    return met.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        facts = np.array([_of(x) for x in batch.column(0).to_pylist()], np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in facts.sum(0)], ["words", "n", "t"])


def op3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against those labelled of good quality."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
