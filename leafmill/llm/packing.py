"""Operator 1: mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import batched, byte_prefix, mix, powers, prefix_sums, read, stage


@dataclass(frozen=True)
class Packing:
    """tokenizer: file of an installed tokenizer with 65,536 ids at most; None: word_bpe_49k.json of public_tokenizers.

    end: id put after each document. length: most tokens of a sequence. window: sequences over which each source is
    to reach its proportion. weights: target proportions by source (missing: 0 until the others are out); None: the
    sources' own shares, so that all queues end together. split: documents that meet in one window function, about.
    """

    tokenizer: str | None = None
    end: int = 1
    length: int = 2048
    window: int = 64
    weights: dict[str | None, float] | None = None
    split: int = 4_000


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
#: ASCII letters, and ASCII signs that never join letters or digits in a token.
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'")]] = True
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3; small letters are 0x20 further.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LATIN_LOW = np.arange(256, dtype=np.uint8)
_LATIN_LOW[0x80:0x9F] += 32


class Words:
    """Ids of words by a 64-bit hash of their bytes, in numpy tables; lookups and additions take many words at once.

    Open addressing: a hash's slots follow its low bits. It starts anew when most words are in it.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(1 << (2 * self.most - 1).bit_length(), np.uint64), np.zeros(1 << (2 * self.most - 1).bit_length(), np.int32)
        self.n, self.used, self.starts, self.pool = 0, 0, np.zeros(self.most + 1, np.int64), np.zeros(1 << 16, np.uint16)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of words; -1 for new ones. Hashes are never 0."""
        mask = np.uint64(len(self.keys) - 1)
        slot = hashes & mask
        key = self.keys[slot]
        out = np.where(key == hashes, self.places[slot], -1).astype(np.int64)
        todo = np.flatnonzero((key != hashes) & (key != 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
            key = self.keys[slot[todo]]
            hit = key == hashes[todo]
            out[todo[hit]] = self.places[slot[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray, raw: np.ndarray, size: np.ndarray) -> None:
        """Adds new words, each once: their ids, one word after another, and how many each has."""
        n = len(hashes)
        while self.used + len(raw) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(raw)] = raw
        self.starts[self.n + 1 : self.n + n + 1] = self.used + np.cumsum(size)
        mask = np.uint64(len(self.keys) - 1)
        slot, todo = hashes & mask, np.arange(n)
        while len(todo):
            free = self.keys[slot[todo]] == 0
            self.keys[slot[todo[free]]] = hashes[todo[free]]  # of several, one stays
            put = self.keys[slot[todo]] == hashes[todo]
            self.places[slot[todo[put]]] = self.n + todo[put]
            todo = todo[~put]
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
        self.n, self.used = self.n + n, self.used + len(raw)


class Encoder:
    """Token ids of texts. White space always parts tokens, so words are encoded by themselves.

    The words of a slice are hashed together and their ids are looked up in a bounded table, so each word is encoded
    once as a rule; the bound changes the work, never the ids. New words of Latin letters and signs are encoded together
    by the merges of the tokenizer's file, others by the tokenizer, as are words of over 64 bytes. A tokenizer that does
    not fold case, or whose last tokens of words are not marked by </w>, encodes whole texts.
    """

    LONG = 64

    def __init__(self, path: str | None, words: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("ids over 65,535 are not supported")
        made = json.loads(self.tokenizer.to_str())
        model = made["model"]
        rules = json.dumps([made.get("normalizer"), made.get("pre_tokenizer")])
        self.by_word = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and all(f'"{k}"' in rules for k in ("Lowercase", "Removed", "ByteLevel"))
        if not self.by_word:
            return
        self.words = Words(words)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves in the vocabulary
        chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(shown)))}
        self.symbol = np.array([[vocab[chars[b]], vocab[chars[b] + "</w>"]] for b in range(256)], np.uint16)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([(vocab[x] << 16) | vocab[y] for x, y in pairs], np.uint64)
        self.merges = Words(len(keys))
        self.merges.add(mix(keys + np.uint64(1)), np.array([vocab[x + y] for x, y in pairs], np.uint16), np.ones(len(keys), np.int64))

    def each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, symbol: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each unit): n units, numbered by unit, after all merges, the earliest rule of a unit first."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            pair = (symbol[:-1].astype(np.uint64) << np.uint64(16)) | symbol[1:]
            rule = self.merges.find(mix(pair + np.uint64(1)))
            rule[(rule < 0) | (unit[1:] != unit[:-1])] = len(self.merges.starts)
            rule = np.append(rule, len(self.merges.starts))
            new = np.concatenate([[True], unit[1:] != unit[:-1]])
            start = np.flatnonzero(new)
            least = np.minimum.reduceat(rule, start)
            of = np.cumsum(new) - 1
            live = least < len(self.merges.starts)
            hit = (rule == least[of]) & live[of]
            at = np.flatnonzero(hit)
            if len(at):  # in a row of one symbol every second pair is merged
                fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
                symbol[at] = self.merges.pool[rule[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            going = live[of]
            done.append((symbol[~going], unit[~going]))
            symbol, unit = symbol[keep & going], unit[keep & going]
        if not done:
            return symbol, np.zeros(n, np.int64)
        ids, units = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(units, kind="stable")], np.bincount(units, minlength=n)

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of the spans of data."""
        n, size = len(start), end - start
        stop = np.cumsum(size)
        text = data[np.repeat(start - (stop - size), size) + np.arange(int(size.sum()))]
        word = np.repeat(np.arange(n), size)
        second = np.concatenate([[False], text[:-1] == 0xC3]) & _LATIN[text]
        letter, sign = _LETTER[text] | second, _SIGN[text]
        letter[:-1] |= second[1:]
        back = np.concatenate([[False], (word[1:] == word[:-1]) & letter[1:] & sign[:-1]])
        plain = np.bincount(word, ~(letter | sign) | back, n) == 0
        # a word is one unit of letters and one of signs, either may lack
        pick = plain[word]
        low = np.where(second, _LATIN_LOW[text], _LOW[text])[pick]
        unit = (2 * word + sign)[pick]
        last = np.concatenate([unit[1:] != unit[:-1], [True]])[: len(unit)]
        ids, count = self.merged(self.symbol[low, last.astype(np.int8)], unit, 2 * n)
        count = count[0::2] + count[1::2]
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return ids, count
        raw = text.tobytes()
        made = self.each([raw[i:j].decode() for i, j in zip((stop - size)[rest].tolist(), stop[rest].tolist(), strict=True)])
        other = np.array([len(x) // 2 for x in made], np.int64)
        of = np.concatenate([np.repeat(np.arange(n), count), np.repeat(rest, other)])
        count[rest] = other
        return np.concatenate([ids, np.frombuffer(b"".join(made), np.uint16)])[np.argsort(of, kind="stable")], count

    def __call__(self, raw: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each text, given in UTF-8."""
        if not self.by_word:
            return self.each([t.decode() for t in raw])
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        step = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
        start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        if not len(start):
            return [b""] * len(raw)
        prefix, table = byte_prefix(data), self.words
        hashes = mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])
        hashes[hashes == 0] = 1
        place = table.find(hashes)
        place[end - start > self.LONG] = -1
        new = np.flatnonzero(place < 0)
        # of the new words each once, but long ones each time: ids for this slice, beside the table's
        kinds, first, which = np.unique(np.where((end - start)[new] > self.LONG, np.arange(len(new), dtype=np.uint64), hashes[new]), return_index=True, return_inverse=True)
        first = new[first]
        ids, size = self.encode_words(data, start[first], end[first])
        begin = np.concatenate([table.starts[place], [0]])[:-1]
        count = table.starts[place + 1] - begin
        pool = np.concatenate([table.pool[: table.used], ids]) if len(new) else table.pool
        begin[new] = table.used + (np.cumsum(size) - size)[which]
        count[new] = size[which]
        out = pool[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        short = (end - start)[first] <= self.LONG
        if table.n + int(short.sum()) > table.most:
            table.clear()
        if short.sum() <= table.most:
            table.add(kinds[short], ids[np.repeat(short, size)], size[short])
        after = np.concatenate([[0], np.cumsum(count)])
        cut = after[np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in raw)]))].tolist()
        flat = out.tobytes()
        return [flat[2 * a : 2 * b] for a, b in zip(cut, cut[1:], strict=False)]


_encoders: dict[str | None, Encoder] = {}


def encode(docs: DataFrame, config: Packing) -> DataFrame:
    """Staged (_row, doc_id, _source, n, ids): 16-bit ids with the end id; null text is empty. _row is unique."""
    path, end = config.tokenizer, np.uint16(config.end).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for some in batched(rows, lambda r: len(r[2]), 1 << 20):
                ids = [x + end for x in encoder([r[2] for r in some])]
                yield pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in some], "_source": [r[1] for r in some], "n": [len(x) // 2 for x in ids], "ids": ids}, schema=_ENCODED)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("_source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return stage(texts.mapInArrow(run, "doc_id long, _source string, n long, ids binary").withColumn("_row", F.monotonically_increasing_id()), "tokens")


_ENCODED = pa.schema([("doc_id", pa.int64()), ("_source", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])


def lay_out(rows: DataFrame, config: Packing) -> DataFrame:
    """Adds round and place to rows(_row, _source, n): place is the number of tokens before a document's first.

    Deficit round-robin gives each source, in each round, its share of window * length tokens; it serves its next
    documents while its deficit covers them, and carries the rest. A document whose source has served c tokens with it
    is thus served in the first round r with r * quantum >= c, so the order of all documents follows from prefix sums
    alone and deficits are carried exactly over windows and partitions. Sources without weight follow the others.
    """
    quantum = config.window * config.length
    buckets = max(1, -(-rows.count() // config.split))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    rows = prefix_sums(rows, ["_source"], ["_row"], "_bucket", "n", "_served")
    shares = stage(rows.groupBy(F.col("_source").alias("_of")).agg(F.sum("n").alias("_all")), "shares")
    total = shares.agg(F.sum("_all")).first()[0] or 0
    weight = F.col("_all") / F.lit(float(max(total, 1)))
    if config.weights is not None:
        whole = float(sum(config.weights.values())) or 1.0
        weight = F.lit(0.0)
        for name, w in config.weights.items():
            weight = F.when(F.col("_of").eqNullSafe(F.lit(name)), F.lit(w / whole)).otherwise(weight)
    shares = shares.select("_of", weight.alias("_weight"), F.col("_all"))
    rows = rows.join(shares, F.col("_source").eqNullSafe(F.col("_of")))
    after = total // quantum + 1
    if config.weights is not None:  # rounds until the last weighted queue is empty
        after = int(shares.where("_weight > 0").agg(F.max(F.ceil(F.col("_all") / (F.col("_weight") * quantum)))).first()[0] or 0)
    end = F.col("_served") + F.col("n")
    rnd = F.when(F.col("_weight") > 0, F.ceil(end / (F.col("_weight") * quantum)) - 1).otherwise(after + F.floor(end / quantum))
    rows = rows.withColumn("round", rnd.cast("long")).drop("_of", "_weight", "_all", "_bucket")
    # rounds hold about as many tokens each, so equal runs of rounds are equal shares of the work
    run = max(1, -(-(2 * after + 1) // buckets))
    rows = rows.withColumn("_run", F.floor(F.col("round") / run))
    return prefix_sums(rows, [], ["round", F.col("_source").asc_nulls_last(), "_served", "_row"], "_run", "n", "place").drop("_run", "_served")


def ends_of(total: int, length: int) -> list[int]:
    """Ends of the last sequences: what is left after the full ones is cut into powers of two, so that none is padded."""
    out, at = [], total // length * length
    for bit in reversed(range(length.bit_length())):
        if (total - at) >> bit & 1 and total - at >= 1 << bit:
            at += 1 << bit
            out.append(at)
    return out


def pack_documents(docs: DataFrame, config: Packing = Packing(), keep_ids: bool = True) -> DataFrame:
    """Packs docs(doc_id, text, source) into sequences of config.length tokens; a row for each piece of a document.

    Columns: doc_id, source, round, start (tokens of the document before the piece), length, ids_crc32 (of its ids as
    32-bit little-endian words), doc_tokens, sequence_id, offset, and ids (those words) with keep_ids. Each document
    ends with config.end. Documents follow by lay_out() and are cut where a sequence ends. Only the last sequences are
    shorter: powers of two, without padding. Rows that share a doc_id are documents of their own; a null source is a
    source. An empty table gives no rows.
    """
    tokens = encode(docs, config)
    layout = lay_out(tokens.select("_row", "_source", "n"), config)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    length, full, tail = config.length, total // config.length, ends_of(total, config.length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in _PIECE.names}
            for doc_id, source, rnd, place, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_source", "round", "place", "ids")), strict=True):
                ids = np.frombuffer(raw, np.uint16).astype("<u4")
                n, at = len(ids), 0
                while at < n:
                    seq = (place + at) // length
                    first, last = seq * length, (seq + 1) * length
                    if seq >= full:
                        k = int(np.searchsorted(tail, place + at, "right"))
                        seq, first, last = full + k, tail[k - 1] if k else full * length, tail[k]
                    piece = ids[at : last - place].tobytes()
                    values = (doc_id, source, rnd, at, len(piece) // 4, zlib.crc32(piece), n, seq, place + at - first, piece if keep_ids else None)
                    for c, v in zip(_PIECE.names, values, strict=True):
                        out[c].append(v)
                    at += len(piece) // 4
            yield pa.RecordBatch.from_pydict(out, schema=_PIECE)

    met = tokens.select("_row", "doc_id", "ids").join(layout.select("_row", "_source", "round", "place"), "_row")
    out = met.select("doc_id", "_source", "round", "place", "ids").mapInArrow(cut, "doc_id long, source string, round long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out if keep_ids else out.drop("ids")


_PIECE = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *((c, pa.int64()) for c in ("round", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, n): the sequences that the pieces make; ids are 32-bit little-endian words."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), keep_ids=False)
