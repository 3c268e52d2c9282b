"""Operator 12: encoding to and decoding from the pieces of a BPE model, by rounds of merges over flat arrays."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import batched, read

MARK = "▁"  # stands for a blank in pieces
_UNIT = re.compile(" +[^ ]*")
_OTHER = 1 << 21  # symbols from here on are code points that no piece holds
_PROBES = ("a", "", " ", "  x\ty\r\n", "ﬁ ½ Ａ́ x", "12▁ 3 \U0001f600中\x00", "the  quick   brown    fox" + " " * 40)


@dataclass(frozen=True)
class Pieces:
    """model: file of a BPE model of the sentencepiece library; None: piece_bpe_32k.model of public_tokenizers. end: whether the end id follows."""

    model: str | None = None
    end: bool = True


class Pairs:
    """Where pairs of symbols stand in a list of them: open addressing, many lookups at once."""

    def __init__(self, pairs: np.ndarray):
        self.shift = np.uint64(64 - max(8, (16 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.places, self.last = np.full(size, -1), np.zeros(size, np.int64), size - 1
        slot, todo = self.slot(pairs), np.arange(len(pairs))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = pairs[free]  # of several, one stays
            put = self.keys[slot[todo]] == pairs[todo]
            self.places[slot[todo[put]]] = todo[put]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & self.last

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The places of pairs; -1 for others."""
        slot = self.slot(pairs)
        key = self.keys[slot]
        out = np.where(key == pairs, self.places[slot], -1)
        todo = np.flatnonzero((key != pairs) & (key >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.last
            key = self.keys[slot[todo]]
            hit = key == pairs[todo]
            out[todo[hit]] = self.places[slot[todo[hit]]]
            todo = todo[~hit & (key >= 0)]
        return out


class Encoder:
    """Encodes words by merges, all words of a batch at once.

    A word is a blank and what follows up to the next one: no piece goes on over a blank. In a round each word's pair of
    least rank is found by a segmented minimum and merged wherever it stands in the word, from the left; the arrays are
    then compacted. That equals one merge at a time unless a merge makes a pair of no higher rank. Where the vocabulary
    has such a piece, occurrences within twice the longest piece of each other wait for later rounds; those further
    apart can't meet. Ids of words are kept in a bounded table, so frequent words are merged once as a rule; the bound
    changes the work, never the ids.
    """

    def __init__(self, path: str | None, keep: int = 200_000, keep_chars: int = 1 << 23):
        from sentencepiece import SentencePieceProcessor

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = np.array([sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) for i in range(n)])
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = np.flatnonzero(~special).tolist()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not supported")
        self.end = sp.eos_id()
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        symbol = {text[i]: i for i in plain}
        for c in sorted({c for i in plain for c in text[i]} - symbol.keys()):
            symbol[c] = n + len(symbol)
        self.size = n
        levels = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        level = {text[i]: levels[sp.get_score(i)] for i in plain}
        pairs = {(symbol[p[:k]], symbol[p[k:]]): p for p in level for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.pairs = Pairs(np.array([(a << 32) | b for a, b in pairs], np.int64))
        self.made = np.array([symbol[p] for p in pairs.values()] + [0], np.int64)
        self.none = len(levels)  # the rank of pairs that don't merge
        self.rank = np.array([level[p] for p in pairs.values()] + [self.none], np.int64)
        self.longest = max(len(p) for p in level)
        # levels with a piece that is a part of a pair of no higher rank
        self.early = np.zeros(len(levels) + 1, bool)
        for p in level:
            for k in range(1, len(p)):
                for x in (p[:k], p[k:]):
                    if x in level and len(x) > 1 and level[p] <= level[x]:
                        self.early[level[x]] = True
        points = np.array([ord(c) for c in symbol if len(c) == 1])
        self.char = np.arange(_OTHER, _OTHER + 0x110000)
        self.char[points] = [symbol[chr(c)] for c in points.tolist()]
        raw = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else t.replace(MARK, " ").encode() for i, t in enumerate(text)]
        self.lengths = np.array([len(r) for r in raw])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.shown = np.frombuffer(b"".join(raw), np.uint8)
        self.known: dict[str, bytes] = {}
        self.keep, self.keep_chars, self.chars = keep, keep_chars, 0
        self.blank = symbol[MARK]
        # pieces of blanks alone share the last level and no other piece has a blank after its first character: then a
        # run of blanks is merged after all else, and from the left, so that it falls into equal blocks
        blanks = [p for p in level if set(p) == {MARK} and len(p) > 1]
        last = {p for p in level if level[p] == len(levels) - 1 and len(p) > 1}
        if last != set(blanks) or any(MARK in p[1:] for p in level if p not in last):
            raise ValueError("pieces of blanks of other kinds are not supported")
        self.block = self.longest
        merged = lambda k: self._merged([MARK * k])[0].astype("<i4")
        self.block = len(text[int(merged(2 * self.longest)[0])])
        self.runs = [merged(k).tobytes() if k else b"" for k in range(self.block + 1)]
        for t in _PROBES:
            if self([t])[0].tolist() != sp.encode(t, add_eos=True) or self.decode([self([t])[0]])[0] != sp.decode(sp.encode(t)):
                raise ValueError(f"{path}: its normalization is not supported")

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has; blanks are marks here, and no word is empty."""
        sign = self.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        place = np.arange(len(sign))
        # of each symbol, the number of the pair that it is the first of
        pair = np.append(np.where(word[1:] == word[:-1], self.pairs.find((sign[:-1] << 32) | sign[1:]), -1), -1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sign):
            rank = self.rank[pair]
            new = np.concatenate([[True], word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1]
            stays = least < self.none
            done.append((sign[~stays], word[~stays]))
            hit = np.flatnonzero((rank == least) & stays)
            if not len(hit):
                break
            first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            fresh = first | np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            apart = first | np.concatenate([[True], place[hit[1:]] - place[hit[:-1]] >= 2 * self.longest])
            hit = hit[np.where(self.early[rank[hit]], apart, nth % 2 == 0)]
            sign[hit] = self.made[pair[hit]]
            pair[hit] = -2
            stays[hit + 1] = False
            sign, word, place, pair = sign[stays], word[stays], place[stays], pair[stays]
            hit = np.flatnonzero(pair == -2)
            ask = np.concatenate([hit, hit[hit > 0] - 1])
            after = np.minimum(ask + 1, len(sign) - 1)
            pair[ask] = np.where((word[ask] == word[after]) & (ask < after), self.pairs.find((sign[ask] << 32) | sign[after]), -1)
        sign, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return self._ids(sign[order], word[order], len(words))

    def _codes(self, sign: np.ndarray) -> list[bytes]:
        return [self._named[s].encode() if s < _OTHER else chr(s - _OTHER).encode() for s in sign.tolist()]

    @property
    def _named(self) -> dict[int, str]:
        """Characters that are no pieces themselves but stand in some, by symbol."""
        if not hasattr(self, "_names"):
            found = np.flatnonzero((self.char >= self.size) & (self.char < _OTHER))
            self._names = dict(zip(self.char[found].tolist(), map(chr, found.tolist()), strict=True))
        return self._names

    def _ids(self, sign: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One id a symbol, or one a byte of a character without piece."""
        odd = sign >= self.size
        if not odd.any():
            return sign, np.bincount(word, minlength=n)
        codes = self._codes(sign[odd])
        width = np.ones(len(sign), np.int64)
        width[odd] = [len(c) for c in codes]
        out = np.repeat(sign, width)
        out[np.repeat(odd, width)] = self.bytes[np.frombuffer(b"".join(codes), np.uint8)]
        return out, np.bincount(word, width, n).astype(np.int64)

    def _learn(self, units: list[str]) -> None:
        """Adds ids, as bytes of 32-bit words, of units: blanks and what follows."""
        ids, sizes = self._merged([MARK + u.lstrip(" ") for u in units])
        ends = np.cumsum(sizes)
        bare = (ids[ends - sizes] == self.blank).tolist()  # its blank is merged with nothing
        raw, known = ids.astype("<i4").tobytes(), self.known
        for u, a, b, alone in zip(units, (4 * (ends - sizes)).tolist(), (4 * ends).tolist(), bare, strict=True):
            if alone or u.startswith("  "):
                blanks = len(u) - len(u.lstrip(" ")) - 1 + alone
                known[u] = self.runs[self.block] * (blanks // self.block) + self.runs[blanks % self.block] + raw[a + 4 * alone : b]
            else:
                known[u] = raw[a:b]

    def __call__(self, texts: list[str], end: bool = True) -> list[np.ndarray]:
        """Ids of each text; those of characters without piece are their bytes'."""
        units = [_UNIT.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.known) > self.keep or self.chars > self.keep_chars:
            self.known, self.chars = {}, 0
        new = set().union(*units).difference(self.known)
        if new:
            self.chars += sum(map(len, new))
            self._learn(list(new))
        tail, find = np.array([self.end] if end else [], "<i4").tobytes(), self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, some)) + tail, "<i4") for some in units]

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """Texts of rows of ids: their pieces one after another, without the blank put before each text. Control ids have no text."""
        ids = np.concatenate([*rows, np.zeros(0, np.int32)])
        size = self.lengths[ids]
        stop = np.cumsum(size)
        raw = self.shown[np.repeat(self.begins[ids] - (stop - size), size) + np.arange(int(size.sum()))].tobytes()
        ends = np.concatenate([[0], stop])[np.cumsum([0, *map(len, rows)])].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode("utf-8", "one_by_one") for a, b in zip(ends, ends[1:], strict=False)]


codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))
_encoders: dict[str | None, Encoder] = {}


def encoder_of(path: str | None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_SLICE = 1 << 20  # characters, or ids, that are worked on together; a longer text comes alone


def encode_documents(docs: DataFrame, config: Pieces = Pieces()) -> DataFrame:
    """(doc_id, ids): the ids of each text of docs(doc_id, text), as the sentencepiece library gives them without sampling.

    A null text is empty; an empty one has the end id alone. Whole texts of any length are encoded; a word of very many
    characters takes more rounds. Each row is a document of its own, whatever its doc_id; other columns are not read. An
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(config.model)
        for batch in batches:
            for some in batched(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: len(r[1]), _SLICE):
                ids = encoder([r[1] for r in some], config.end)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), flat], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, config: Pieces = Pieces()) -> DataFrame:
    """The columns of encoded(ids, ...) and decoded, the text that the ids stand for; bytes that are no character give U+FFFD. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(config.model)
        for batch in batches:
            at, column = 0, batch.column("ids")
            sizes = [n or 0 for n in column.value_lengths().to_pylist()] if len(batch) else []
            for some in batched(sizes, lambda n: n, _SLICE):
                part = batch.slice(at, len(some))
                at += len(some)
                flat = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                texts = encoder.decode(np.split(flat, np.cumsum(some)[:-1]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias("decoded")).schema)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_documents(encode_documents(read(spark, sf_dir, "documents")))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
