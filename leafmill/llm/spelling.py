"""Operator 11: spelling variants; each word's distance-one automaton is followed through broadcast shards of a trie."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import batched, read, stage, unstage


@dataclass(frozen=True)
class Spelling:
    """letters: the class of a word's characters. shortest: least length. least: least occurrences. ratio: how many times
    a word's occurrences its form has at least. drop_every: a character goes where this divides a run's hash (0: never).
    shard_words: words of a trie shard. wave_bytes: shards that are broadcast at once, at most. block: words that are
    followed through a shard together, and of a task, about.
    """

    letters: str = "A-Za-zÀ-ÿ"
    shortest: int = 7
    least: int = 2
    ratio: int = 10
    drop_every: int = 31
    shard_words: int = 1 << 18
    wave_bytes: int = 64 << 20
    block: int = 1 << 15


def word_counts(docs: DataFrame, config: Spelling = Spelling()) -> DataFrame:
    """(word, n): the words of docs(doc_id, text) that occur config.least times or more, as the docstring of variants() has it."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{config.letters}]{{{config.shortest},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    low = F.translate("run", upper, upper.lower())
    word = low
    if config.drop_every:
        rows = rows.select(low.alias("run"), F.crc32(F.concat("id", F.lit(":"), low).cast("binary")).alias("h"))
        at = F.pmod("h", F.char_length("run")).cast("int")
        word = F.when(F.col("h") % config.drop_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).where(F.char_length("word") >= config.shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= config.least)


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words one after another, where each begins, and lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes


class Trie:
    """A trie of sorted distinct words, its nodes numbered breadth first from the root, 0.

    keys[k] is parent * (letters + 1) + letter of node k + 1; in this order keys ascend, so a child is found by binary
    search and the children of a node stand together. leaf[k] is the word that ends at node k, or -1.
    """

    def __init__(self, alphabet: np.ndarray, keys: np.ndarray, leaf: np.ndarray):
        self.alphabet, self.keys, self.leaf = alphabet, keys, leaf
        self.width = len(alphabet) + 1  # the last letter stands for all others
        self.first = np.searchsorted(keys, np.arange(len(leaf) + 1, dtype=np.int64) * self.width)

    @staticmethod
    def of(words: list[str]) -> Trie:
        flat, start, sizes = _flat(words)
        alphabet = np.unique(flat)
        letters, width = np.searchsorted(alphabet, flat), len(alphabet) + 1
        live, at, total, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 1, 0
        keys, leaf = [], [np.full(1, -1, np.int32)]
        while len(live):
            key = at * width + letters[start[live] + depth]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            at = total + np.cumsum(new) - 1
            ends = sizes[live] == depth + 1
            here = np.full(int(new.sum()), -1, np.int32)
            here[at[ends] - total] = live[ends]
            keys.append(key[new])
            leaf.append(here)
            total, depth = total + len(here), depth + 1
            live, at = live[~ends], at[~ends]
        small = np.int32 if total * width < 2**31 else np.int64
        return Trie(alphabet, np.concatenate([*keys, np.zeros(0, np.int64)]).astype(small), np.concatenate(leaf))

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child of the letter, and these children."""
        key = (node * self.width + letter).astype(self.keys.dtype)
        at = np.searchsorted(self.keys, key)
        has = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        return has, at[has] + 1

    def near(self, flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """(query word, word of the trie) of each pair that differs by one inserted, deleted or replaced character.

        The automaton of a query has spent no edit or one. States without edit go down one node at a time; what they make
        with one edit is followed to its end before they go on. Of edits that make the same word one is taken, so no pair
        comes twice. At most about most states are held at once.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(self.keys) or not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        letters = np.searchsorted(self.alphabet, flat)
        letters[self.alphabet[np.minimum(letters, len(self.alphabet) - 1)] != flat] = len(self.alphabet)
        letters = np.append(letters, 0)

        def follow(word: np.ndarray, node: np.ndarray, at: int) -> None:
            while len(word):
                over = sizes[word] == at
                if over.any():
                    leaf = self.leaf[node[over]]
                    found.append((word[over][leaf >= 0], leaf[leaf >= 0]))
                    word, node = word[~over], node[~over]
                has, node = self.step(node, letters[start[word] + at])
                word, at = word[has], at + 1

        live, node, at = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), 0
        while len(live):
            more = sizes[live] > at
            letter = np.where(more, letters[start[live] + at * more], -1)
            fresh = more if not at else more & (letter != letters[start[live] + at - 1])
            follow(live[fresh], node[fresh], at + 1)  # deleted
            count = self.first[node + 1] - self.first[node]
            stop = np.cumsum(count)
            cuts = np.searchsorted(stop, np.arange(most, stop[-1] + most, most)) + 1
            for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
                own = np.repeat(np.arange(a, min(b, len(live))), count[a:b])
                if not len(own):
                    continue
                child = np.arange(len(own)) - (stop[own] - count[own] - (stop[a] - count[a])) + self.first[node[own]] + 1
                other = self.keys[child - 1] - node[own] * self.width != letter[own]
                own, child = own[other], child[other]
                follow(live[own], child, at)  # inserted
                swap = more[own]
                follow(live[own[swap]], child[swap], at + 1)  # replaced
            has, node = self.step(node[more], letter[more])
            live, at = live[more][has], at + 1
        return tuple(np.concatenate([x[k] for x in found] + [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))


_SHARD = "shard long, size long, words binary, n binary, alphabet binary, keys binary, wide boolean, leaf binary"


def trie_shards(words: DataFrame, config: Spelling = Spelling()) -> DataFrame:
    """A row for each config.shard_words words in order, as _SHARD has it; built in tasks, one shard at a time, and staged."""
    k = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = words.repartitionByRange(k, "word").sortWithinPartitions("word").withColumn("_at", F.monotonically_increasing_id())
    ranged = stage(ranged.withColumn("_part", F.shiftright("_at", 33)), "sorted")
    before, lines = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("_part").count().collect())):  # a row a partition
        lines.append((part, before))
        before += n
    offsets = words.sparkSession.createDataFrame(lines, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = ranged.join(F.broadcast(offsets), "_part").select(F.floor(rank / config.shard_words).alias("shard"), "word", "n")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")  # by bytes of UTF-8, which is the order of code points
        names = table.column("word").to_pylist()
        t = Trie.of(names)
        size = t.keys.nbytes + t.leaf.nbytes + t.alphabet.nbytes + 24 * len(names)
        row = {"shard": table.column("shard")[0].as_py(), "size": size, "words": "\n".join(names).encode(), "n": table.column("n").to_numpy().astype("<i8").tobytes()}
        row |= {"alphabet": t.alphabet.tobytes(), "keys": t.keys.tobytes(), "wide": t.keys.dtype == np.int64, "leaf": t.leaf.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int64()), ("size", pa.int64()), *((c, pa.binary()) for c in ("words", "n", "alphabet", "keys")), ("wide", pa.bool_()), ("leaf", pa.binary())]))

    out = stage(rows.groupBy("shard").applyInArrow(build, _SHARD), "tries")
    unstage(ranged)
    return out


_NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _through(shards: list, block: int):
    """For mapInArrow: each word's neighbours in shards, counted, and the best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = []
        for s in shards.value:
            trie = Trie(np.frombuffer(s["alphabet"], np.uint32), np.frombuffer(s["keys"], np.int64 if s["wide"] else np.int32), np.frombuffer(s["leaf"], np.int32))
            tries.append((trie, s["words"].decode().split("\n"), np.frombuffer(s["n"], "<i8")))
        for some in batched((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), lambda r: 1 + len(r[0]) // 64, block):
            words = [r[0] for r in some]
            flat, start, sizes = _flat(words)
            near, best_n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [None] * len(words)
            for trie, names, n in tries:
                word, leaf = trie.near(flat, start, sizes)
                near += np.bincount(word, minlength=len(words))
                order = np.lexsort((leaf, -n[leaf], word))
                word, leaf = word[order], leaf[order]
                first = np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]
                word, leaf = word[first], leaf[first]
                better = n[leaf] > best_n[word]  # shards follow in order, so that of equals the first stays
                for w, k in zip(word[better].tolist(), leaf[better].tolist(), strict=True):
                    best[w] = names[k]
                best_n[word[better]] = n[leaf[better]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((words, [r[1] for r in some], near, best_n, best), _NEAR.types, strict=True)], schema=_NEAR)

    return run


def neighbours(words: DataFrame, config: Spelling = Spelling()) -> DataFrame:
    """(word, n, n_near, best_n, best): for each of words(word, n), distinct, how many others are near and the most frequent of them (ties: the first)."""
    shards = trie_shards(words, config)
    dealt = words.select("word", "n").repartition(max(1, -(-words.count() // config.block)), "word")
    sizes = sorted(map(tuple, shards.select("shard", "size").collect()))  # a row a shard
    waves = []
    for some in batched(sizes, lambda r: r[1], config.wave_bytes):
        sent = words.sparkSession.sparkContext.broadcast([r.asDict() for r in shards.where(F.col("shard").between(some[0][0], some[-1][0])).orderBy("shard").collect()])
        waves.append(stage(dealt.mapInArrow(_through(sent, config.block), "word string, n long, n_near long, best_n long, best string"), "near"))
        sent.destroy()
    unstage(shards)
    if not waves:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = waves[0]
    for w in waves[1:]:
        every = every.unionAll(w)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    return every.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n", "n_near", (-F.col("_b.less")).alias("best_n"), F.col("_b.best").alias("best"))


def variants(docs: DataFrame, config: Spelling = Spelling()) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the words of docs(doc_id, text) with their near words and forms.

    Words are runs of config.letters with A to Z in small letters; where drop_every divides the CRC-32 of
    `<doc_id>:<run>`, the run's code point at the hash modulo its length is gone. Words count if they have
    config.shortest code points and config.least occurrences in all documents. Two are near if one inserted, deleted or
    replaced code point parts them. A word's form is its most frequent near word (ties: the first by code points) if that
    occurs config.ratio times as often at least; root is where the forms end, the word itself if it has none. Null texts
    have no words; a null doc_id is hashed as an empty one; repeated rows count again; words of any length are whole;
    other columns are not read. No words give no rows.

    Words are counted before they are shuffled. The vocabulary is kept in the shared folder in tries of
    config.shard_words words; the driver sends them on by waves of config.wave_bytes, and all words pass each wave.
    """
    words = stage(word_counts(docs, config), "words")
    form = F.when(F.col("best_n") >= config.ratio * F.col("n"), F.col("best"))
    near = stage(neighbours(words, config).select("word", "n", "n_near", form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    unstage(words)
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    old = None
    while True:  # each round doubles the links that are followed; occurrences grow by ratio a link, so rounds are few
        to = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        links = stage(links.join(to, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if old is not None:
            unstage(old)
        old = links
        if not links.where("moved").limit(1).count():
            break
    roots = links.select(F.col("word").alias("_word"), "root")
    return near.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


#: CRC-32 by half bytes: the table follows from the polynomial.
_CRC = []
for _k in range(16):
    for _ in range(4):
        _k = _k >> 1 ^ (0xEDB88320 if _k & 1 else 0)
    _CRC.append(_k)

OP11_SQL = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
), each AS (
    SELECT id, run, count(*) AS times, string_split(id || ':' || run, '') AS chars FROM runs GROUP BY id, run
), hashed AS (
    SELECT run, times, xor(list_reduce([4294967295] || flatten(flatten(list_transform(chars, lambda c: list_transform(
        CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END, lambda b: [CAST(b & 15 AS BIGINT), CAST(b >> 4 AS BIGINT)])))),
        lambda a, x: xor(a >> 4, {_CRC}[(xor(a, x) & 15) + 1])), 4294967295) AS h
    FROM each
), made AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed
), words AS MATERIALIZED (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), places AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), near AS (
    SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM places x JOIN places y USING (i, a, b) WHERE x.word <> y.word
    UNION
    SELECT DISTINCT x.word, x.n, y.word, y.n FROM places x JOIN words y ON x.a || x.b = y.word
    UNION
    SELECT DISTINCT y.word, y.n, x.word, x.n FROM places x JOIN words y ON x.a || x.b = y.word
), best AS (
    SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n FROM near GROUP BY word, n
), forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
), up AS (
    SELECT word, word AS root, 0 AS depth FROM forms
    UNION ALL
    SELECT up.word, f.form, depth + 1 FROM up JOIN forms f ON up.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(root, depth) AS root FROM up GROUP BY word) r USING (word)
"""
