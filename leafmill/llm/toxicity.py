"""Operator 5: toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import batched, byte_prefix, mix, powers, read, schema_of, word_spans


@dataclass(frozen=True)
class Neighbours:
    """examples: most labelled documents in the index, half of each label; calibration: most that fit the scores.

    nearest: examples that vote. block: examples of an index block. chunk: blocks that are scored at once. frequent: share
    of the examples above which a term's list is stored with its gaps. least: what a term counts that goes with neither label, beside the root of its chi-square.
    """

    examples: int = 2048
    calibration: int = 4096
    nearest: int = 16
    block: int = 64
    chunk: int = 12
    frequent: float = 0.125
    least: float = 0.01


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


#: Beside whole words, their beginnings of so many UTF-8 bytes are terms, so that inflected and compound words match.
STEMS = (4, 6)


def term_hashes(raw: list[bytes]) -> list[np.ndarray]:
    """Hashes of the terms of each lower-cased text: its words and their beginnings."""
    data = np.frombuffer(b" ".join(raw), np.uint8)
    start, end = word_spans(data)
    prefix, inverse = byte_prefix(data), powers(len(data) + 1)[1]
    at, terms = [start], [mix((prefix[end] - prefix[start]) * inverse[start])]
    for k in STEMS:
        s = start[end - start >= k]
        at.append(s)
        terms.append(mix((prefix[s + k] - prefix[s]) * inverse[s] + np.uint64(k)))
    out = []
    stop = np.cumsum([len(r) + 1 for r in raw])
    cuts = [np.concatenate([[0], np.searchsorted(x, stop)]).tolist() for x in at]
    for i in range(len(raw)):
        out.append(np.concatenate([t[c[i] : c[i + 1]] for t, c in zip(terms, cuts, strict=True)]))
    return out


def _texts(batches: Iterator[pa.RecordBatch], texts: Callable[[pa.RecordBatch], pa.Array] = lambda b: b.column("text")) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the term hashes of each text; only a slice's texts are Python strings at a time."""
    for batch in batches:
        column = texts(batch)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for some in batched(range(len(sizes)), sizes.__getitem__, 1 << 19):
            yield batch.slice(some[0], len(some)), term_hashes([(t or "").lower().encode() for t in column.slice(some[0], len(some)).to_pylist()])


class Index:
    """Examples as unit TF-IDF vectors over all their terms: inverted lists by term, parted into blocks of examples, with the largest weight of each list and block.

    A term weighs (1 + log times) * idf * salience, the last learnt from the examples' labels. Terms in no example have
    the idf of a term of one document and the least salience; they count in a text's length. A query's products with
    the largest weights bound its cosine with all examples of a block. Terms of a large share of the examples have their
    lists stored with gaps; their part of all cosines is one product for many texts, exact before any bound. Blocks are taken from the highest bound down
    until the next bound is under the nearest-th cosine found, so the nearest are exact.
    """

    def __init__(self, terms: np.ndarray, weights: np.ndarray, other: float, ids: list[int], labels: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], config: Neighbours):
        self.terms, self.weights, self.other, self.config = terms, weights.astype(np.float32), other, config
        vectors = [self.weigh(*c) for c in counts]
        # alike examples stand together, so that the bounds of most blocks are low
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted((i for i, (t, _) in enumerate(vectors) if len(t)), key=lambda i: (labels[i], lead[i], ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.rows = [vectors[i] for i in order]
        self.lists: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lists": None}  # made anew where the index is used

    def inverted(self) -> tuple[np.ndarray, ...]:
        """(first, most, place, weight): where the list of a term and block starts, its largest weight; the lists; then
        (number, full): each frequent term's number, -1 for others, and the frequent terms' lists with their gaps."""
        if self.lists is None:
            n = -(-len(self.rows) // self.config.block)
            term = np.concatenate([t for t, _ in self.rows] or [np.zeros(0, np.int64)])
            place = np.repeat(np.arange(len(self.rows), dtype=np.int32), [len(t) for t, _ in self.rows])
            weight = np.concatenate([w for _, w in self.rows] or [np.zeros(0, np.float32)])
            often = np.bincount(term, minlength=len(self.terms)) > self.config.frequent * len(self.rows)
            number = np.where(often, np.cumsum(often) - 1, -1)
            full = np.zeros((int(often.sum()), len(self.rows)), np.float32)
            full[number[term[often[term]]], place[often[term]]] = weight[often[term]]
            by = np.lexsort((place, term))
            term, place, weight = term[by], place[by], weight[by]
            cell = term * n + place // self.config.block
            first = np.zeros(len(self.terms) * n + 1, np.int32)
            np.cumsum(np.bincount(cell, minlength=len(self.terms) * n), out=first[1:])
            most = np.zeros(len(self.terms) * n, np.float32)
            np.maximum.at(most, cell, weight)
            self.lists = first, most.reshape(len(self.terms), n), place, weight, number, full
        return self.lists

    def weigh(self, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of known terms, weights) of a text's distinct terms; the text as a whole has length 1."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        known = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        w = 1 + np.log(times)
        w *= np.where(known, self.weights[at], self.other) if len(self.terms) else self.other
        w /= np.sqrt(w @ w)
        return at[known], w[known].astype(np.float32)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (terms, weights): (places, cosines) of the nearest examples that share a term, nearest first."""
        number, full = self.inverted()[4:]
        if not len(self.rows):
            return [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(texts)
        known = np.zeros((len(texts), len(full)), np.float32)
        for row, (terms, weights) in zip(known, texts, strict=True):
            at = number[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return [self._nearest(*self._rare(t), row) for t, row in zip(texts, known @ full, strict=True)]

    def _rare(self, text: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rare = self.inverted()[4][text[0]] < 0
        return text[0][rare], text[1][rare]

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """part: the frequent terms' part of the cosines with all examples; terms are the others."""
        first, most, place, weight = self.inverted()[:4]
        k, size, n = self.config.nearest, self.config.block, most.shape[1]
        places, cosines = np.zeros(0, np.int64), np.zeros(0, np.float32)
        bound = np.maximum.reduceat(part, np.arange(0, len(part), size)) + weights @ most[terms]
        blocks = np.argsort(-bound, kind="stable")
        blocks = blocks[bound[blocks] > 0]
        base = terms * n
        for i in range(0, len(blocks), self.config.chunk):
            some = blocks[i : i + self.config.chunk]
            if len(cosines) == k:
                some = some[bound[some] >= cosines.min() - 1e-5]
                if not len(some):
                    break
            cell = (base[:, None] + some).ravel()
            start = first[cell]
            length = first[cell + 1] - start
            live = np.flatnonzero(length)
            start, length = start[live], length[live]
            at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            got = np.bincount(place[at], weight[at] * np.repeat(weights[live // len(some)], length), len(part))
            at = (some[:, None] * size + np.arange(size)).ravel()
            at = at[at < len(part)]
            both = got[at] + part[at]
            at, both = at[both > 0], both[both > 0]
            places, cosines = np.concatenate([places, at]), np.concatenate([cosines, both])
            if len(places) > k:
                near = np.flatnonzero(cosines >= np.partition(cosines, -k)[-k])
                near = near[np.lexsort((places[near], -cosines[near]))][:k]
                places, cosines = places[near], cosines[near]
        order = np.lexsort((places, -cosines))
        return places[order], cosines[order]

    def votes(self, hashes: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each text (share of the nearest examples' votes for label 1, by closeness; -1 without any), their places, cosines."""
        out = []
        for places, cosines in self.nearest([self.weigh(*np.unique(h, return_counts=True)) for h in hashes]):
            w = 1 / (1.05 - np.minimum(cosines.astype(np.float64), 1))
            out.append((float(w @ self.labels[places] / w.sum()) if len(places) else -1.0, places, cosines))
        return out


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function of x that fits y best (pooled neighbours), with a bit of smoothing."""
    levels: list[list[float]] = []
    for v in np.unique(x):
        at = x == v
        levels.append([float(y[at].sum()), float(at.sum()), float(v)])
        while len(levels) > 1 and levels[-2][0] / levels[-2][1] >= levels[-1][0] / levels[-1][1]:
            s, n, _ = levels.pop()
            levels[-1][0] += s
            levels[-1][1] += n
    return np.array([v for _, _, v in levels]), np.array([(s + 0.5) / (n + 1) for s, n, _ in levels])


def _sampled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a bounded sample ids(doc_id, toxic), one for each distinct text and label."""
    return docs.join(F.broadcast(ids), "doc_id").dropDuplicates(["text", "toxic"])


def train(docs: DataFrame, labels: DataFrame, config: Neighbours = Neighbours()) -> tuple[Broadcast, np.ndarray, np.ndarray]:
    """(index, votes, scores): an index of labelled examples, sent to the executors once, and the scores of rising votes.

    Labels come only from rows whose fold is not 0. Examples are the first by hash of the folds 2 to 4, half of each
    label; scores are fitted on the first by hash of fold 1, whose labels are as frequent as in the table. The document
    frequencies of all the examples' terms are counted over all documents. What passes the driver is bounded by the
    number of examples.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.withColumn("_fold", fold(F.col("doc_id"))).where("_fold <> 0")
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "toxic")
    half = config.examples // 2
    chosen = first(known.where("_fold > 1 and toxic = 1"), half).union(first(known.where("_fold > 1 and toxic = 0"), half))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _texts(batches):
            found = [np.unique(w, return_counts=True) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([t.tobytes() for t, _ in found]), pa.array([n.astype(np.int32).tobytes() for _, n in found])], ["doc_id", "toxic", "terms", "times"])

    rows = _sampled(docs, chosen).select("doc_id", "text", "toxic").mapInArrow(counted, "doc_id long, toxic int, terms binary, times binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    counts = [(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["times"], np.int32)) for r in rows]
    label = np.array([r["toxic"] for r in rows], np.int64)
    terms = np.unique(np.concatenate([t for t, _ in counts] or [np.zeros(0, np.uint64)]))
    pos, neg = int(label.sum()), int((1 - label).sum())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(len(terms) + 1, np.int64)
        for batch, words in _texts(batches):
            total += batch.num_rows
            for w in words:
                w = np.unique(w)
                at = np.searchsorted(terms, w)
                at[at == len(terms)] = 0
                df[at[terms[at] == w]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], ["term", "n"])

    df, total = np.zeros(len(terms)), 0
    if len(terms):
        found = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        at, n = found.column("term").to_numpy(), found.column("n").to_numpy()
        df[at[at >= 0]], total = n[at >= 0], int(n[at < 0].sum())
    idf = lambda n: np.log((1 + total) / (1 + n)) + 1
    a = np.bincount(np.concatenate([np.searchsorted(terms, t) for (t, _), y in zip(counts, label, strict=True) if y] or [np.zeros(0, np.int64)]), minlength=len(terms)).astype(float)
    both = np.bincount(np.concatenate([np.searchsorted(terms, t) for t, _ in counts] or [np.zeros(0, np.int64)]), minlength=len(terms)).astype(float)
    square = (pos + neg) * (a * neg - (both - a) * pos) ** 2 / np.maximum(float(pos) * neg * both * np.maximum(pos + neg - both, 1), 1)
    index = Index(terms, idf(df) * (np.sqrt(square) + config.least), float(idf(1) * config.least), [r["doc_id"] for r in rows], label, counts, config)
    held = docs.sparkSession.sparkContext.broadcast(index)
    if not pos or not neg:
        return held, np.array([-1.0]), np.array([pos / (pos + neg) if pos + neg else 0.0])

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _, _ in held.value.votes(words)], pa.float64()), batch.column(2)], ["vote", "toxic"])

    fitted = _sampled(docs, first(known.where("_fold = 1"), config.calibration)).select("doc_id", "text", "toxic").repartition(64).mapInArrow(voted, "vote double, toxic int").collect()
    if not fitted:
        return held, np.array([-1.0]), np.array([pos / (pos + neg)])
    votes, scores = rising(np.array([r["vote"] for r in fitted]), np.array([r["toxic"] for r in fitted], float))
    return held, votes, scores


def score_documents(docs: DataFrame, labels: DataFrame, config: Neighbours = Neighbours(), carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted, vote, neighbours, cosines) for each row of docs(doc_id, text, ...).

    score, 0 to 1, rises with the votes of the nearest examples; texts without terms (also null and empty ones), or that
    share none with any example, have the score of such texts. neighbours and cosines are the three nearest examples,
    as evidence. Only the text decides, all of it, however long. Without labels of both kinds all scores are the share
    of label 1. An empty table gives no rows; repeated rows have equal scores. carry: add the rows as a struct, row.
    """
    held, votes, scores = train(docs, labels, config)
    at = [c.lower() for c in docs.columns].index("text")
    texts = (lambda b: b.column("row").field(at)) if carry else (lambda b: b.column("text"))
    last = ["row"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch, words in _texts(batches, texts):
            out = index.votes(words)
            vote = np.array([v for v, _, _ in out])
            score = scores[np.maximum(np.searchsorted(votes, vote, "right") - 1, 0)]
            new = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(vote, pa.float64()), pa.array([index.ids[p[:3]].tolist() for _, p, _ in out], pa.list_(pa.int64())), pa.array([c[:3].astype(float).tolist() for _, _, c in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *new, *map(batch.column, last)], ["doc_id", "held_out", "score", "predicted", "vote", "neighbours", "cosines", *last])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.col("text").alias("text"))
    ddl = "doc_id long, held_out boolean, score double, predicted int, vote double, neighbours array<long>, cosines array<double>"
    return rows.mapInArrow(run, schema_of(ddl, rows.schema["row"].dataType if carry else None))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
