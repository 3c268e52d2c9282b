"""Operator 10: document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import mix, read, stage, unstage

PRIME = (1 << 31) - 1
#: Two bases modulo the Mersenne prime 2 ** 31 - 1; together a span's hash has 62 bits.
BASES = (1_000_003_249, 1_430_987_651)
_M, _S = np.uint64(PRIME), np.uint64(31)
_ONE = np.ones(1, np.uint64)
_tables: dict[tuple[int, bool], np.ndarray] = {}

WINDOW, SKETCH = 8, 48


def _halve(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME up to one PRIME more: below 2 ** 32 or so, for x below 2 ** 63. x is used up."""
    high = x >> _S
    x &= _M
    x += high
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    x = _halve(_halve(x))
    return np.where(x >= _M, x - _M, x)


def _power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** i (or base ** -i) modulo PRIME for i < n at least, by doubling."""
    have = _tables.get((base, inverse), _ONE)
    if len(have) >= n:
        return have
    step = pow(base, -1 if inverse else 1, PRIME)
    while len(have) < n:
        have = np.concatenate([have, _fold(have * np.uint64(pow(step, len(have), PRIME)))])
    _tables[base, inverse] = have
    return have


class PrefixHash:
    """Modular prefix arrays of a text: any span's hash in constant time, extensions by binary search."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.prefix = []
        for base in BASES:
            p = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_halve(codes * _power(base, self.n)[: self.n]), out=p[1:])
            self.prefix.append(_fold(p))

    def spans(self, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        """62-bit hashes, free of the position, of the spans from start to end; at repeats start."""
        out = []
        for base, p in zip(BASES, self.prefix, strict=True):
            x = p[end] + _M
            x -= p[start]
            x *= _power(base, self.n + 1, True)[at]
            out.append(_fold(x))
        return (out[0] << _S) | out[1]

    def span(self, start: int, end: int) -> int:
        a, b = ((int(p[end]) - int(p[start])) * int(_power(base, self.n + 1, True)[start]) % PRIME for base, p in zip(BASES, self.prefix, strict=True))
        return (a << 31) | b

    def windows(self, w: int) -> np.ndarray:
        """Mixed hashes of all windows of w code points."""
        k = self.n - w + 1
        return mix(self.spans(slice(0, k), slice(w, w + k), slice(0, k))) if k > 0 else np.zeros(0, np.uint64)


def span_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common extension of a from i and b from j, by binary search on span equality."""
    low, high, step = 0, min(a.n - i, b.n - j), 1
    while step <= high and span_equal(a, i, b, j, step):
        low, step = step, 2 * step
    high = min(high, step - 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if span_equal(a, i, b, j, mid) else (low, mid - 1)
    return low


def window_of(n: int) -> int:
    return WINDOW if n >= 2 * WINDOW else max(1, n // 2)


def _bottom(h: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct 40-bit hashes, sorted."""
    h = h >> np.uint64(24)
    if len(h) > 8 * SKETCH:
        low = _distinct(np.partition(h, 2 * SKETCH)[: 2 * SKETCH])
        if len(low) >= SKETCH:
            return low[:SKETCH]
    return _distinct(h)[:SKETCH]


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _text_of(n: int, whole: int, low: np.ndarray) -> str:
    packed = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return f"{n:x}.{whole:x}.{base64.b64encode(packed).decode()}"


def fingerprint(text: str) -> str:
    p = PrefixHash(text)
    return _text_of(p.n, p.span(0, p.n), _bottom(p.windows(window_of(p.n))))


def sketch_of(fp: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fp.rpartition(".")[2]), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    size = len(both) - int(again.sum())
    if max(len(a), len(b)) >= SKETCH and size > SKETCH:
        union = both[np.concatenate([[True], ~again])]
        return float((both[1:][again] <= union[SKETCH - 1]).sum() / SKETCH)
    return float(again.sum() / size)


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness, 0 to 1, of the windows of two fingerprinted texts; 1 for equal fingerprints."""
    return 1.0 if a == b else _alike(sketch_of(a), sketch_of(b))


class _Doc:
    """A text with its prefix arrays, windows and fingerprint, each made once."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.hash = PrefixHash(text)
        self.n = self.hash.n
        self.w = window_of(self.n)
        self.windows = self.hash.windows(self.w)
        self.low = _bottom(self.windows)
        self.print = _text_of(self.n, self.hash.span(0, self.n), self.low)


def _edited(a: _Doc, b: _Doc) -> dict:
    """The row of a, whose next document is b."""
    half = a.n // 2
    m, got = a.n - half, min(half, b.n)
    text = a.text[:m] + b.text[:got]
    w = window_of(m + got)
    if w == a.w == b.w and min(m, got) >= w:
        cross = PrefixHash(a.text[m - w + 1 : m] + b.text[: w - 1]).windows(w)
        low = _bottom(np.concatenate([a.windows[: m - w + 1], cross, b.windows[: got - w + 1]]))
    else:
        low = _bottom(PrefixHash(text).windows(w))
    fp = _text_of(m + got, _joined(a.hash, m, b.hash, got), low)
    same = common_extension(a.hash, m, b.hash, 0)
    return {
        "doc_id": a.doc_id, "n_chars": a.n, "edited_sha256": hashlib.sha256(text.encode()).hexdigest(), "fingerprint": a.print, "edited_fingerprint": fp,
        "near_edited": 1.0 if fp == a.print else _alike(a.low, low), "near_next": 1.0 if a.print == b.print else _alike(a.low, b.low), "first_change": min(m + min(same, got), a.n),
    }


def _joined(a: PrefixHash, m: int, b: PrefixHash, got: int) -> int:
    """The hash of a's first m code points followed by b's first got, from the prefix arrays alone."""
    out = []
    for base, p, q in zip(BASES, a.prefix, b.prefix, strict=True):
        out.append((int(p[m]) + pow(base, m, PRIME) * int(q[got])) % PRIME)
    return (out[0] << 31) | out[1]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_change long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("first_change", pa.int64())])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, helpers of a part last; each row but a helper is followed by its next document."""
    last: _Doc | None = None
    part, out = None, []
    for batch in batches:
        for k, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_part", "_extra", "doc_id", "text")), strict=True):
            now = _Doc(doc_id, text)
            if last is not None and k == part:
                out.append(_edited(last, now))
            last, part = (None if extra else now), k
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
                out = []
    yield pa.RecordBatch.from_pylist(out, _ARROW)


#: Bytes of a text that part rows of one doc_id; parts at most, whose bounds and first keys pass the driver.
LEAD, PARTS = 32, 1 << 15
#: Keys that are sampled for each part.
SAMPLED = 8


def _key_columns() -> list[Column]:
    """The order of rows as an ascending pair: the inverted doc_id, and whether it is null before the text's first bytes."""
    turned = F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1)).alias("_a")
    lead = F.concat(F.when(F.col("doc_id").isNull(), F.lit(b"\x01")).otherwise(F.lit(b"\x00")), F.substring(F.col("text").cast("binary"), 1, LEAD)).alias("_b")
    return [turned, lead]


def _bounds(sample: list[tuple[int, bytes, int]], parts: int) -> list[tuple[int, bytes]]:
    """First keys of all parts but the first, where a sample of (_a, _b, bytes) has equal shares of its bytes."""
    sample.sort()
    at = np.cumsum([size for _, _, size in sample])
    picked = np.unique(np.searchsorted(at, at[-1] * np.arange(1, parts) / parts)) if sample else []
    return sorted({sample[i][:2] for i in picked})


def _part_of(a: np.ndarray, b: list[bytes], firsts: np.ndarray, bounds: list[tuple[int, bytes]]) -> np.ndarray:
    """The part of each key (a, b): the number of bounds up to it. firsts: the bounds' _a."""
    part = np.searchsorted(firsts, a, "left")
    for i in np.flatnonzero(part < np.searchsorted(firsts, a, "right")):
        part[i] = bisect.bisect_right(bounds, (int(a[i]), b[i]))
    return part.astype(np.int32)


def fingerprint_documents(docs: DataFrame, part_bytes: int = 6 << 20) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses (see SCHEMA).

    The next document is that of the next smaller doc_id, and the first one's after the last. doc_id null comes last;
    rows of one doc_id follow each other by text; equal rows are rows of their own. A null text counts as empty; a very
    long text is a row like others, of which a task holds two at a time. An empty table gives no rows; columns other
    than doc_id and text may have any names.

    Rows are dealt by doc_id and the first LEAD bytes of the text to contiguous parts of about part_bytes, PARTS at
    most, so a doc_id (or null) that many texts share is parted too. A part is read as a stream, whatever its size. The
    keys are staged; a sample of SAMPLED keys a part gives the bounds, then each part's first key is taken exactly, and
    its row goes to the part before as a helper. So the texts are shuffled once, no task waits for another, and what
    passes the driver is bounded by PARTS. first_change is the first code point where the edited text differs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = stage(docs.select(*_key_columns(), (F.octet_length("text") + 1).cast("long").alias("size")), "keys")
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    if not n:
        unstage(keys)
        return docs.sparkSession.createDataFrame([], SCHEMA)
    parts = min(PARTS, n, -(-total // part_bytes))
    some = keys if n <= SAMPLED * parts else keys.sample(SAMPLED * parts / n, 10)
    bounds = _bounds([(r[0], bytes(r[1]), r[2]) for r in some.collect()], parts) if parts > 1 else []
    firsts = np.array([a for a, _ in bounds], np.int64)

    @F.pandas_udf("int")
    def part_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_part_of(a.to_numpy(), b.tolist(), firsts, bounds))

    heads = keys.groupBy(part_of("_a", "_b").alias("part")).agg(F.min(F.struct("_a", "_b")).alias("head"))
    heads = {r[0]: (r[1][0], bytes(r[1][1])) for r in heads.collect()}
    unstage(keys)
    filled = sorted(heads)
    before = dict(zip(filled, [filled[-1], *filled[:-1]], strict=True))  # the part whose last row is followed by a part's first

    @F.pandas_udf("part int, before int")
    def dealt(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        part = _part_of(a.to_numpy(), b.tolist(), firsts, bounds)
        first = [before[p] if heads[p] == key else None for p, key in zip(part.tolist(), zip(a.tolist(), b.tolist()))]
        return pd.DataFrame({"part": part, "before": pd.array(first, "Int32")})

    own = F.struct(F.col("_deal.part").alias("part"), F.lit(False).alias("extra"))
    helper = F.struct(F.col("_deal.before").alias("part"), F.lit(True).alias("extra"))
    rows = (
        docs.withColumn("_deal", dealt(*_key_columns()))
        .withColumn("_to", F.explode(F.when(F.col("_deal.before").isNull(), F.array(own)).otherwise(F.array(own, helper))))
        .select(F.col("_to.part").alias("_part"), F.col("_to.extra").alias("_extra"), "doc_id", "text")
        .repartition("_part")
        .sortWithinPartitions("_part", "_extra", F.col("doc_id").desc_nulls_last(), "text")
    )
    return rows.mapInArrow(_follow, SCHEMA)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))
