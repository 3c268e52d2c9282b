"""Operator 13: fill-in-middle transformation; one automaton finds where the class of characters changes, and sentinels."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import batched, read

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Classes of characters: the sentinels' five, other ASCII letters, all else, and the mark between texts.
_CLASSES = "<>PSMao|"
_LETTERS, _REST = "PSMa", "<>o|"
_OF = np.full(128, _CLASSES.index("o"), np.uint8)
_OF[[*range(65, 91), *range(97, 123)]] = _CLASSES.index("a")
_OF[[ord(c) for c in "<>PSM"]] = range(5)
_MARK = _CLASSES.index("|")


@dataclass(frozen=True)
class Fim:
    """plain_from: documents whose third draw modulo 100 is from here on stay as they are. spm_below: fourth draw modulo 100 below
    which the suffix comes first. salt: before the doc_id in what is hashed."""

    plain_from: int = 90
    spm_below: int = 20
    salt: str = "1:"


class Automaton:
    """Aho-Corasick automaton of words over an alphabet, and its output for each window as long as the longest word.

    The state after a character follows from as many characters as the longest word has, so all of a text's outputs are
    read off the windows at once. A word's number k is bit k of the output.
    """

    def __init__(self, words: list[tuple[str, int]], alphabet: str):
        goto: list[dict[str, int]] = [{}]
        out, fail = [0], [0]
        for word, bit in words:
            at = 0
            for c in word:
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    out.append(0)
                    fail.append(0)
                at = goto[at][c]
            out[at] |= 1 << bit
        todo = deque(goto[0].values())
        full = [{c: goto[0].get(c, 0) for c in alphabet}] + [{} for _ in goto[1:]]
        while todo:
            at = todo.popleft()
            out[at] |= out[fail[at]]
            for c in alphabet:
                if c in goto[at]:
                    fail[goto[at][c]] = full[fail[at]][c]
                    todo.append(goto[at][c])
                full[at][c] = goto[at].get(c, full[fail[at]][c])
        self.width, self.size = max(len(w) for w, _ in words), len(alphabet)
        states = [0]
        for _ in range(self.width):
            states = [full[s][c] for s in states for c in alphabet]
        self.table = np.array([out[s] for s in states], np.uint8)

    def scan(self, classes: np.ndarray, first: int) -> np.ndarray:
        """The output after each character; first stands for what is before the text."""
        seen = np.concatenate([np.full(self.width - 1, first, np.uint8), classes])
        code = np.zeros(len(classes), np.uint16)
        for k in range(self.width):
            code *= np.uint16(self.size)
            code += seen[k : k + len(classes)]
        return self.table[code]


_START, _END, _SENTINEL = 1, 2, 4
AUTOMATON = Automaton([*((b + a, 0) for a in _LETTERS for b in _REST), *((a + b, 1) for a in _LETTERS for b in _REST), *((s, 2) for s in SENTINELS)], _CLASSES)


class Events:
    """Texts as one row of code points, a mark before each and one after all; only events are kept.

    starts: first letters of runs. over: by how many letters runs up to each are longer than their one unit. sentinels:
    first characters of sentinels. marks: the marks.
    """

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.marks = np.concatenate([[0], np.cumsum(sizes + 1)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        classes = np.full(int(self.marks[-1]) + 1, _MARK, np.uint8)
        inside = np.ones(len(classes), bool)
        inside[self.marks] = False
        classes[inside] = np.where(codes < 128, _OF[np.minimum(codes, 127)], _CLASSES.index("o"))
        found = AUTOMATON.scan(classes, _MARK)
        at = np.flatnonzero(found)
        kind = found[at]
        self.starts = at[kind & _START > 0]
        self.over = np.cumsum(at[kind & _END > 0] - self.starts - 1)
        self.sentinels = at[kind & _SENTINEL > 0] - 2
        self.before = self.starts - np.concatenate([[0], self.over[:-1]])[: len(self.starts)]  # units before each run

    def _longer(self, runs: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], self.over])[runs]

    def units(self, place: np.ndarray) -> np.ndarray:
        """How many units (marks count) end before places outside of runs."""
        return place - self._longer(np.searchsorted(self.starts, place))

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Where that many units end."""
        return unit + self._longer(np.searchsorted(self.before, unit))


def draws(doc_id: int | None, salt: str) -> list[int]:
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def cut(ids: list[int | None], texts: list[str], config: Fim) -> list[tuple[int, str, int | None, int | None, str]]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    e = Events(texts)
    first = e.units(e.marks[:-1]) + 1
    n = e.units(e.marks[1:]) - first
    drawn = np.array([draws(i, config.salt) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    left, right = (e.places(first + cuts[:, k]) - e.marks[:-1] - 1 for k in (0, 1))
    holds = np.searchsorted(e.sentinels, e.marks[1:]) > np.searchsorted(e.sentinels, e.marks[:-1])
    plain = (n == 0) | holds | (drawn[:, 2] % 100 >= config.plain_from)
    spm = drawn[:, 3] % 100 < config.spm_below
    out: list[tuple[int, str, int | None, int | None, str]] = []
    for t, k, p, s, a, b in zip(texts, *(x.tolist() for x in (n, plain, spm, left, right)), strict=True):
        if p:
            out.append((k, "plain", None, None, t))
        elif s:
            out.append((k, "spm", a, b - a, f"{SUFFIX}{t[b:]}{PREFIX}{t[:a]}{MIDDLE}{t[a:b]}"))
        else:
            out.append((k, "psm", a, b - a, f"{PREFIX}{t[:a]}{SUFFIX}{t[b:]}{MIDDLE}{t[a:b]}"))
    return out


def joined(outputs: list[str], forms: list[str]) -> list[str]:
    """The texts that cut() made outputs from. Parts hold no sentinel, and none can begin in a part and end in what follows."""
    e = Events(outputs)
    at = np.searchsorted(e.sentinels, e.marks[:-1]).tolist()
    back = []
    for t, form, k, mark in zip(outputs, forms, at, e.marks.tolist(), strict=False):
        if form == "plain":
            back.append(t)
            continue
        _, second, third = (int(x) - mark - 1 for x in e.sentinels[k : k + 3])
        one, two, three = t[3:second], t[second + 3 : third], t[third + 3 :]
        back.append(one + three + two if form == "psm" else two + three + one)
    return back


_SLICE = 1 << 20  # code points that are worked on together; a longer text comes alone
_CUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, config: Fim = Fim()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text of docs(doc_id, text) with its middle moved to the end.

    Units are runs of ASCII letters and single other characters; n is their number. The draws of a document depend on
    its doc_id alone, so rows that share one are cut alike; a null doc_id is hashed as an empty one. A null text counts
    as empty, and an empty one is plain, as are texts that hold a sentinel. Whole texts are worked on, of any length;
    other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in batched(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: len(r[1]), _SLICE):
                ids, texts = [r[0] for r in some], [r[1] for r in some]
                columns = zip(*cut(ids, texts, config), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip((ids, *columns), _CUT.types, strict=True)], schema=_CUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """The columns of made, as fill_in_middle() gives them, with the texts rebuilt from output and form alone: restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            outputs, forms = (batch.column(c).to_pylist() for c in ("output", "form"))
            for some in batched(zip(outputs, forms, strict=True), lambda r: len(r[0]), _SLICE):
                back = pa.array(joined([r[0] for r in some], [r[1] for r in some]), pa.string())
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([*part.columns, back], names=[*part.schema.names, "restored"])

    return made.mapInArrow(run, made.select("*", F.lit("").alias("restored")).schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(read(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN [0, 1, 2, 3]] AS d FROM units
), cuts AS (
    SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain'
                WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
