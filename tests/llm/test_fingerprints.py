"""Fingerprints against a plain version, and rows that share a doc_id."""

import base64
import random

import pytest

from leafmill.llm import fingerprint

P, BASES, WORD = 2**31 - 1, (1_000_003_249, 1_430_987_651), 2**64 - 1


def plain_hash(text):
    a, b = (sum((ord(c) + 1) * pow(base, i, P) for i, c in enumerate(text)) % P for base in BASES)
    return a << 31 | b


def plain_sketch(text):
    w = 8 if len(text) >= 16 else max(1, len(text) // 2)
    found = set()
    for i in range(len(text) - w + 1):
        x = plain_hash(text[i : i + w])
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WORD
        x = (x ^ x >> 27) * 0x94D049BB133111EB & WORD
        found.add((x ^ x >> 31) >> 24)
    return sorted(found)[:48]


def plain_print(text):
    return f"{len(text):x}.{plain_hash(text):x}." + base64.b64encode(b"".join(x.to_bytes(5, "little") for x in plain_sketch(text))).decode()


def plain_likeness(s, t):
    a, b = plain_sketch(s), plain_sketch(t)
    if not a or not b:
        return float(a == b)
    union = sorted({*a, *b})
    if max(len(a), len(b)) == 48:
        union = union[:48]
    return sum(x in a and x in b for x in union) / len(union)


def plain(pairs):
    pairs = sorted(((i, t or "") for i, t in pairs), key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))
    out = []
    for k, (i, t) in enumerate(pairs):
        n = pairs[(k + 1) % len(pairs)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out.append((i, len(t), plain_print(t), plain_print(e), 1.0 if t == e else plain_likeness(t, e), 1.0 if t == n else plain_likeness(t, n)))
    return sorted(map(repr, out))


def texts(n):
    rng = random.Random(10)
    words = [f"w{rng.randrange(500)}" for _ in range(2000)]
    return [" ".join(rng.sample(words, rng.choice([0, 1, 3, 8, 40]))) + rng.choice(["", "é", "😀"]) for _ in range(n)]


CASES = {
    "ascending": lambda t: [(i, x) for i, x in enumerate(t)],
    "one null id": lambda t: [(None, x) for x in t],
    "half of one id": lambda t: [(5 if i % 2 else i, x) for i, x in enumerate(t)],
    "wide ids": lambda t: [((-1) ** i * (2**63 - 1 - i), x) for i, x in enumerate(t)] + [(-(2**63), "a last one"), (None, "none at all"), (None, None)],
    "equal rows": lambda t: [(7, "the same text of some words")] * 40 + [(8, None)] * 20 + [(9, t[0])],
    "one": lambda t: [(3, "a single document")],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("part", [1 << 22, 400])
def test_fingerprints_by_hand(spark, case, part):
    pairs = CASES[case](texts(90))
    got = fingerprint.fingerprint_documents(spark.createDataFrame(pairs, "doc_id long, text string"), part).collect()
    assert sorted(repr((r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)) for r in got) == plain(pairs)


def test_parts_of_a_shared_id():
    rows = sorted((0, b"\x01" + t.encode()[:32], len(t)) for t in texts(400) if t)
    bounds = fingerprint._bounds(list(rows), 20)
    part = fingerprint._part_of(fingerprint.np.zeros(len(rows), int), [r[1] for r in rows], fingerprint.np.zeros(len(bounds), int), bounds)
    assert len(bounds) >= 15 and (fingerprint.np.diff(part) >= 0).all() and fingerprint.np.bincount(part).max() < 80
