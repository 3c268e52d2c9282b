"""The operators against plain versions of themselves, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import crossentropy, embeddings, fingerprint, jaccard, licenses, mixing, packing, revisits, suffixes, toxicity

DATA = "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", None), (None, "some words here and there", "b"), (3, "x" * 5000, "a"), (4, "same text of a few words", "a"), (4, "same text of a few words", "a"), (5, "Ünïcödé 😀 " * 40, "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators might use."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns({c: F.lit("z") for c in ("size", "shard", "n", "block", "component", "_text")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- fingerprints


def test_prefix_hash():
    a, b = fingerprint.PrefixHash("abcabcabd"), fingerprint.PrefixHash("zabcabdq")
    assert fingerprint.span_equal(a, 0, a, 3, 3) and not fingerprint.span_equal(a, 0, a, 3, 6)
    assert fingerprint.common_extension(a, 3, b, 1) == 6 and fingerprint.common_extension(a, 0, b, 0) == 0


def fingerprints(pairs):
    pairs = sorted(((i, t or "") for i, t in pairs), key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))
    out = []
    for k, (i, t) in enumerate(pairs):
        n = pairs[(k + 1) % len(pairs)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.fingerprint(t), fingerprint.fingerprint(e)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
@pytest.mark.parametrize("part", [1 << 22, 50_000])
def test_fingerprints(request, which, part):
    df = request.getfixturevalue(which)
    got = rows(fingerprint.fingerprint_documents(df, part))
    assert sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"])) for r in got) == fingerprints([(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    if which == "docs":
        assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.9


# ---- licenses


def test_licenses(spark):
    text = "Licensed under the Apache License, Version 2.0. CC-BY cc by! MIT License; spdx-license-identifier: BSD-3-Clause. GNU General Public License v3"
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "nothing of the kind", 0), (4, "mitlicense mit  LICENSE", 0)], "doc_id long, text string, size int")
    got = {(r["doc_id"], r["n_words"]): r for r in rows(licenses.digest(licenses.scan_licenses(df)))}
    r = next(v for k, v in got.items() if k[0] == 1)
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (5, 3, 20, "apache,cc-by,gpl,mit")
    assert "bsd" in r["labels"] and 0.9 <= r["score"] <= 1
    assert got[2, 0]["labels"] == "" and got[3, 0]["first_word"] is None and got[4, 4]["n_base"] == 0
    assert (got[4, 3]["n_base"], got[4, 3]["first_word"]) == (1, 1)
    found = {(d["rule"].split(":")[1], d["first_word"]) for d in rows(licenses.scan_licenses(df).where("doc_id = 1"))[0]["detections"] if d["label"] == "apache"}
    assert found == {("apache", 3), ("granted", 0)}  # the narrower ones lie within it


def alternatives(tree):
    """Texts that a parsed pattern matches: each branch and optional part both ways, sets by one member."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif name == "ANY":
            some = ["z"]
        elif name == "BRANCH":
            some = [t for branch in arg[1] for t in alternatives(branch)]
        elif name == "SUBPATTERN":
            some = alternatives(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            some = alternatives(arg[2]) + [""] * (arg[0] == 0)
        else:
            assert name == "ASSERT_NOT", name
            some = [""]
        out = [a + b for a in out for b in dict.fromkeys(some)]
    return out


def test_license_patterns_hold_their_keywords():
    from re import _parser

    lost = {r.name for r in licenses.default_rules() for t in alternatives(_parser.parse(r.pattern)) if f" {r.keyword}" not in f" {t} " or licenses.gate_of(r) not in t}
    assert not lost
    assert len(licenses.default_rules()) == len({r.name for r in licenses.default_rules()})


def plain_licenses(text):
    """Base columns of a text by one scan over its words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))


def test_licenses_of_documents(spark, docs, odd, empty):
    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for df in (every, odd.withColumn("detections", F.lit(1)), docs.union(docs), empty):
        texts = [r["text"] for r in df.select("text").collect()]
        got = rows(licenses.digest(licenses.scan_licenses(df)))
        assert sorted(repr((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got) == sorted(repr(plain_licenses(t)) for t in texts)
        assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)


def test_licenses_of_a_long_text(spark):
    """Many places and a text of a megabyte: suppression is by runs, and each place counts."""
    n = 20_000
    df = spark.createDataFrame([(1, "mit license and under the mit license; " * n), (2, "word " * 200_000 + "cc-by")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(licenses.digest(licenses.scan_licenses(df)))}
    assert (got[1]["n_base"], got[1]["n_detections"], got[2]["n_base"], got[2]["first_word"]) == (2 * n, 3 * n, 1, 200_000)


def test_license_names_and_long_clauses(spark):
    clause = "Neither the name of {} nor the names of its contributors may be used"
    holder = "the " + "very " * 2000 + "long institute"
    texts = ["Licensed under the X11 License", "the Expat license", clause.format(holder), "released under the GNU GPL v3", clause.format("A").replace("names", "name") + " and " + clause.format("B")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["detections"] for r in rows(licenses.scan_licenses(df))}
    assert [sorted({d["label"] for d in got[i]}) for i in range(4)] == [["mit"], ["mit"], ["bsd"], ["gpl"]]
    assert got[3][0]["priority"] == 4
    assert [(d["first_word"], d["phrase"]) for d in got[4]] == [(15, "neither the name of b nor the names of its contributors")]


# ---- mixing


def test_targets(spark):
    df = spark.createDataFrame([("a", 10), ("b", 90), (None, 100), ("c", 800)], "_source string, size long")
    got = {r["_source"]: r["target"] for r in rows(mixing.targets(df))}
    # weights a 5, b 2, c 1, null 5; a, b and null stop at 3 times their sizes, c gets the rest
    assert got == {"a": 30.0, "b": 270.0, None: 300.0, "c": pytest.approx(400.0)}


def test_targets_of_documents(spark):
    """size, source_size and target against SQL; taken against the pieces, block by block."""
    import duckdb

    d = "/root/testdata/sf0.01"
    sql = duckdb.sql(f"SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS n FROM '{d}/documents.parquet' GROUP BY source ORDER BY source NULLS LAST").fetchall()
    total, goal, open_ = sum(n for _, n in sql), {}, {s: ((5, 2, 1)[k % 3], n) for k, (s, n) in enumerate(sql)}
    while open_:
        left = (total - sum(goal.values())) / sum(w for w, _ in open_.values())
        over = {s for s, (w, n) in open_.items() if w * left > 3 * n}
        goal |= {s: 3.0 * open_[s][1] for s in over} if over else {s: w * left for s, (w, _) in open_.items()}
        open_ = {s: x for s, x in open_.items() if s not in goal}
    got = rows(mixing.op6_mixing(spark, d))
    assert {r["source"]: r["source_size"] for r in got} == dict(sql)
    assert all(r["target"] == pytest.approx(goal[r["source"]]) for r in got)
    sizes = mixing.stage(mixing.sized(mixing.read(spark, d, "documents")), "sizes")
    pieces = rows(mixing.mix_sources(sizes)[0])
    taken, blocks, uses = {}, {}, {}
    for p in pieces:
        taken[p["doc_id"]] = taken.get(p["doc_id"], 0) + p["length"]
        blocks.setdefault((p["_source"], p["slot"]), []).append(p)
        uses.setdefault((p["_source"], p["block"]), set()).add(p["slot"])
    assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == taken
    assert max(map(len, uses.values())) <= 3
    n_blocks = {s: -(-n // 32) for s, n in sql}
    for (source, slot), some in blocks.items():  # a slot takes one whole block, the last of a source may be shorter
        b = some[0]["block"]
        assert {p["block"] for p in some} == {b} and sum(p["length"] for p in some) == min(32, dict(sql)[source] - 32 * b)
        key = np.array([mixing.key_of(source, 6)], np.uint64) + np.uint64(slot // n_blocks[source]) * np.uint64(0x2545F4914F6CDD1D)
        assert b == mixing.permute(np.array([slot % n_blocks[source]]), np.array([n_blocks[source]]), key)[0]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 7)).tolist()) == list(range(n))


def test_mixing(spark, docs, odd, empty):
    got = rows(mixing.op6_mixing(spark, DATA))
    assert sorted(map(repr, got)) == sorted(map(repr, rows(mixing.op6_mixing(spark, DATA))))
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= max(0.02 * t, 2 * 64) for t, n in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r["size"] for r in got))
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(odd).count() and mixing.mixed_documents(empty).count() == 0
    mixed = rows(mixing.mixed_documents(docs.select("doc_id", "text", "source")))
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    assert all(w in texts[r["doc_id"]] for r in mixed[:50] for w in r["text"].split())


# ---- packing


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing(request, which):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sorted(([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows(df.select("text"))), key=repr)
    pieces = rows(packing.pack_documents(df))
    joined, seqs = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        assert seqs.get(p["sequence_id"], 0) == p["offset"]
        seqs[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in seqs.values())
    if which == "docs":
        for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
            at = joined.setdefault(p["doc_id"], [])
            assert len(at) == p["start"]
            at += np.frombuffer(p["ids"], "<u4").tolist()
        assert sorted(joined.values(), key=repr) == ids
    assert sum(seqs.values()) == sum(map(len, ids))


def test_proportions(docs):
    """Rounds give each source its share, to a document's length; with weights, those."""
    for weights in (None, {"src0": 3.0, "src1": 1.0}):
        config = packing.Packing(window=8, weights=weights)
        tokens = rows(packing.lay_out(packing.encode(docs, config).select("_row", "_source", "n"), config))
        total = sum(r["n"] for r in tokens)
        longest = max(r["n"] for r in tokens)
        share = {s: sum(r["n"] for r in tokens if r["_source"] == s) / total for s in {r["_source"] for r in tokens}} if weights is None else {s: w / 4 for s, w in weights.items()}
        for s, w in share.items():
            mine = sorted((r["place"], r["round"], r["n"]) for r in tokens if r["_source"] == s)
            served = 0
            for _, r, n in mine:
                served += n
                assert served <= (r + 1) * w * 8 * 2048 + 1e-6 and served > r * w * 8 * 2048 - 1e-6
        places = sorted((r["place"], r["n"]) for r in tokens)
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and longest


# ---- jaccard


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def linked(pairs):
    sets = [(i, shingles(t)) for i, t in pairs]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
                n[a] += 1
                n[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    return n, [top(k) for k in range(len(sets))]


def test_jaccard(docs):
    pairs = sorted((r["doc_id"], r["text"]) for r in rows(docs.select("doc_id", "text")))
    n, top = linked(pairs)
    got = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in rows(jaccard.join_documents(docs)))
    assert got == [(i, pairs[t][0], k) for (i, _), t, k in zip(pairs, top, n, strict=True)]


def test_jaccard_small_buckets(docs):
    """Paths that split further, and tiles of a few sets, find as many links."""
    one = rows(jaccard.join_documents(docs))
    few = rows(jaccard.join_documents(docs, jaccard.ChosenPath(bucket=3, recall=1 - 1e-9)))
    assert sum(r["n_links"] for r in few) >= 0.95 * sum(r["n_links"] for r in one)


@pytest.mark.parametrize("bucket", [2048, 1])
def test_jaccard_recall_near_the_threshold(spark, bucket):
    """Pairs of texts just over the threshold, also where every bucket is split at all levels."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for _ in range(300):
        w = [word() for _ in range(204)]
        other = w[:]
        for k in (30, 80, 120, 170):
            other[k] = word()
        texts += [" ".join(w), " ".join(other)]
    sets = [shingles(t) for t in texts]
    real = [i for i in range(0, 600, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(real) == 300
    got = rows(jaccard.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), jaccard.ChosenPath(bucket=bucket)))
    assert sum(r["n_links"] for r in got) >= 2 * 0.99 * len(real)


def test_jaccard_recall_of_splits(spark):
    """Pairs at the threshold whose buckets are split at each level are found with the recall that is stated."""
    n, config = 3000, jaccard.ChosenPath(bucket=1)
    rng = np.random.default_rng(8)
    one, other = rng.integers(0, 1 << 32, (2, n, config.tokens), np.uint32)
    other = np.where(rng.random((n, config.tokens)) < config.jaccard, one, other)
    reps = spark.createDataFrame([(2 * i + k, x[i].tobytes()) for i in range(n) for k, x in enumerate((one, other))], "_rid long, sketch binary")
    met = jaccard._buckets(reps, config)[0].groupBy("path").agg(F.collect_set("_rid").alias("ids")).where("size(ids) > 1").collect()
    found = {i // 2 for r in met for i in r["ids"] if i ^ 1 in r["ids"]}
    assert n - len(found) <= 3 * (1 - config.recall) * n


def test_jaccard_odd(odd, empty):
    got = rows(jaccard.join_documents(odd))
    assert len(got) == len(ODD) and sorted(r["n_links"] for r in got) == [0, 0, 0, 0, 0, 1, 1]
    assert jaccard.join_documents(empty).count() == 0


# ---- embeddings


@pytest.mark.parametrize("tile", [16384, 60])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 16))
    x = np.concatenate([base, base[:40] + 0.25 * rng.standard_normal((40, 16)), np.repeat(base[:1], 60, 0), base[:1] + 0.2 * rng.standard_normal((60, 16))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(near, comp[None, :], len(x)).min(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(embeddings.link_vectors(df, embeddings.Pigeonhole(tile=tile))))
    assert got == [(i, int(near[i].sum()), int(comp[i]), comp[i] == i) for i in range(len(x))]


def test_embeddings_odd(spark):
    vectors = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [1e30, 2e30])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(embeddings.link_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")))}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (3, 6), 7: (3, 6), 8: (3, 6), None: (0, None), 9: (0, 9), 10: (3, 6)}
    assert embeddings.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- suffixes


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(30):
        text = np.array([rng.choice([0, 97, 98]) for _ in range(rng.randint(1, 300))], np.uint8)
        raw = text.tobytes()
        order, _ = suffixes.suffix_array(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = suffixes.common_prefixes(text, order, 100, lanes=7)
        for a, b, n in zip(order, order[1:], shared[1:], strict=False):
            same = next((k for k, (x, y) in enumerate(zip(raw[a:], raw[b:], strict=False)) if x != y), min(len(raw) - a, len(raw) - b))
            assert n == min(same, 100)


def without_repeats(pairs, length=100):
    seen, out = set(), []
    for i, t in sorted(((i, (t or "").encode()) for i, t in pairs), key=lambda p: (p[0] is None, p[0])):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(map(repr, out))


PASSAGE = "The quick brown fox jumps over the lazy dog and then runs away from the very angry bear in the woods, héllo wörld. "
REPEATS = [(1, "a" * 1000), (2, None), (3, ""), (4, PASSAGE * 3), (5, f"x{PASSAGE}y"), (6, "ab" * 300), (7, "b" + "a" * 150 + "c"), (8, PASSAGE), (9, "q" * 50 + PASSAGE[:99]), (10, "\0" * 300), (11, "zz" + "\0" * 120), (12, "xyz" * 40 + "1" + "xyz" * 40), (None, PASSAGE + "z")]


@pytest.mark.parametrize("config", [suffixes.Repeats(), suffixes.Repeats(pack=300, shard=200)])
def test_repeats(spark, config):
    df = spark.createDataFrame(REPEATS, "doc_id long, text string").withColumn("shard", F.lit("x"))
    got = rows(suffixes.dedup_passages(df, config))
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == without_repeats(REPEATS)


def test_repeats_of_documents(docs, odd, empty):
    pairs = [(r["doc_id"], r["text"]) for r in rows(docs.select("doc_id", "text"))]
    got = rows(suffixes.dedup_passages(docs, suffixes.Repeats(pack=40_000, shard=3000)))
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == without_repeats(pairs)
    assert len(rows(suffixes.dedup_passages(odd, carry=True))) == len(ODD) and suffixes.dedup_passages(empty).count() == 0


# ---- toxicity


def test_nearest_are_exact():
    """Against dense vectors over all terms, also those that no example has."""
    rng = np.random.default_rng(5)
    counts = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(0, 9), replace=False)).astype(np.uint64)
        counts.append((t, rng.integers(1, 4, len(t))))
    known = np.arange(50, dtype=np.uint64)
    config = toxicity.Neighbours(block=16, chunk=2, frequent=0.08)
    index = toxicity.Index(known, rng.random(50) + 0.5, 0.3, list(range(700)), rng.integers(0, 2, 700), counts, config)
    weight = np.concatenate([index.weights, np.full(10, 0.3)])
    dense = np.zeros((700, 60))
    for i, (t, n) in enumerate(counts):
        dense[i, t.astype(int)] = (1 + np.log(n)) * weight[t.astype(int)]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    dense[:, 50:] = 0
    for i in range(0, 700, 7):
        (places, cosines), = index.nearest([index.weigh(*counts[i])])
        best = np.sort(dense @ dense[i])[::-1][: config.nearest]
        assert np.allclose(cosines, best[: len(cosines)], atol=1e-5) and len(cosines) == min(config.nearest, int((dense @ dense[i] > 0).sum()))
        assert np.allclose((dense @ dense[i])[index.ids[places]], cosines, atol=1e-5)


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(toxicity.op5_toxicity(spark, d))}
    held = [(got[r["doc_id"]], r["toxic"]) for r in rows(spark.read.parquet(f"{d}/labels.parquet")) if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(g["held_out"] for g, _ in held)
    assert np.mean([g["predicted"] == t for g, t in held]) > 0.9
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got.values())


def test_toxicity_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in rows(toxicity.score_documents(odd, none))} == {0.0}
    assert toxicity.score_documents(empty, none).count() == 0


# ---- revisits


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    records = [
        (1, "response", "http://www.A.com/x/#f", 10, h(ETag='"1"', Content_Type="text/html", Date="d1"), "p1"),
        (2, "response", "https://a.com:443/x", 20, h(ETag='"2"', Date="d2", X="old"), "p2"),
        (3, "revisit", "a.com/x", 15, h(etag='W/"1"', date="d3", content_type="no"), None),
        (4, "revisit", "http://a.com/x", 20, h(etag='"2"'), None),  # not earlier: meets the first response
        (5, "revisit", "http://a.com/x", 21, h(date="d5"), "p2"),
        (6, "revisit", "http://a.com/x", 9, {}, None),
        (7, "revisit", "http://a.com/X", 30, {}, None),
        (8, "revisit", "http://a.com/x/", 99, h(date="d8"), None),
        (9, "revisit", None, 99, None, None),
        (10, "revisit", "http://a.com/x", None, {}, "p1"),
        (11, "request", "http://a.com/x", 1, {}, "p1"),
    ]
    df = spark.createDataFrame(records, "record_id long, kind string, url string, time long, headers map<string,string>, digest string").withColumn("status", F.lit("x"))
    for size in (4000, 1):
        got = {r["record_id"]: (r["response_id"], r["status"], r["checked"]) for r in rows(revisits.resolve_revisits(df, size))}
        assert got == {3: (1, "resolved", "etag"), 4: (1, "mismatch", "etag"), 5: (2, "resolved", "digest"), 6: (None, "missing", None), 7: (None, "missing", None), 8: (2, "unverified", None), 9: (None, "missing", None), 10: (None, "missing", None)}
    merged = {r["record_id"]: r["headers"] for r in rows(revisits.resolve_revisits(df))}
    assert merged[3] == {"etag": 'W/"1"', "content-type": "text/html", "date": "d3"} and merged[5] == {"etag": '"2"', "x": "old", "date": "d5"}
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


# ---- cross-entropy


def plain_losses(pairs, target, prior):
    """Both models by counters, each document scored without its own counts."""
    from collections import Counter

    texts = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in pairs]

    def count(some):
        words, twos, before = Counter(), Counter(), Counter()
        for w in filter(None, some):
            words.update([*w, "</s>"])
            twos.update(zip(["<s>", *w], [*w, "</s>"], strict=True))
            before.update(["<s>", *w])
        return words, twos, before

    every, good = count([w for _, w in texts]), count([w for i, w in texts if i in target])
    total = min(every[0].total(), good[0].total())
    out = []
    for i, w in texts:
        own, sums = count([w]), []
        for model, inside in ((good, i in target), (every, True)):
            scale = total / model[0].total() if model[0].total() else 0
            loss = 0.0
            for a, b in zip(["<s>", *w], w, strict=False):
                less = [m[k] - (o[k] if inside else 0) for m, o, k in zip(model, own, (b, (a, b), a), strict=True)]
                single = (less[0] * scale + 1) / ((model[0].total() - (len(w) + 1 if inside else 0)) * scale + len(every[0]))
                loss -= np.log((less[1] * scale + prior * single) / (less[2] * scale + prior))
            sums.append(loss / max(len(w), 1))
        out.append((i, len(w), *sums, sums[1] - sums[0]))
    return out


@pytest.mark.parametrize("config", [crossentropy.Models(), crossentropy.Models(pack=5000, bucket=100)])
def test_cross_entropy(spark, docs, config):
    one, two = "red green blue red green blue", "seven eight nine ten eight seven"
    small = spark.createDataFrame([(i, one if i % 2 else two) for i in range(40)] + [(100, None), (101, ""), (102, "unseen words only")], "doc_id long, text string")
    for df, good in ((small, small.where("doc_id % 2 = 1 and doc_id < 100")), (docs.limit(60).select("doc_id", "text"), docs.where("doc_id % 3 = 0"))):
        df = df.cache()
        want = sorted(plain_losses([(r["doc_id"], r["text"]) for r in rows(df)], {r["doc_id"] for r in rows(good.select("doc_id"))}, config.prior))
        got = sorted(tuple(r.values()) for r in rows(crossentropy.score_documents(df, good, config)))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-6)
    got = {r["doc_id"]: r for r in rows(crossentropy.score_documents(small, small.where("doc_id % 2 = 1 and doc_id < 100"), config))}
    assert min(got[i]["difference"] for i in range(1, 40, 2)) > 0 > max(got[i]["difference"] for i in range(0, 40, 2))


def test_cross_entropy_odd(odd, empty):
    assert len(rows(crossentropy.score_documents(odd, odd))) == len(ODD) and crossentropy.score_documents(empty, empty).count() == 0


# ---- odd tables through all operators and stages

CLASHING = ("predicted", "score", "_text", "_key", "_at", "_pass", "n_bytes", "_row", "row", "kept", "held_out", "_low", "n_words", "_hash", "_nth", "_uses", "spans", "shard", "ids", "component", "_kept", "mult")


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """Documents and odd rows with columns of every name the stages use, and columns of other kinds."""
    more = spark.createDataFrame([(2_000_000 if i is None else 1_000_000 + i, t, s) for i, t, s in ODD] + [(None, "text of no id that has some words", None), (3_000_000, "long words " * 100_000, "a")], "doc_id long, text string, source string")
    out = docs.select("doc_id", "text", "source").union(more)
    return out.withColumns({c: F.lit("z") for c in CLASHING} | {"list": F.array(F.lit(1), F.lit(2)), "a b": F.struct(F.lit(1).alias("x")), "n_chars": F.length("text").cast("int")}).cache()


def test_stages_keep_columns(spark, clashing):
    import corpus_pipeline

    for name, step in corpus_pipeline.STAGES[:-1]:
        for df in (clashing, clashing.limit(0)):
            out = step(spark, df, DATA)
            assert out.dtypes == df.dtypes, name
            got = out.collect()
            assert all(r["predicted"] == "z" and r["list"] == [1, 2] and r["a b"]["x"] == 1 for r in got), name
            assert bool(got) == (df is clashing), name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, DATA).count() >= clashing.count()


def test_operators_on_clashing_columns(spark, clashing):
    n, none = clashing.count(), clashing.limit(0)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for run in (lambda d: toxicity.score_documents(d, labels), jaccard.join_documents, suffixes.dedup_passages, fingerprint.fingerprint_documents, licenses.scan_licenses, lambda d: crossentropy.score_documents(d, d)):
        assert run(clashing).count() == n and run(none).count() == 0


# ---- pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline
    from leafmill.llm.common import stage

    rows_in, now = docs.count(), docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, now, DATA), name)
        assert now.schema == docs.schema
    assert 0 < now.count() < 2 * rows_in
    assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).count() > 0
