"""Spelling variants, pieces and fill-in-middle against plain versions, SQL, the library, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import fim, pieces, spelling

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (None, "Straße straße SOMEWHERE somewhere"), (3, "x" * 5000), (3, "x" * 5000), (4, "abc<P>def"), (4, "abc<P>def"), (5, "Ünïcödé 😀 " * 40), (6, "  two  blanks ▁ \t\r\n\0"), (7, "word " * 200_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators might use."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("n", "word", "run", "h", "ids", "decoded", "form", "output", "_at", "shard", "best")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def by_sql(sql):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return sorted(c.execute(sql).fetchall(), key=repr)


# ---- fill-in-middle


def cut_plainly(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    d = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in d[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or d[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d[3] % 100 < 20 else (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1 << 60), st.text(st.sampled_from("<>PSMab éÉ😀\n\0-"), max_size=30)), max_size=20))
def test_cut_and_joined(some):
    ids, texts = [i for i, _ in some], [t for _, t in some]
    made = fim.cut(ids, texts, fim.Fim())
    assert [(i, *m) for i, m in zip(ids, made, strict=True)] == [cut_plainly(i, t) for i, t in some]
    assert fim.joined([m[4] for m in made], [m[1] for m in made]) == texts


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_fill_in_middle(request, which):
    df = request.getfixturevalue(which)
    made = fim.restore(fim.fill_in_middle(df))
    assert rows(made) == sorted(((*cut_plainly(i, t), t or "") for i, t in pairs(df)), key=repr)


def test_fill_in_middle_query(spark):
    assert rows(fim.op13_fill_in_middle(spark, DATA)) == by_sql(fim.OP13_SQL)


def test_automaton_finds_all_words():
    words = ["ab", "b", "bab", "aa"]
    a = fim.Automaton([(w, k) for k, w in enumerate(words)], "abc")
    text = "".join(random.Random(5).choice("abc") for _ in range(300))
    got = a.scan(np.array(["abc".index(c) for c in text], np.uint8), 2)
    assert got.tolist() == [sum(1 << k for k, w in enumerate(words) if text[: i + 1].endswith(w)) for i in range(len(text))]


# ---- pieces


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


_CHUNKS = st.sampled_from([" ", "  ", " " * 15, " " * 33, "▁", "a", "b", "the", "th", "e", "in", "ing", "é", "É", "中", "😀", "\n", "\t", "\0", "1", "ﬁ", "ab" * 40, "</s>", "<0x0A>"])


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(_CHUNKS, max_size=30).map("".join), st.text(max_size=40)), max_size=8))
def test_pieces_as_the_library(library, texts):
    encoder = pieces.encoder_of(None)
    got = encoder(texts)
    assert [g.tolist() for g in got] == [library.encode(t, add_eos=True) for t in texts]
    assert encoder.decode(got) == [library.decode(library.encode(t, add_eos=True)) for t in texts]


def test_pieces_of_long_words_and_full_tables(library):
    r = random.Random(1)
    texts = ["".join(r.choice(s) for _ in range(3000)) for s in ("ab", "abcdefghijklmnopqrstuvwxyz", "ABCabc123+/")] + [" " * 5000 + "a" * 5000, "thethethe" * 300]
    encoder = pieces.Encoder(None, keep=1, keep_chars=1)
    for _ in range(2):
        assert [g.tolist() for g in encoder(texts)] == [library.encode(t, add_eos=True) for t in texts]
    assert encoder(["a b"], end=False)[0].tolist() == library.encode("a b")


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_encode_and_decode_documents(request, library, which):
    df = request.getfixturevalue(which)
    got = rows(pieces.decode_documents(pieces.encode_documents(df)))
    ids = [(i, library.encode(t or "", add_eos=True)) for i, t in pairs(df)]
    assert got == sorted(((i, x, library.decode(x)) for i, x in ids), key=repr)


def test_pieces_query(spark, library):
    want = []
    for i, t in pairs(spark.read.parquet(f"{DATA}/documents.parquet")):
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert rows(pieces.op12_pieces(spark, DATA)) == sorted(want, key=repr)


def test_decode_of_other_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, 2]), (4, [3 + 0xE9, 3 + 0x41])], "k int, ids array<int>")
    assert [(r["k"], r["decoded"]) for r in pieces.decode_documents(df).orderBy("k").collect()] == [(1, ""), (2, ""), (3, ""), (4, "�A")]


# ---- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_plainly(some, ratio=10, least=2, shortest=7, every=31):
    counts = Counter()
    for i, t in some:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}
    out = {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = [form, n, len(others), counts[form] if form else None]
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return sorted(((w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()), key=repr)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(st.sampled_from("abé"), min_size=1, max_size=6), max_size=60), st.sets(st.text(st.sampled_from("abcé"), min_size=1, max_size=6), max_size=60), st.sampled_from([1, 7, 1 << 19]))
def test_trie_neighbours(words, asked, most):
    words, asked = sorted(words), sorted(asked)
    got = spelling.Trie.of(words).near(*spelling._flat(asked), most)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b)]


@pytest.mark.parametrize("config", [spelling.Spelling(), spelling.Spelling(ratio=2, least=1, shortest=4, shard_words=100, wave_bytes=1, block=300)])
@pytest.mark.parametrize("which", ["odd", "empty", "typos"])
def test_variants(request, spark, which, config):
    if which == "typos":
        r = random.Random(4)
        texts = [" ".join(r.choice(["somewhere", "somewhre", "Sommewhere", "otherwise", "otherwize", "eleventh", "éleventh", "elevenths"][: r.choice([1, 3, 8])]) for _ in range(r.randrange(90))) for _ in range(60)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    else:
        df = request.getfixturevalue(which)
    assert rows(spelling.variants(df, config)) == variants_plainly(pairs(df), config.ratio, config.least, config.shortest)


def test_spelling_query(spark):
    got = rows(spelling.op11_spelling(spark, DATA))
    assert got == by_sql(spelling.OP11_SQL)
    assert got == variants_plainly(pairs(spark.read.parquet(f"{DATA}/documents.parquet")))
