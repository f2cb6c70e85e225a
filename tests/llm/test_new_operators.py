"""Spelling variants, exact top-k search and fill-in-middle against plain versions, and their edge cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orfspark.llm import embeddings, fim, mtree, spelling

DOCS = "doc_id long, text string"


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- spelling variants ---------------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(ws):
    form = {}
    for w, n in ws.items():
        best = min((x for x in ws if near(w, x)), key=lambda x: (-ws[x], x), default=None)
        form[w] = best if best is not None and ws[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, sum(near(w, x) for x in ws), ws[form[w]] if form[w] else -1) for w, n in ws.items())


@pytest.fixture(scope="module")
def vocabulary():
    rng = np.random.default_rng(3)
    out = {}
    for _ in range(60):
        w = "".join(rng.choice(list("abcdeéß"), int(rng.integers(5, 10))))
        for _ in range(8):
            i, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
            w = w[:i] + ("", "x", "y" + w[i])[kind] + w[i + 1 :]
            out[w] = int(rng.integers(3, 400))
    return {w: n for w, n in out.items() if len(w) >= 5} | {"z" * 80: 9, "z" * 81: 30, "z" * 40 + "a" + "z" * 39: 3, "aabbcc": 5, "aabbc": 5, "abbccc": 11}


@pytest.mark.parametrize("limits", [{}, {"bucket": 50, "hot": 8}])
def test_spelling_forms(spark, vocabulary, limits):
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").withColumn("N_near", F.lit("clash")).repartition(3)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.spelling_forms(df, **limits).collect())
    assert got == plain_forms(vocabulary)


def test_spelling_edges(spark):
    df = spark.createDataFrame([("apples", 9), ("apples", 4), (None, 3), ("applex", None)], "word string, n long")
    assert rows_of(spelling.spelling_forms(df), "word", "root", "n", "n_near") == [("apples", "apples", 9, 1), ("applex", "apples", 0, 1)]
    assert spelling.spelling_forms(df.where("false")).count() == 0


def test_corpus_words(spark):
    texts = [(i, "Größe größe GRÖSSE Straße, straße\tNaïveté " + "lorem ipsum dolor Lorem " * 40 + "x" * 3000) for i in range(120)] + [(None, "lorem lorem lorem"), (200, None), (201, ""), (3, "çà–và délètè délètè délètè")]
    count = {}
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                count[w] = count.get(w, 0) + 1
    got = spelling.corpus_words(spark.createDataFrame(texts, DOCS).withColumn("n", F.lit(1)).repartition(4))
    assert rows_of(got, "word", "n") == sorted((w, n) for w, n in count.items() if n >= 3)


# --- exact top-k search --------------------------------------------------------------------------------------------


def plain_top(rows, k, every, scale=64):
    whole = {(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in whole:
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j) for j, w in whole if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def vectors(seed, n, dim, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    if clusters:
        x = rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + x / 50
    return [(i, [float(c) for c in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("page", [16, 1000])
def test_top_k_equals_products(spark, page):
    rows = vectors(1, 300, 8) + [(1000 + i, [0.5] * 8) for i in range(90)] + [(2000, [1e4] * 8), (2001, [-3.0] * 8), (2020, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("Score", F.lit("clash")).repartition(3)
    assert rows_of(mtree.top_k(df, 7, 20, page=page), "query_id", "rank", "vec_id", "score") == plain_top(rows, 7, 20)


def test_top_k_reads_less_of_clustered_rows(spark):
    rows = vectors(2, 1200, 16, clusters=40)
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 20, page=32)
    got = got.collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain_top(rows, 5, 20)
    assert sum(r.products for r in got if r["rank"] == 1) < 0.5 * 60 * 1200  # products that the bounds could not spare


def test_top_k_edges(spark):
    shape = "vec_id long, embedding array<double>"
    odd = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [2.0]), (6, []), (40, [1e300, 1.0])]
    kept = [(i, v) for i, v in odd if (i, v) != (40, [1e300, 1.0])]  # its scores have no 64 bits
    padded = [(i, None if v is None else [*v, *[0.0] * (2 - len(v))]) for i, v in kept]
    assert rows_of(mtree.top_k(spark.createDataFrame(odd, shape)), "query_id", "rank", "vec_id", "score") == plain_top(padded, 20, 20)
    assert mtree.top_k(spark.createDataFrame([], shape)).count() == 0
    assert mtree.top_k(spark.createDataFrame([(0, [1.0])], shape)).count() == 0
    large = [(i, [float((i * 7919) % 1000 - 500) * 4e4, float(i) * 1e5]) for i in range(60)]  # products beyond doubles' integers
    assert rows_of(mtree.top_k(spark.createDataFrame(large, shape), 5, 20, page=8), "query_id", "rank", "vec_id", "score") == plain_top(large, 5, 20)


# --- fill-in-middle ------------------------------------------------------------------------------------------------

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_fim(doc_id, text):
    text = text or ""
    toks = TOKEN.findall(text)
    head = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(head[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, z = sorted((h[0] % (len(toks) + 1), h[1] % (len(toks) + 1)))
    p, m, s = "".join(toks[:a]), "".join(toks[a:z]), "".join(toks[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(toks), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(toks), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(toks), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_fim(spark):
    rng = np.random.default_rng(5)
    signs = ["a", "bc", " ", "\n", "\t ", " ", "日本", "<P", "S>", "<", "😀", "\u0085"]
    rows = [(i, "".join(rng.choice(signs, int(rng.integers(0, 40))))) for i in range(300)]
    rows += [(None, "no id at all"), (400, None), (401, ""), (402, " \n"), (403, "x <M> y"), (404, "word " * 200_000), (-5, "minus five"), (7, rows[7][1])]
    df = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("Form"), F.lit(2).alias("n"), F.lit(3).alias("pieces")).repartition(3)
    out = fim.transform(df).withColumn("back", fim.restored(F.col("fim.text"), F.col("fim.form"))).collect()
    assert len(out) == len(rows) and {"Form", "n", "pieces"} <= set(out[0].__fields__)
    for r in out:
        n, form, prefix, middle, text = plain_fim(r.doc_id, r.text)
        assert (r.fim.n, r.fim.form, r.fim.text, r.back) == (n, form, text, r.text or "")
        assert r.fim.sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert sum(p.length for p in r.fim.pieces) == len(text)
        if form != "plain":
            cut = {p.start: p.length for p in r.fim.pieces if p.buffer == 0}
            assert sum(cut.values()) == len(r.text) and r.fim.pieces[5].length == middle and cut[0] in (0, prefix, middle, len(r.text) - prefix - middle)
    assert {r.fim.form for r in out} == {"plain", "spm", "psm"}


def test_fim_edges(spark):
    assert fim.transform(spark.createDataFrame([], DOCS)).count() == 0
    one = fim.transform(spark.createDataFrame([("k", "some words here", 1)], "key string, body string, FIM int"), "key", "body", "fim", rate=100, spm=0, sentinels=("[1]", "[2]", "[3]")).first()
    assert one.fim.form == "psm" and one.fim.text.startswith("[1]")
    assert spark.createDataFrame([(None, "psm"), ("x", None)], "t string, f string").select(fim.restored(F.col("t"), F.col("f")).alias("r")).where("r is not null").count() == 0


# --- labels of any kind --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("labels", [("x", "y"), (2**40, 2**40 + 1), (-1.5, 2.5)])
def test_near_duplicates_of_any_label(spark, labels):
    rows = [(i, v, labels[i % 2]) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.02]])] + [(9, [1.0, 0.0], None)]
    kind = {str: "string", int: "long", float: "double"}[type(labels[0])]
    for limit in (2048, 2):
        got = embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}"), cell_rows=limit)
        assert rows_of(got, "vec_id", "n_links", "component_id") == [(0, 2, 0), (1, 0, 1), (2, 2, 0), (3, 0, 3), (4, 2, 0), (9, 0, 9)]
