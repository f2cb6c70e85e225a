"""Columns of the input may have any name: those of results are replaced, all others come back as they are."""

import pytest
from pyspark.sql import functions as F

from orfspark.llm import chat, decontaminate, licences, packing, simhash, substrings, toxicity, urls

NAMES = "label place grams features features_grams Host PATH Rule verdict _p _r _rule _features _row _key _hit _doc _items Items n_hit _hash _id _of _w_id N_words kept_Text own Score held_OUT predicted fp root node row_id pos term s n w wid window shard block payload bits words a.b `q`".split()
PASSAGE = " ".join(f"passage{i}" for i in range(30))
ROWS = [(i, f"doc{i} {PASSAGE if i % 3 == 0 else 'some other words'} end{i} {'moron scum' if i % 4 == 0 else 'kind'}", f"http://site{i % 7}.com/{'fr' if i % 2 else 'de'}/{i}", i % 2) for i in range(40)] + [(41, None, None, None), (None, "", "", 1), (3, "x y", "http://b.net/de/1", 0)]


def with_clashes(df):
    taken = {c.lower() for c in df.columns}
    extra = [n for n in NAMES if n.lower() not in taken]
    return df.select("*", *[F.concat(F.lit(n + ":"), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("-"))).alias(n) for n in extra]), extra


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t, _, _ in ROWS], "doc_id long, text string, lang string").repartition(3)
    pages = spark.createDataFrame([(i, u) for i, _, u, _ in ROWS], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 5 > 0)) for i in range(40)], "doc_id long, toxic int, quality_label int")
    items = spark.createDataFrame([("b1", PASSAGE), ("b2", "doc1 some other")], "item_id string, text string")
    return {"docs": docs, "pages": pages, "labels": labels, "items": items}


#: name: (table, operator, result columns, whether all columns of the table come back)
OPERATORS = {
    "toxicity.score": ("docs", lambda x, t: toxicity.score(x, with_clashes(t["labels"])[0]), ["held_out", "score", "predicted"], True),
    "toxicity.keep_clean": ("docs", lambda x, t: toxicity.keep_clean(x, with_clashes(t["labels"])[0]), [], None),
    "urls.judge": ("pages", lambda x, t: urls.judge(x), ["host", "path", "rule", "verdict", "p_block"], True),
    "decontaminate.scan": ("docs", lambda x, t: decontaminate.scan(x, with_clashes(t["items"])[0]), ["n_words", "n_hit", "n_items", "items", "contaminated"], True),
    "simhash.keep_first": ("docs", lambda x, t: simhash.keep_first(x), [], None),
    "simhash.near_duplicates": ("docs", lambda x, t: simhash.near_duplicates(x), ["fp", "component_id"], False),
    "substrings.dedup": ("docs", lambda x, t: substrings.dedup(x), ["kept_text", "n_words", "n_removed"], True),
    "licences.scan": ("docs", lambda x, t: licences.scan(x), ["n_paragraphs", "licences", "unconfirmed"], False),
    "packing.pack": ("docs", lambda x, t: packing.pack(x), ["start", "length"], False),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, tables, name):
    table, operator, made, whole = OPERATORS[name]
    plain = tables[table]
    wide, extra = with_clashes(plain)
    own = plain.columns if whole or whole is None else plain.columns[:1]
    sought = [*own, *made]
    expected = sorted(map(repr, operator(plain, tables).select(*sought).collect()))
    got = operator(wide, tables)
    assert sorted(map(repr, got.select(*sought).collect())) == expected and expected
    if whole is False:
        return
    kept = [n for n in extra if n.lower() not in {m.lower() for m in made}]
    assert {c.lower() for c in got.columns} == {c.lower() for c in [*own, *kept, *made]} and len(got.columns) == len(own) + len(kept) + len(made)
    rows = got.collect()
    for n in kept:
        at = got.columns.index(n)
        assert all(r[at] == f"{n}:{'-' if r[0] is None else r[0]}" for r in rows), n


def test_toxicity_sample_is_of_distinct_texts_of_each_class(spark):
    """Thousands of copies of one labelled text, and labels without documents, crowd nothing out."""
    rows = [(i, "the same old text") for i in range(3000)] + [(5000 + i, f"moron number {i} scum") for i in range(40)] + [(6000 + i, f"kind words {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(5000 <= i < 6000)) for i, _ in rows] + [(100_000 + i, i % 2) for i in range(500)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, 20).collect()
    assert len(got) == 40 and len({r.text for r in got}) == 40 and sum(r.label for r in got) == 20
    copies = docs.select("text", F.col("text").startswith("moron").cast("int").alias("label"))
    model = toxicity.fit(copies.union(copies), sample=30, features=200)
    assert len(model.weight) > 1
    judged = toxicity.score(docs, labels).where("doc_id >= 5000")
    assert judged.where("predicted <> cast(doc_id < 6000 as int)").count() == 0


def test_tokens_of_texts_without_blanks(spark):
    got = spark.createDataFrame([("a" * 4000,), ("\u4f60\u597d" * 50,), ("two words",), ("",)], "text string").select(chat.piece_tokens(F.col("text")).alias("n")).collect()
    assert [r.n - chat.OVERHEAD for r in got] == [1000, 100, 3, 0]  # two, word, s
