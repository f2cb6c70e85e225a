"""Edge cases and brute-force comparisons of the training-data operators on small inputs."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from orfspark.llm import chat, common, decontaminate, embeddings, licences, packing, quality, simhash, substrings, toxicity, urls

DOCS = "doc_id long, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    passage = prose(99, 60)
    rows = [(i, prose(i, 40 + i)) for i in range(20)]
    rows += [(20, rows[3][1]), (21, rows[3][1].replace("alpha", "Alpha", 1)), (22, prose(5, 30) + " " + passage), (23, passage + "\n" + prose(6, 10)), (24, None), (25, ""), (26, " \t\n"), (27, "one two three"), (28, "x " * 3000), (29, rows[7][1] + " tail")]
    return rows


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + k] == 100 for k in range(40))
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_simhash(spark, docs):
    df = spark.createDataFrame(docs, DOCS).withColumn("fp", F.lit("clash")).repartition(3)
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == brute.simhash(docs)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_crowded_bucket_equals_pairs(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    values = {base}
    for _ in range(120):
        bits = rng.choice(64, 3, replace=False)
        values.add(base ^ sum(1 << int(b) for b in bits))
    values |= {int(x) for x in rng.integers(0, 1 << 62, 40)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    low = {}
    for limit in (4096, 10):
        links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), bucket_limit=limit)
        rows = links.collect()
        assert all(bin((r.src ^ r.dst) & (1 << 64) - 1).count("1") <= 4 for r in rows if limit == 4096)
        index = {v: i for i, v in enumerate(values)}
        low[limit] = brute.components(len(values), [(index[r.src], index[r.dst]) for r in rows])
    want = brute.components(len(values), [(i, j) for i in range(len(values)) for j in range(i) if bin((values[i] ^ values[j]) & (1 << 64) - 1).count("1") <= 4])
    assert low[4096] == want and low[10] == want


def test_simhash_keep_first_handles_repeats_and_null_ids(spark, docs):
    rows = [*docs, docs[0], (None, "nameless text")]
    kept = [r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()]
    want = sorted({c for _, c in brute.simhash(docs).values()})
    assert sorted(x for x in kept if x is not None) == want and kept.count(None) == 1
    # two unrelated texts of one id, one of them a copy of a smaller id's text
    shared = [(1, prose(70, 50)), (5, prose(71, 50)), (5, prose(70, 50)), (5, prose(72, 50)), (5, prose(72, 50))]
    got = sorted((r.doc_id, r.text) for r in simhash.keep_first(spark.createDataFrame(shared, DOCS)).collect())
    assert got == sorted({shared[0], shared[1], shared[3]})


def test_substrings(spark, docs):
    df = spark.createDataFrame(docs, DOCS).withColumn("n_words", F.lit("clash")).repartition(4)
    for more in ({}, {"shard_bytes": 50}, {"least_shards": 1}):  # 64, hundreds and one shard
        got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in substrings.dedup(df, **more).collect()}
        assert got == brute.substrings(docs)
    assert substrings.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_substrings_same_id_and_null_id(spark):
    text, other = prose(1, 40), prose(2, 40)
    rows = [(1, text), (1, text), (1, other + " " + text), (None, text), (2, other)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 40)]


def test_decontaminate(spark, docs):
    items = [(1, prose(99, 60)), (2, "one two"), (3, None), (4, ""), (5, docs[3][1][:120]), (6, "absent words here"), (7, "x x x x x x x x x x x x x x")]
    df = spark.createDataFrame(docs, DOCS).withColumn("items", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.contaminated) for r in decontaminate.scan(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.decontaminate(docs, items)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(df, empty).where("n_hit > 0").count() == 0
    assert decontaminate.scan(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontaminate_repeated_words_two_texts_of_an_id_and_null_ids(spark, monkeypatch):
    once = prose(41, 30)
    rows = [(1, "x " * 20_000), (2, prose(1, 50) + " " + once), (3, "y x " * 2000), (4, prose(2, 40)), (None, prose(5, 30) + " " + once), (None, once), (6, "x"), (7, prose(8, 3) + " x x"), (2, prose(9, 10))]
    items = [(1, "x " * 3000), (2, once), (2, prose(2, 40)), (None, prose(1, 50)), (5, "y"), (6, "x x x x x x x x x x x x x y")]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or 0, r.text[:20], r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in decontaminate.scan(frame, bench).collect())
    want = []
    for doc, text in rows:
        plain = decontaminate_plain(text, items)
        want.append((doc or 0, text[:20], *plain))
    assert got == sorted(want)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)  # the ways beyond the broadcasts
    assert sorted((r.doc_id or 0, r.text[:20], r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in decontaminate.scan(frame, bench).collect()) == got


def decontaminate_plain(text, items, size=13):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    ws = word.findall(brute.ascii_lower(text or ""))
    hit, found = set(), set()
    for item, other in items:
        own = word.findall(brute.ascii_lower(other or ""))
        windows = {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()
        for n in {len(w) for w in windows}:
            at = [i for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows]
            for i in at:
                hit.update(range(i, i + n))
            if at and item is not None:
                found.add(str(item))
    return len(ws), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(ws)


def test_decontaminate_lower_cases_ascii_only(spark):
    rows = [(1, "ÉCOLE Straße ÄBC x"), (2, "École"), (None, "école")]
    items = [(1, "École strasse"), (2, "École")]
    got = {r.doc_id: r.n_hit for r in decontaminate.scan(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, None: 0} or got == {1: 1, 2: 1, None: 0}
    want = brute.decontaminate(rows, items)
    assert got == {k: v[1] for k, v in want.items()}


def test_proximity(spark):
    df = spark.createDataFrame([(1, 1, "a quick brown fox"), (2, 2, "a quick red brown fox"), (3, 3, "fox brown")], "doc_id long, row_id long, text string")
    index = decontaminate.build_index(df)
    found = lambda slop: sorted(r.doc_id for r in decontaminate.proximity(index, ["quick", "brown", "fox"], slop).collect())
    assert found(0) == [1] and found(1) == [1, 2]
    assert decontaminate.proximity(index, [], 1).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    rows = [*docs, (30, "Grüße <|endoftext|> 日本 \n\n  ok  "), (31, prose(3, 3000))]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = [r.asDict() for r in packing.pack(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
    brute.packing_ok(rows, got, lambda t: tok.encode(t, add_special_tokens=False).ids)
    assert all(len(p["ids"]) == p["length"] for p in got)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_chat(spark):
    marks = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "system", "rules <|x|> <\\|"), (1, 1, "user", "hi"), (1, 2, "assistant", marks), (1, 3, "user", None), (1, 4, "assistant", "a\nb <\\\\| c"), (2, 0, "user", "x"), (3, 0, "assistant", ""), (4, 5, "as<|s\n%istant", "odd role")]
    turns += [(5, i, ("user", "assistant")[i % 2], prose(i, 60)) for i in range(30)] + [(6, 0, "system", prose(1, 400)), *[(6, i, ("user", "assistant")[i % 2], prose(i, 90)) for i in range(1, 9)]]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    for budget in (60, 300, 5000):
        made = chat.windows(df, budget=budget, history=40)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(made).collect()}
        assert got == brute.chat(turns)
    made = chat.windows(df, budget=300, history=100)
    later = made.where("conv_id = 6 and window > 0").collect()
    assert later and all(r.n_repeated == 0 or r.formatted.startswith("<|im_start|>") for r in later)
    assert chat.digest(chat.windows(df.limit(0))).count() == 0


def test_packing_long_runs_null_ids_and_clashing_columns(spark, tmp_path):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, prose(3, 200_000)), (4, "x" * 300_000), (5, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("clash"))
    got = [r.asDict() for r in packing.pack(df).collect()]
    brute.packing_ok(rows, got, lambda t: tok.encode(t, add_special_tokens=False).ids)
    named = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c")], DOCS), with_ids=False).collect()
    assert sorted((r.doc_id or 0, r.length) for r in named) == [(0, 1), (0, 1), (0, 2), (0, 2), (7, 2)]
    packing.write_buckets(packing.pack(spark.createDataFrame([(i, prose(i, 5 + 7 * i)) for i in range(40)], DOCS).repartition(3)), f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert back.where("size(ids) <> length").count() == 0 and back.select("sequence_id").distinct().count() == back.count()
    # of one stretch of documents, sequences of one length have consecutive numbers
    one = [r.length for r in packing.pack(spark.createDataFrame([(i, prose(i, 30)) for i in range(9)], DOCS).coalesce(1)).orderBy("sequence_id").collect()]
    assert one == sorted(one, reverse=True)


def greedy(tokens, has_system, budget, history, history_turns, stretch):
    """Plain windows of one conversation: (first own turn, end, repeated turns)."""
    out, used, total, at_stretch = [], None, 0, None
    for i, n in enumerate(tokens):
        new = total // (stretch * budget) != at_stretch
        at_stretch = total // (stretch * budget)
        total += n
        if not new and used + n <= budget:
            used += n
            out[-1][1] = i + 1
            continue
        lead = [0] if has_system and i > 0 and tokens[0] + n <= budget else []
        room = min(history, budget - n - sum(tokens[j] for j in lead))
        near = []
        for j in range(i - 1, i - 1 - history_turns, -1):
            if j < (1 if has_system else 0) or sum(tokens[k] for k in [*near, j]) > room:
                break
            near.append(j)
        used = n + sum(tokens[j] for j in [*lead, *near])
        out.append([i, i + 1, [*lead, *reversed(near)]])
    return out


@pytest.mark.parametrize("stretch", [128, 2])
def test_chat_windows_are_greedy_and_keep_the_budget(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    rng = np.random.default_rng(4)
    talks = {1: [60] * 80, 2: [900, *[120] * 9], 3: [1100, 30, 1200, 5, 5], 4: [int(x) for x in rng.integers(0, 400, 60)], 5: [int(x) for x in rng.integers(0, 90, 200)], 6: [20, *[int(x) for x in rng.integers(1, 300, 90)]], 7: [0]}
    led = {2, 3, 6}
    turns = [(c, i, "system" if i == 0 and c in led else ("user", "assistant")[i % 2], " ".join(f"w{c}x{i}x{k}" for k in range(n))) for c, ns in talks.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    budget, history, history_turns = 1024, 256, 2
    got = {}
    for r in chat.windows(df, budget, history, history_turns).collect():
        lines = r.formatted.split("<|im_end|>\n")[:-1]
        got.setdefault(r.conv_id, []).append((r.window, r.n_repeated, lines))
    for c, ns in talks.items():
        tokens = [n + chat.OVERHEAD for n in ns]
        want = greedy(tokens, c in led, budget, history, history_turns, stretch)
        own = sorted(got[c])
        assert [w for w, *_ in own] == list(range(len(want)))
        for (_, n_repeated, lines), (a, z, lead) in zip(own, want, strict=True):
            said = [t for cc, i, role, t in turns if cc == c for j in [i] if j in range(a, z)]
            repeated = [t for i in lead for cc, j, role, t in turns if cc == c and j == i]
            assert n_repeated == len(lead) and [x.split("\n", 1)[1] for x in lines] == [*repeated, *said]
            size = sum(tokens[i] for i in [*lead, *range(a, z)])
            assert size <= budget or (z == a + 1 and not lead and tokens[a] > budget)
            if stretch == 128 and z < len(ns):  # the next turn would not have fitted
                assert size + tokens[z] > budget


def test_chat_null_ids_and_repeated_rows(spark):
    turns = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, None, "assistant", "b"), (1, 0, "user", "x y"), (1, 0, "user", "x y")]
    got = {r.conv_id: r.n_turns for r in chat.digest(chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {None: 3, 1: 2}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 64))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base.astype(np.float32))]
    for i in range(40):
        v = (base[i % 5] + rng.standard_normal(64) * (0.02 + 0.01 * (i % 7))).astype(np.float32)
        rows.append((100 + i, [float(x) for x in v], (i % 5) % 3))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 64, 0), (205, [float("nan")] * 64, 0), (206, [None] * 64, 0), (207, [], 0), (208, [1.0, 0.0], 0), (209, [2.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("k", F.lit("clash")).repartition(3)
    want = brute.embeddings(rows)
    for cell_rows in (2048, 7, 2):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, cell_rows=cell_rows).collect()}
        assert got == want
    assert sum(n for n, _, _ in want.values()) > 50
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_split_labels_compare_less(spark):
    """Compared pairs (homes by visits) per vector grow far slower than the label."""
    rng = np.random.default_rng(8)
    per = []
    for n in (1000, 4000):
        v = rng.standard_normal((n, 64)).astype(np.float32)
        classes = spark.createDataFrame([(i, 1, 0, 64, [float(x) for x in r]) for i, r in enumerate(v)], "k long, m long, label int, dim int, v array<float>").repartition(4)
        met = embeddings.with_planes(classes, 16, 100).mapInArrow(embeddings.meeting_cells(0.04, 16), "k long, m long, label int, dim int, v array<float>, block int, cell long, home boolean")
        cells = met.groupBy("block", "cell").agg(F.count_if("home").alias("h"), F.count("*").alias("r"))
        per.append(cells.agg(F.sum(F.col("h") * F.col("r"))).first()[0] / n)
    assert per[1] < 2.7 * per[0] and per[1] < 4000  # of four times the vectors; fewer than the plain join of one label


def test_embeddings_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, None, 1), (5, [0.0, 1.0], 1)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(0, 0, 0, False), (0, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (5, 0, 5, True)]


def test_toxicity(spark):
    bad = ["moron", "scum", "idiot"]
    rows = [(i, prose(i, 60) + (f" {bad[i % 3]} {prose(i + 500, 20)}" if i % 4 == 0 else "")) for i in range(400)] + [(400, None), (401, ""), (402, "moron " * 500)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(9999, 1), (3, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, lab).collect()}
    held = [d for d in range(400) if got[d].held_out]
    assert len(held) > 40 and np.mean([got[d].predicted == (d % 4 == 0) for d in held]) > 0.97
    assert got[402].predicted == 1 and got[401].score == got[400].score and got[400].predicted == 0
    none = toxicity.score(df, lab.where("toxic = 1")).agg(F.min("score"), F.max("score")).first()
    assert 0 <= none[0] <= none[1] <= 1
    assert toxicity.score(df.limit(0), lab).count() == 0
    assert toxicity.score(df, lab.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_fit_keeps_rare_wordings_and_collects_no_text(spark, monkeypatch):
    """A vocabulary with more than 8,192 telling n-grams, against a plain fit on one machine."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 7))
    telling = [[word() for _ in range(700)] for _ in (0, 1)]
    texts = [" ".join(telling[i % 2][k] for k in rng.choice(700, 30, replace=False)) for i in range(300)]
    y = np.arange(300) % 2
    df = spark.createDataFrame([(t, int(c)) for t, c in zip(texts, y, strict=True)] + [(None, 1), ("x", 7), ("y", None)], "text string, label long").repartition(3)
    sent, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (sent.append(self.columns), collect(self))[1])
    model = toxicity.fit(df)
    assert (toxicity.SAMPLE, toxicity.FEATURES, len(model.slot)) == (2500, 1 << 14, 1 << 22)
    assert sent and not any("text" in columns for columns in sent)
    counts = np.zeros((2, 1 << 22))
    held = [np.unique(np.concatenate([h for _, h in toxicity.grams([t])])) for t in texts]
    for c, h in zip(y, held, strict=True):
        counts[c, h] += 1
    ratio, strength = toxicity.strengths(counts[0], counts[1], (150, 150))
    best = np.argsort(-strength, kind="stable")[: 1 << 14]
    best = best[strength[best] > 0]
    assert len(best) > 8192 and np.array_equal(np.flatnonzero(model.slot >= 0), np.sort(best))
    assert np.array_equal(model.slot[best], np.arange(len(best)))
    present = np.array([np.isin(best, h) for h in held])
    slope = 1e-3 * model.weight / ratio[best]  # the gradient of the penalised loss is next to 0
    error = (1 / (1 + np.exp(-(present @ model.weight + model.bias))) - y) / 300
    assert np.abs(slope + ratio[best] * (error @ present)).max() < 2e-3 and abs(error.sum()) < 2e-3
    few = toxicity.fit(df, sample=40, features=50)
    assert len(few.weight) == 50


def test_urls(spark):
    rows = [(1, "http://A.Example.org/es/1?x"), (2, "https://example.org/en/12"), (3, "https://example.org/en/2"), (4, "x.com/fr/1"), (5, None), (6, "ftp://com/fr/"), (7, "http://notexample.org/es/"), (8, "http://a.com/de/#t"), (9, "http://b.net"), (10, "http://q.example.org/es"), (11, "")]
    rows += [(100 + i, f"http://site{i}.com/{'fr' if i % 2 else 'de'}/{i}") for i in range(60)] + [(300, "http://site3.net/de/44"), (301, "http://site4.net/fr/45")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].rule, got[3].rule) == ("example.org/en/1", "org/")
    assert (got[4].host, got[5].host, got[11].path) == ("", "", "") and got[4].rule is None
    assert (got[6].rule, got[7].rule, got[8].verdict, got[8].path) == ("com/fr/", "org/", "block", "/de/")
    assert (got[9].path, got[9].rule, got[10].rule) == ("", None, "org/")
    assert (got[300].verdict, got[301].verdict) == ("block", "allow")
    one = urls.judge(spark.createDataFrame(rows[:3], "page_id long, url string"), rules=[("allow", "org", "/")])
    assert one.where("verdict = 'allow'").count() == 3
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def url_parts(url):
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (brute.ascii_lower(m[1]), m[2]) if m else ("", "")


def test_urls_equal_a_plain_reading_and_hold_out(spark):
    """Host, path and rule of many urls by a plain reader; what the model says about rule urls it was not fitted on."""
    rng = np.random.default_rng(2)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    rows = [(i, pick("http://", "https://", "", "x://y://", "HTTP://") + pick("example.org", "a.Example.ORG", "b.com", "c.com", "d.net", "org", "notexample.org", "") + pick("/", "/es/", "/en/1", "/en/12/x", "/fr/", "/de/a", "/de", "", "?q=/de/", "#/fr/") + str(rng.integers(50))) for i in range(1500)] + [(9000, None), (9001, ""), (9001, "")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    of = dict(rows)
    for r in got:
        host, path = url_parts(of[r.page_id])
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.p_block >= 0.5 else "allow"))
    known = [(h, p, int(v == "block")) for r in got if r.rule for h, p, v in [(r.host, r.path, r.verdict)]]
    train = spark.createDataFrame([x for i, x in enumerate(sorted(set(known))) if i % 3], "host string, path string, label int")
    held = [x for i, x in enumerate(sorted(set(known))) if i % 3 == 0]
    model = urls.fit(train)
    scored = model.transform(urls.features(spark.createDataFrame(held, "host string, path string, label int"))).select("label", "prediction").collect()
    assert len(held) > 50 and np.mean([x.label == x.prediction for x in scored]) > 0.95


def test_urls_sample_is_of_the_least_hashes(spark):
    rows = spark.range(3000).select(F.concat(F.lit("h"), F.col("id") % 1500).alias("host"), F.lit("/").alias("path"), F.lit(1).alias("label"))
    want = {r.host for r in rows.distinct().orderBy(F.xxhash64("host", "path")).limit(100).collect()}
    assert {r.host for r in urls.least_distinct(rows, 100).collect()} == want
    assert urls.least_distinct(rows.limit(0), 100).count() == 0


def test_licences_equal_a_plain_scan(spark, docs):
    """Every window of every paragraph scored alone, by the same model."""
    names = ["Licensed under the Apache License, Version 2.0.", "MIT License", "see the BSD license", "the general public", "GPL version 2 or CC BY-SA 4.0"]
    rows = [(i, prose(i, 7 * i) + "\n \n" * (i % 2) + " " + names[i % 5] + " " + prose(i + 50, 5 * (i % 7))) for i in range(25)] + [(30, None), (31, "x " * 30_000 + "MIT License")]
    model = licences.fit(spark.createDataFrame(docs, DOCS))
    got = {r.doc_id: (r.n_paragraphs, r.licences, r.unconfirmed) for r in licences.scan(spark.createDataFrame(rows, DOCS), model).collect()}
    for doc, text in rows:
        sure, maybe, n = set(), set(), 0
        for ws in licences.paragraphs(text):
            n += 1
            for cut in licences.windows(ws):
                own = ws[cut]
                z = licences.logits(model, licences.hashes(own), np.array([len(own)]))[0] / model.temperature
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                each = 1 / (1 + np.exp(z[licences.UNKNOWN] - z[: licences.UNKNOWN]))
                best = int(z[: licences.UNKNOWN].argmax())
                sure |= {f for i, f in enumerate(licences.FAMILIES) if each[i] >= 0.5 and licences.confirmed(f, own, 0.8)}
                if p[best] >= 0.5 and each.max() >= 0.5:
                    maybe.add(licences.FAMILIES[best])
        assert got[doc] == (n, sorted(sure), sorted(maybe - sure)), doc
    assert got[31][1] == ["mit"]


def test_licences_fit_sends_no_texts_to_the_driver(spark, monkeypatch):
    sent, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: (sent.append(self.columns), collect(self))[1])
    licences.fit(spark.createDataFrame([(i, prose(i, 60)) for i in range(30)] + [(99, None), (7, prose(7, 60))], DOCS), sample=10)
    assert sent == [["h"], ["h", "window"]]


def test_working_tables_can_be_dropped(spark):
    one, two = common.stored(spark.range(3)), common.stored(spark.range(4))
    common.drop_stored(spark, one)
    assert two.count() == 4 and one._orfspark_path not in common.working_tables(spark)
    with pytest.raises(Exception):
        one.count()


def test_licences(spark, docs):
    rows = [*docs[:10], (50, prose(1, 30) + "\nReleased under the MIT License.\n" + prose(2, 30)), (51, "This work is licensed under the GNU General Public License, version 3."), (52, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (53, None), (54, " \n"), (55, "the general public may see the film")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, DOCS).withColumn("licences", F.lit("clash"))).collect()}
    assert (got[50].licences, got[51].licences, got[52].licences) == (["mit"], ["gpl"], ["apache", "cc-by-nc"])
    assert all(got[d].licences == [] for d in [*range(10), 53, 54, 55]) and got[53].n_paragraphs == 0
    assert licences.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_licences_bodies_wraps_two_in_one_and_long_lines(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software")'
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    rows = [(i, prose(i, 80)) for i in range(40)]
    rows += [(50, mit), (51, bsd), (52, "Licensed under the Apache License,\nVersion 2.0"), (53, "MIT License or Apache License 2.0"), (54, prose(60, 900) + " Released under the Mozilla Public License, version 2.0. " + prose(61, 900)), (55, "one\ntwo\n \nthree")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[d].licences for d in range(50, 56)] == [["mit"], ["bsd"], ["apache"], ["apache", "mit"], ["mpl"], []]
    assert got[55].n_paragraphs == 2 and all(got[d].licences == [] for d in range(40))


def test_quality(spark):
    rows = [(i, prose(i, 80), "en") for i in range(300)] + [(1000 + i, " ".join(f"qz{i}x{j}" for j in range(50)), "en") for i in range(10)] + [(2000, None, "en"), (2001, "", None), (2002, prose(7, 10), None)]
    labels = [(i, 1) for i in range(250)] + [(1000, 0), (1001, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(df, lab).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[d].kept for d in range(250, 300)]) > 0.9 and not any(got[1000 + i].kept for i in range(10))
    assert got[2000].n_words == 0
    want = kneser_ney([r for r in rows if r[0] < 250], rows)
    assert all(abs(got[d].perplexity - p) <= 1e-4 * p for d, p in want.items())
    assert quality.judge(df.limit(0), lab).count() == 0
    assert quality.judge(df, lab.limit(0)).where("not kept").count() == 0


def test_quality_vocabulary_cuts_above_100000(spark, monkeypatch):
    """More words beyond a count of 100,000 than the vocabulary has room for: the most frequent ones stay known."""
    monkeypatch.setattr(quality, "WORDS", 4)
    rows = [("a b c " * 1000,)] * 100 + [("a a a b b c rare",)]
    assert quality.vocabulary(spark.createDataFrame(rows, "text string")) == (["a", "b"], 2)
    assert quality.vocabulary(spark.createDataFrame([("a b c " * 10,)], "text string")) == ([], 3)


def kneser_ney(good, rows):
    """Plain version of the same model; the vocabulary holds every word that repeats counts allow."""
    import binascii
    import math
    from collections import Counter

    train = [t for d, t, _ in good if binascii.crc32(str(d).encode()) % 5]
    known = {w for w, _ in Counter(w for t in train for w in t.split()).items()}
    kind = lambda w: w if w in known or w == "<>" else "?"
    pairs = lambda t: list(zip(["<>", *t.split()], [*t.split(), "<>"], strict=True))
    c = Counter((kind(v), kind(w)) for t in train for v, w in pairs(t))

    def cuts(ns):
        n = [max(1.0, sum(1 for x in ns if x == k)) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [min(max(x, 0.05), hi) for x, hi in zip(d, (0.95, 1.95, 2.95), strict=True)]

    cut = lambda n, d: n - (d[min(n, 3) - 1] if n else 0)
    d2 = cuts(c.values())
    cont = Counter(w for _, w in c)
    d1 = cuts(cont.values())
    whole = sum(cont.values())
    spare = sum(n - cut(n, d1) for n in cont.values()) / whole / quality.WORDS
    total, after = Counter(), {}
    for (v, _), n in c.items():
        total[v] += n
        after.setdefault(v, []).append(n)
    back = {v: sum(n - cut(n, d2) for n in ns) / total[v] for v, ns in after.items()}
    out = {}
    for d, t, _ in rows:
        logp = 0.0
        ws = pairs((t or "").lower())
        for v, w in ws:
            v, w = kind(v), kind(w)
            low = cut(cont[w], d1) / whole + spare
            p = cut(c[v, w], d2) / total[v] + back[v] * low if total[v] else low
            logp += math.log(p)
        out[d] = math.exp(-logp / len(ws))
    return out


def test_pipeline(spark, tmp_path):
    """The stages one after another against brute force on each stage's own input."""
    import corpus_pipeline

    passage = prose(77, 55)
    rows = [(i, prose(i, 60), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, prose(300 + i, 30) + " moron scum idiot " + prose(i, 30), "en", "s", 1) for i in range(40)]
    rows += [(300, rows[0][1], "en", "s", 1), (301, prose(900, 20) + " " + passage, "en", "s", 1), (302, passage + " " + prose(901, 40), "en", "s", 1), (303, prose(950, 40), "en", "s", 1), (304, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(950, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {"docs": {r.doc_id: r.text for r in df.collect()}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = common.stored(stage(spark, df, str(tmp_path)))
        assert df.columns == corpus_pipeline.COLUMNS
        seen[name] = {r.doc_id: r.text for r in df.collect()}
    toxic = set(seen["docs"]) - set(seen["toxicity"])
    assert toxic == {200 + i for i in range(40)}
    groups = brute.simhash(list(seen["toxicity"].items()))
    assert set(seen["simhash_near_dedup"]) == {c for _, c in groups.values()}
    want = brute.substrings(list(seen["simhash_near_dedup"].items()))
    assert {d for d, t in seen["substring_dedup"].items() if t != seen["simhash_near_dedup"][d]} == {d for d, w in want.items() if w[1]} >= {302}
    hit = brute.decontaminate(list(seen["substring_dedup"].items()), [(1, prose(950, 40))])
    assert set(seen["decontamination"]) == {d for d, w in hit.items() if not w[-1]} and 303 not in seen["decontamination"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r.doc_id for r in packed} == set(seen["decontamination"])


@pytest.fixture(scope="module")
def long_docs(spark):
    """One text of some MB beside short ones."""
    long = prose(5, 200_000)
    return spark.createDataFrame([(1, long), (2, "short text"), (3, long[:1_000_000] + " tail"), (4, None), (5, "x" * 1_000_000)], DOCS).repartition(2)


def test_long_texts_decontaminate(spark, long_docs):
    items = spark.createDataFrame([(1, prose(5, 40)), (2, "x" * 1_000_000)], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.scan(long_docs, items).select("doc_id", "n_words", "n_hit").collect()}
    assert found[1][0] == 200_000 and found[1][1] >= 40 and found[5] == (1, 1) and found[2] == (2, 0)


def test_long_texts_simhash_and_substrings(spark, long_docs):
    same = {r.doc_id: r.component_id for r in simhash.near_duplicates(long_docs).collect()}
    assert len(same) == 5 and same[1] == 1
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup(long_docs).select("doc_id", "n_words", "n_removed").collect()}
    assert cut[1][0] == 200_000 and cut[3][1] >= cut[3][0] - 2 and cut[4] == (0, 0) and cut[5] == (1, 0)


def test_long_texts_classifiers(spark, long_docs):
    assert {r.doc_id: r.licences for r in licences.scan(long_docs).collect()}[1] == []
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.score(long_docs, labels).where("score between 0 and 1").count() == 5
    good = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    judged = {r.doc_id: r.n_words for r in quality.judge(long_docs.withColumn("lang", F.lit("en")), good).collect()}
    assert judged[1] == 200_000 and judged[5] == 1 and judged[4] == 0


def test_long_texts_chat_and_urls(spark):
    talk = spark.createDataFrame([(1, 0, "user", prose(5, 200_000)), (1, 1, "assistant", "x" * 1_000_000)], "conv_id long, turn long, role string, text string")
    assert [(r.n_turns, r.loss_chars) for r in chat.digest(chat.windows(talk)).collect()] == [(2, 1_000_000)]
    pages = spark.createDataFrame([(1, "http://a.org/" + "y" * 1_000_000), (2, "http://a.net/" + "y" * 1_000_000), (3, "http://a.com/de/1")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages).select("page_id", "rule", "verdict").collect()}
    assert got[1] == ("org/", "allow") and got[2][0] is None and got[3] == ("com/de/", "block")


def test_null_ids_and_repeated_rows_elsewhere(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "MIT License")]
    df = spark.createDataFrame(rows, DOCS)
    ids = lambda out: sorted(r.doc_id or 0 for r in out.collect())
    assert ids(licences.scan(df)) == ids(toxicity.score(df, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int"))) == [0, 0, 7, 7, 8]
    assert ids(quality.judge(df.withColumn("lang", F.lit("en")), spark.createDataFrame([(7, 1)], "doc_id long, quality int"))) == [0, 0, 7, 7, 8]
    assert ids(simhash.near_duplicates(df)) == [0, 0, 7, 7, 8]


def test_pipeline_on_empty_tables_null_ids_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    docs = "doc_id long, text string, lang string, source string, n_chars long, score double, _hash string"
    def written(name, rows):
        for table, data, schema in (("documents", rows, docs), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        return f"{tmp_path}/{name}"

    assert corpus_pipeline.run(spark, written("empty", [])).count() == 0
    rows = [(None, "no id " + prose(1, 20), None, None, None, 1.0, "h"), (1, prose(2, 20), "en", "s", 3, 1.0, "h"), (1, prose(2, 20), "en", "s", 3, 1.0, "h"), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, None, None)]
    out = corpus_pipeline.run(spark, written("odd", rows)).collect()
    assert {r.doc_id for r in out} == {None, 1, 2}  # 2 and 3 are empty texts, hence copies
    assert len({(r.doc_id, r.start) for r in out if r.doc_id == 1}) == sum(r.doc_id == 1 for r in out)
