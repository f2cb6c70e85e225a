"""Operator 3, benchmark decontamination over a distributed positional inverted index.

Everything runs on DataFrame functions. The index holds (term, doc_id, row_id,
pos). A window of item words is found by intersecting the posting lists of its
two rarest terms, adjusted by their offset; what meets are places where a window
may start, and there the document's words are compared with the windows' own.

Equal windows are one, whatever the items they stand in, and windows that share
their rarest pair at one distance share a pattern, so patterns are few and
candidates are at most a few for each posting of a rare term, also in texts of
one word. Only the patterns' terms are posted when the index serves one
benchmark (about one word in a hundred), while `build_index` without terms posts
every word. Texts are shuffled nowhere unless documents with candidates are too
many to be broadcast by number. `scan` stores the postings in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_cells, broadcast_within, free_prefix, others, quoted, read_table, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def run_of(letters: str) -> str:
    """Pattern of runs of ASCII `letters` and signs beyond ASCII. It names each sign it leaves out: single signs are looked
    up in one table, ranges tried one by one, which took most of the time of every pass."""
    return "[^" + "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in letters) + "]+"


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text, and the same of text as it is.
WORD = run_of("0123456789" + LOWER)
WORD_OF_ANY_CASE = run_of("0123456789" + UPPER + LOWER)
#: Rows of the benchmark's terms and pairs up to which they are broadcast.
MAX_BROADCAST = 500_000


def words(text: str | Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def n_words(text: str | Column) -> Column:
    """How many words `words` finds; capitals need no lower-casing to be counted."""
    return F.regexp_count(text, F.lit(WORD_OF_ANY_CASE))


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc_id, row_id, pos from 0) of (doc_id, row_id, text); terms: (term) to restrict to."""
    posted = docs.select("doc_id", "row_id", F.posexplode(words("text")).alias("pos", "term"))
    if terms is not None:
        posted = posted.join(broadcast_within(terms.select("term").distinct(), MAX_BROADCAST), "term")
    return posted.select("term", "doc_id", "row_id", "pos")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in docs of each of the terms, 0 included."""
    small = broadcast_within(terms.select("term").distinct(), MAX_BROADCAST)
    seen = docs.select(F.explode(words("text")).alias("term")).join(small, "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.select("term").distinct().join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, w): the distinct windows of `size` words of (item_id, item); an item of fewer words is one window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("item") - size + 1, F.lit(1)))
    cut = items.where("size(item) > 0").select("item_id", "item", F.explode(starts).alias("s"))
    return cut.select("item_id", F.slice("item", F.col("s"), size).alias("w")).distinct()


def patterns(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(pattern, pa, n, a, b, delta) of distinct windows (w): term b stands delta places behind term a, the rarest one,
    which stands pa places behind the start of a window of n words. A window of one word has it for both terms."""
    spread = windows.select("w", F.posexplode("w").alias("place", "term")).join(broadcast_within(counts, MAX_BROADCAST), "term")
    ranked = spread.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("n", "term", "place"))).alias("r"))
    a, b = F.col("r")[0], F.coalesce(F.try_element_at("r", F.lit(2)), F.col("r")[0])
    out = ranked.select(a["term"].alias("a"), b["term"].alias("b"), (b["place"] - a["place"]).alias("delta"), a["place"].alias("pa"), F.size("w").alias("n"))
    return out.select(F.xxhash64("a", "b", "delta").alias("pattern"), "*").distinct()


def candidates(index: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, row_id, s, n): places from 0 where a window of n words may start."""
    slots = F.array(F.struct(F.lit(1).alias("slot"), F.col("a").alias("term"), F.lit(0).alias("shift")), F.struct(F.lit(2).alias("slot"), F.col("b").alias("term"), F.col("delta").alias("shift")))
    pairs = found.select("pattern", "a", "b", "delta").distinct().select("pattern", F.explode(slots).alias("x")).select("pattern", "x.slot", "x.term", "x.shift")
    met = index.join(broadcast_within(pairs, MAX_BROADCAST), "term").select("doc_id", "row_id", "pattern", (F.col("pos") - F.col("shift")).alias("at"), "slot")
    both = met.groupBy("doc_id", "row_id", "pattern", "at").agg(F.bit_or("slot").alias("slots")).where("slots = 3")
    starts = both.join(broadcast_within(found.select("pattern", "pa", "n").distinct(), MAX_BROADCAST), "pattern")
    return starts.select("doc_id", "row_id", (F.col("at") - F.col("pa")).alias("s"), "n").where("s >= 0").distinct()


def verified(docs: DataFrame, candidate: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, row_id, s, n, wid): the candidates whose words are those of a window (wid, w). docs: doc_id, row_id, text."""
    places = stored(candidate.groupBy(F.col("doc_id").alias("_doc"), F.col("row_id").alias("_key")).agg(F.collect_list(F.struct("s", "n")).alias("places")))
    hit = docs.join(broadcast_within(places.select("_key").distinct(), MAX_BROADCAST), F.col("row_id") == F.col("_key"), "left_semi")
    joined = hit.join(places, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_id") == F.col("_key"))).select("doc_id", "row_id", "places", words("text").alias("ws"))
    cut = F.transform("places", lambda p: F.struct(p["s"].alias("s"), p["n"].alias("n"), F.slice("ws", p["s"] + 1, p["n"]).alias("w")))
    rows = joined.select("doc_id", "row_id", F.explode(cut).alias("c")).select("doc_id", "row_id", "c.s", "c.n", "c.w")
    return rows.join(broadcast_within(windows, MAX_BROADCAST // 5), "w").select("doc_id", "row_id", "s", "n", "wid").distinct()


def covered(spans: Column) -> Column:
    """Number of places in the union of (lo, hi) spans."""
    state = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["hi"]).alias("to")),
    )
    return state["n"]


def scan(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """All columns of docs, and n_words, n_hit, n_items, items (sorted as strings), contaminated.

    Docs need doc_id and text; items need item_id and text. A document word is
    hit if it lies in any occurrence of `size` consecutive item words (of the
    whole item if it has fewer, but not none). A document is contaminated if it
    has a hit and a twentieth of its words at least are hit. Null and empty
    texts have no words and are clean; repeated rows and rows without doc_id are
    judged each on their own text. Several texts of one item_id are texts of one
    item; items without item_id hit words and are not listed. Empty tables give
    an empty table or clean documents. Columns of docs that have the result's
    names, in capitals or not, are replaced; all other names are free.
    """
    columns, free = quoted(others(docs, "n_words", "n_hit", "n_items", "items", "contaminated")), free_prefix(docs)
    doc, row, of_row, hit, listed_items = (free + x for x in ("doc", "row", "key", "hit", "items"))
    named = docs.select(*columns, F.xxhash64("doc_id", "text").alias(row), F.coalesce(n_words("text"), F.lit(0)).cast("long").alias("n_words"))
    narrow = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_id"), "text")
    own = stored(item_windows(items.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("item")), size))
    windows = stored(own.select("w").distinct().select(F.monotonically_increasing_id().alias("wid"), "w"))
    counts = stored(term_counts(narrow, windows.select(F.explode("w").alias("term"))))
    found = stored(patterns(windows, counts))
    terms = found.select(F.explode(F.array("a", "b")).alias("term"))
    index = stored(build_index(narrow, terms))
    hits = stored(verified(narrow, candidates(index, found), windows))
    key = [F.col("doc_id").alias(doc), F.col("row_id").alias(of_row)]
    spans = hits.groupBy(*key).agg(covered(F.collect_set(F.struct(F.col("s").alias("lo"), (F.col("s") + F.col("n")).alias("hi")))).alias(hit))
    in_items = own.where("item_id is not null").join(windows, "w").select("wid", "item_id")
    listed = hits.select(*key, "wid").distinct().join(broadcast_within(stored(in_items), MAX_BROADCAST), "wid").select(doc, of_row, "item_id").distinct()
    listed = listed.groupBy(doc, of_row).agg(F.array_sort(F.collect_list("item_id")).alias(listed_items))
    same = F.col(f"s.{doc}").eqNullSafe(F.col(f"l.{doc}")) & (F.col(f"s.{of_row}") == F.col(f"l.{of_row}"))
    judged = stored(spans.alias("s").join(listed.alias("l"), same, "left").select(f"s.{doc}", f"s.{of_row}", hit, listed_items))
    of_same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(row) == F.col(of_row))
    joined = named.join(broadcast_cells(judged, F.coalesce(F.size(listed_items), F.lit(0)) + 1, MAX_BROADCAST), of_same, "left")
    none = F.array().cast("array<string>")
    joined = joined.select(*columns, "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.when(F.size(listed_items) > 0, F.col(listed_items)).otherwise(none).alias("items"))
    return joined.select(
        *columns, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def proximity(index: DataFrame, phrase: list[str], slop: int) -> DataFrame:
    """(doc_id, row_id, pos): places where the first word of phrase stands and each other word stands within
    slop of its place behind it. Slop 0 is the exact phrase. An empty phrase matches nothing."""
    if not phrase:
        return index.select("doc_id", "row_id", "pos").where(F.lit(False))
    spark = index.sparkSession
    spread = "term string, place int"
    wanted = spark.createDataFrame([(w, i) for i, w in enumerate(phrase)], spread)
    met = index.join(F.broadcast(wanted), "term")  # as many rows as the phrase has words
    heads = met.where("place = 0").select("doc_id", "row_id", F.col("pos").alias("head"))
    rest = met.where("place > 0").select("doc_id", "row_id", "pos", "place")
    near = F.array(*[F.lit(d) for d in range(-slop, slop + 1)])
    rest = rest.select("doc_id", "row_id", "place", F.explode(F.transform(near, lambda d: F.col("pos") - F.col("place") + d)).alias("head"))
    shifted = heads.select("doc_id", "row_id", "head", F.lit(0).alias("place")).union(rest.select("doc_id", "row_id", "head", "place"))
    whole = shifted.groupBy("doc_id", "row_id", "head").agg(F.size(F.collect_set("place")).alias("n")).where(F.col("n") == len(phrase))
    return whole.join(heads, ["doc_id", "row_id", "head"], "left_semi").select("doc_id", "row_id", F.col("head").alias("pos"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
