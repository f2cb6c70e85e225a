"""Findings of round 3 on the training-data operators."""

import re

from pyspark.sql import functions as F

from orfspark.llm import decontaminate

UPPER, LOWER = decontaminate.UPPER, decontaminate.LOWER


def test_words_of_all_code_points_without_ranges(spark):
    """op3: ranges in the pattern took most of its time; the words are the contract's, whatever the code point."""
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    points = [*range(1, 0x500), *range(0x2000, 0x2100), 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    rows = [(p, f"a{chr(p)}B {chr(p)}{chr(p)} 9") for p in points] + [(-1, ""), (-2, None), (-3, " -_^]\\ ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.w, r.n) for r in df.select("doc_id", decontaminate.words("text").alias("w"), F.coalesce(decontaminate.n_words("text"), F.lit(0)).alias("n")).collect()}
    want = {d: plain.findall((t or "").translate(str.maketrans(UPPER, LOWER))) for d, t in rows}
    assert got == {d: (w, len(w)) for d, w in want.items()}
    for pattern in (decontaminate.WORD, decontaminate.WORD_OF_ANY_CASE):
        assert "-" not in pattern
