"""Six frames over chunks against a plain walk, and digestion against string cuts."""

import re

import numpy as np
import pytest

from orfspark.functions import expr as X
from orfspark.operators import genome


def plain_frames(chrom, seq, min_aa):
    code = dict(zip(X.CODONS, X.CODE, strict=True))
    out = []
    for strand in "+-":
        dna = seq if strand == "+" else seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for frame in range(3):
            aa = "".join(code.get(dna[i : i + 3], "*") for i in range(frame, len(dna) - 2, 3))
            at = 0
            for part in aa.split("*"):
                start = frame + 3 * at + 1
                if len(part) >= min_aa:
                    out.append((chrom, strand, frame + 1, start if strand == "+" else len(seq) - start + 1, len(part), part))
                at += len(part) + 1
    return out


@pytest.mark.parametrize("size", [6, 9, 30, 3000])
def test_six_frames_over_chunks(spark, size):
    rng = np.random.default_rng(2)
    contigs = [(f"c{k}", "".join(rng.choice(list("ACGT"), n))) for k, n in enumerate((200, 61, 60, 59, 7, 3, 2))]
    contigs += [("open", "GCA" * 80), ("stops", "TAA" * 30), ("odd", "ACGTNNacgtAC" * 9), ("n", "N" * 20), ("none", ""), ("null", None)]
    got = genome.six_frame(spark.createDataFrame(contigs, "chrom string, seq string").repartition(3), 3, size)
    rows = sorted((r.chrom, r.strand, r.frame, r.start_nuc, r.length, r.seq) for r in got.collect())
    assert rows == sorted(x for c, s in contigs if s for x in plain_frames(c, s, 3))


def test_digest(spark):
    rng = np.random.default_rng(6)
    seqs = [(k, "".join(rng.choice(list("AKRPG"), 80))) for k in range(6)] + [(10, ""), (11, None), (12, "KKKK"), (13, "AAAA")]
    want = []
    for k, s in seqs:
        parts, at = [p for p in re.split("(?<=[KR])(?!P)", s or "") if p], 1
        for i, p in enumerate(parts):
            want += [(k, at, "".join(parts[i : i + n])) for n in range(1, 4) if i + n <= len(parts) and 2 <= len("".join(parts[i : i + n])) <= 20]
            at += len(p)
    got = genome.digest(spark.createDataFrame(seqs, "seq_id int, seq string"), 2, 2, 20)
    assert sorted((r.seq_id, r.pos, r.aminos) for r in got.collect()) == sorted(want)


def test_chunks_are_translated_together(monkeypatch):
    """the frames of all chunks of a batch take as many steps as those of one."""
    rng = np.random.default_rng(8)
    seqs = ["".join(rng.choice(list("ACGTN"), int(n), p=[0.24, 0.24, 0.24, 0.24, 0.04])) for n in rng.integers(1, 33, 400)]
    at, n = 30 * rng.integers(0, 3, 400), np.full(400, 90)
    steps = []
    monkeypatch.setattr(genome, "base_numbers", lambda seq, plain=genome.base_numbers: steps.append(len(seq)) or plain(seq))

    def rows(own):
        out = []
        for row, strand, off, lo, hi, texts, left, right in genome.chunk_frames([seqs[i] for i in own], at[own], n[own], 30, 3):
            out += [(own[r], strand, off, *x) for r, *x in zip(row.tolist(), lo.tolist(), hi.tolist(), texts.to_pylist(), left.tolist(), right.tolist(), strict=True)]
        return sorted(out)

    together = rows(list(range(400)))
    assert len(steps) == 1 and together == sorted(x for i in range(400) for x in rows([i]))
    assert rows([]) == []
