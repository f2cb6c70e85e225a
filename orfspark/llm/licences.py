"""Operator 5, licence scans: a trained paragraph classifier with an unknown class, confirmed by templates.

Paragraphs end at blank lines. Every paragraph of every document is scored, in
overlapping windows of bounded length, by a multinomial logistic regression on
sparse, hashed word n-grams. It is trained on licence notices, composed from
the names and openings below, on the licences' own texts, and on a bounded
sample of corpus windows as the unknown class. Probabilities are calibrated by
a temperature fitted on rows held out of the fit. A window can hold several
families: each counts whose probability against unknown is `least` or more and
of which a template is found in the window (share of the template's word pairs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, short_batches

#: Names under which licence families are cited.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL version 3", "AGPL-3.0", "AGPLv3"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-3-Clause", "BSD-2-Clause"],
    "cc0": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0 1.0"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "CC-BY license"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA"],
    "cc-by-nd": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU General Public License", "GPL-3.0", "GPL version 2", "GPLv3"],
    "isc": ["ISC License", "ISC license terms"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License version 2.1", "LGPL-3.0", "LGPLv3"],
    "mit": ["MIT License", "MIT license terms", "The MIT License (MIT)"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0", "MPL 2.0"],
    "unlicense": ["Unlicense", "The Unlicense public domain dedication"],
}
#: Openings of such notices.
OPENINGS = ["Licensed under the", "Licensed under", "Released under the", "Released under", "This work is licensed under the", "This work is licensed under", "Distributed under the terms of the", "This program is distributed under the", "SPDX-License-Identifier:", "License:", "This file is subject to the terms of the", "You may use this file under the"]
#: Passages of the licences' own texts that do not name them and that no other family here has.
BODIES = {
    "apache": ["you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "cc0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "mpl": ["If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
}
FAMILIES = sorted(NAMES)
UNKNOWN = len(FAMILIES)
HASH_BITS = 16
#: Words of a window, between the starts of two windows, and of a template from a licence's own text (at most STEP + 1).
WINDOW, STEP, STRETCH = 16, 8, 9
#: Corpus documents whose windows train the unknown class (a bound), and windows of each.
SAMPLE, PER_DOC = 1500, 4
#: Words handled together.
CHUNK = 500_000
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in b"\n" or 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Model:
    weight: np.ndarray  # (2 ** HASH_BITS, families + 1), float32
    bias: np.ndarray
    temperature: float


def paragraphs(text: str | None) -> list[list[bytes]]:
    """Words of each paragraph (up to a line without words) that has some: ASCII letters lower-cased, other ASCII signs as blanks."""
    if not text:
        return []
    return [ws for part in re.split(rb"\n *\n", text.encode("utf-8", "surrogatepass").translate(TABLE)) if (ws := part.split())]


def windows(words: list[bytes]) -> list[slice]:
    """Windows that hold every stretch of STEP + 1 words whole; a short paragraph is one."""
    return [slice(a, a + WINDOW) for a in range(0, max(len(words) - STEP, 1), STEP)]


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ngrams(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs inside paragraphs, with the paragraph of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    inside = owner[:-1] == owner[1:]
    slots = np.concatenate([h, (pair ^ (pair >> np.uint64(31)))[inside] * np.uint64(0xC2B2AE3D27D4EB4F)])
    return (slots >> np.uint64(64 - HASH_BITS)).astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def logits(model: Model, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    slot, owner = ngrams(h, counts)
    size = np.bincount(owner, minlength=len(counts))
    order = np.argsort(owner, kind="stable")
    total = np.add.reduceat(model.weight[slot[order]], np.cumsum(size) - size, axis=0)
    return total / np.sqrt(size)[:, None] + model.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_local(unknown: list[list[bytes]], steps: int = 120) -> Model:
    """Fit on composed notices and the given unknown paragraphs; every fourth row is held out for the temperature."""
    rows, y = [], []
    for c, family in enumerate(FAMILIES):
        for name in NAMES[family]:
            for k, opening in enumerate(["", *OPENINGS]):
                tail = ["", "see the file LICENSE for details", "all rights reserved"][k % 3]
                rows.append(paragraphs(f"{opening} {name} {tail}")[0])
                y.append(c)
        for body in BODIES.get(family, []):
            ws = paragraphs(body)[0]
            cuts = [*windows(ws), *(slice(a, a + STRETCH) for a in range(len(ws) - STRETCH + 1))]
            rows += [ws[cut] for cut in cuts]
            y += [c] * len(cuts)
    # the same inside other text
    for k in range(len(rows) if unknown else 0):
        room = max(WINDOW - len(rows[k]), 0)
        left, other = k % (room + 1), unknown[k % len(unknown)]
        rows.append(other[:left] + rows[k] + other[left:room])
        y.append(y[k])
    # openings alone and common mentions are no licence
    plain = [paragraphs(o + " following terms")[0] for o in OPENINGS] + [paragraphs(t)[0] for t in ("all rights reserved", "see the file for details", "public license", "the general public", "copyright notice")]
    few = plain * 4 + unknown
    rows += few
    y = np.array(y + [UNKNOWN] * len(few))
    counts = np.array([len(r) for r in rows])
    slot, owner = ngrams(hashes([w for r in rows for w in r]), counts)
    size = np.bincount(owner, minlength=len(rows))
    value = 1 / np.sqrt(size)[owner]
    held = np.arange(len(rows)) % 4 == 3
    classes = UNKNOWN + 1
    share = np.where(held, 0, 1.0 / np.maximum(np.bincount(y[~held], minlength=classes), 1)[y])
    share *= np.where(y == UNKNOWN, 4.0, 1.0)
    share /= share.sum()
    used, col = np.unique(slot, return_inverse=True)
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    vw, vb = w, b
    rate, penalty = 40.0, 1e-5
    order = np.argsort(owner, kind="stable")
    starts = np.cumsum(size) - size
    back = np.argsort(col, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(col, minlength=len(used)))[:-1]])
    for t in range(steps):
        z = np.add.reduceat((vw[col] * value[:, None])[order], starts, axis=0) + vb
        g = share[:, None] * (softmax(z) - target)
        gw = np.add.reduceat((g[owner] * value[:, None])[back], cut, axis=0) + penalty * vw
        nw, nb = vw - rate / 8 * gw, vb - rate / 80 * g.sum(axis=0)
        vw, vb = nw + t / (t + 3) * (nw - w), nb + t / (t + 3) * (nb - b)
        w, b = nw, nb
    weight = np.zeros((1 << HASH_BITS, classes), dtype=np.float32)
    weight[used] = w
    model = Model(weight, b, 1.0)
    z = np.add.reduceat((w[col] * value[:, None])[order], starts, axis=0) + b
    grid = np.geomspace(0.05, 4, 40)
    loss = [-np.log(softmax(z[held] / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def pairs_of(words: list[bytes]) -> set:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(words[0],)}


def stretches(words: list[bytes]) -> list[list[bytes]]:
    last = max(len(words) - STRETCH, 0)
    return [words[a : a + STRETCH] for a in {*range(0, last, 3), last}]


TEMPLATES = {f: [pairs_of(paragraphs(n)[0]) for n in NAMES[f]] + [pairs_of(t) for b in BODIES.get(f, []) for t in stretches(paragraphs(b)[0])] for f in FAMILIES}


def confirmed(family: str, words: list[bytes], least: float) -> bool:
    """Whether a template of the family is in the words: at least that share of its word pairs (one word: itself)."""
    own = set(zip(words, words[1:], strict=False)) | {(w,) for w in words}
    return any(len(t & own) >= least * len(t) for t in TEMPLATES[family])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Unknown windows come from at most `sample` distinct texts in order of their hash; tasks cut the windows out, so
    the driver gets hashes and windows.

    A sampled window that holds some template whole is left out, since it may be a notice.
    """
    keyed = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text")
    first = [r.h for r in keyed.select("h").distinct().orderBy("h").limit(sample).collect()]  # numbers alone
    if not first:
        return fit_local([])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [ws[cut] for ws in paragraphs(text.as_py()) for cut in windows(ws)]
                own = sorted({b" ".join(ws) for ws in own}, key=lambda x: (xxhash.xxh3_64_intdigest(x), x))[:PER_DOC]
                yield pa.RecordBatch.from_pydict({"h": pa.array([h] * len(own), pa.int64()), "window": pa.array(own, pa.binary())})

    some = keyed.where(F.col("h") <= first[-1]).mapInArrow(pick, "h long, window binary").distinct()
    unknown = [bytes(r.window).split() for r in some.orderBy("h", "window").collect()]  # at most PER_DOC windows of WINDOW words each
    unknown = [ws for ws in unknown if not any(confirmed(f, ws, 1.0) for f in FAMILIES)]
    return fit_local(unknown)


def scan(docs: DataFrame, model: Model | None = None, least: float = 0.5, similarity: float = 0.8, sample: int = SAMPLE) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_paragraphs, licences, unconfirmed.

    licences: sorted distinct families with calibrated probability `least`
    against unknown in some window and confirmed there by a template;
    unconfirmed: those that are only the likeliest class of a window at `least`.
    Null, empty and blank texts have no paragraphs and no licence; repeated rows
    are judged each; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sure: list[set] = [set() for _ in range(len(batch))]
            maybe: list[set] = [set() for _ in range(len(batch))]
            number = np.zeros(len(batch), dtype=np.int64)
            held: list[tuple[int, list[bytes], np.ndarray]] = []
            size = 0

            def flush() -> None:
                if not held:
                    return
                counts = np.array([len(ws) for _, ws, _ in held])
                z = logits(model, np.concatenate([h for *_, h in held]), counts) / model.temperature
                each = 1 / (1 + np.exp(np.clip(z[:, [UNKNOWN]] - z[:, :UNKNOWN], -40, 40)))
                best = z[:, :UNKNOWN].argmax(axis=1)
                p = softmax(z)[np.arange(len(best)), best]
                for i in np.flatnonzero(each.max(axis=1) >= least):
                    doc, ws, _ = held[i]
                    sure[doc].update(FAMILIES[f] for f in np.flatnonzero(each[i] >= least) if confirmed(FAMILIES[f], ws, similarity))
                    if p[i] >= least:
                        maybe[doc].add(FAMILIES[best[i]])
                held.clear()

            for i, text in enumerate(batch.column(1)):
                own = paragraphs(text.as_py())
                number[i] = len(own)
                for ws in own:
                    h = hashes(ws)
                    for cut in windows(ws):
                        held.append((i, ws[cut], h[cut]))
                        size += WINDOW
                        if size >= CHUNK:
                            flush()
                            size = 0
            flush()
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number), pa.array([sorted(s) for s in sure], strings), pa.array([sorted(m - s) for s, m in zip(sure, maybe, strict=True)], strings)],
                names=["doc_id", "n_paragraphs", "licences", "unconfirmed"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_paragraphs long, licences array<string>, unconfirmed array<string>")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_paragraphs", F.array_join("licences", ",").alias("licences"), F.array_join("unconfirmed", ",").alias("unconfirmed"))
