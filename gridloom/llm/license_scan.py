"""Licence scan: a trained paragraph classifier with an unknown class.

A notice may be one line or wrapped over several.  Lines with a word that follow
each other form a block; its lines are judged each by itself, and so is every
run of lines from one that shares a three-gram with a template to another, as
long as the longest template and as much again.  Of candidates that rest on the
same words the one with most three-grams of a template counts.  A multinomial logistic regression over word
one- and two-grams is trained on variants of notice templates against lines of
the corpus and shuffled template words, with a class for anything else.  Its
temperature is set on variants left out of training, so the probability of a
family can be read as one.  A prediction is confirmed by comparing the
paragraph's word three-grams with the family's templates.
"""

from __future__ import annotations

import bisect
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

UNKNOWN = "unknown"
#: Short notices by which licences are usually declared.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Distributed under the terms of the GPL version 3.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal into the public domain."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Licensed under the ISC License."),
    "Proprietary": ("All rights reserved.", "This document is proprietary and confidential; unauthorized copying is strictly prohibited.", "Copyright the authors. All rights reserved."),
}
FAMILIES = [*TEMPLATES, UNKNOWN]

#: Lines of the corpus that serve as other text in training: a bounded sample.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 200, 1500
VARIANTS = 24
LEAST_PROBABILITY = 0.5
CONFIRM = 0.6
#: Words between first and last line of a candidate at most, in lengths of the longest template.
REACH = 2
EPOCHS, RATE, DECAY = 150, 4.0, 1e-4

_WORD = re.compile(r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]")


def words_of(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def grams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


def _triples(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def variants(rng: random.Random, words: list[str]) -> list[str]:
    """A notice as it may stand in the wild: words lost, replaced, cut off or added."""
    out = [w for w in words if rng.random() > 0.06] or list(words)
    if len(out) > 12 and rng.random() < 0.4:
        at = rng.randrange(len(out) - 8)
        out = out[at : at + rng.randint(8, len(out))]
    if rng.random() < 0.4:
        out = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(1, 6))] + out
    if rng.random() < 0.4:
        out = out + [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(1, 6))]
    return out


class Model:
    """Weights of known n-grams by class, a temperature, and the templates' three-grams."""

    def __init__(self, other_lines: list[str], seed: int = 5):
        rng = random.Random(seed)
        known = {f: [words_of(t) for t in ts] for f, ts in TEMPLATES.items()}
        self.triples = {f: [_triples(w) for w in ws] for f, ws in known.items()}
        self.any_triple = {g for ts in self.triples.values() for t in ts for g in t}
        self.reach = REACH * max(len(w) for ws in known.values() for w in ws)
        rows, labels, held = [], [], []
        for k, f in enumerate(TEMPLATES):
            for w in known[f]:
                for i in range(VARIANTS):
                    rows.append(grams(w if i == 0 else variants(rng, w)))
                    labels.append(k)
                    held.append(i % 4 == 3)
        pool = sorted({x for ws in known.values() for w in ws for x in w})
        shuffled = [[rng.choice(pool) for _ in range(rng.randint(1, 6))] + [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(2, 12))] for _ in range(600)]
        # neither much of a template nor, as the lines of a wrapped notice, mostly from one
        plain = [w for w in map(words_of, other_lines) if max((len(_triples(w) & t) / len(t) for ts in self.triples.values() for t in ts), default=0) < 0.3 and 2 * len(_triples(w) & self.any_triple) <= len(_triples(w))]
        for i, w in enumerate([*shuffled, *plain, []]):
            rows.append(grams(w))
            labels.append(len(TEMPLATES))
            held.append(i % 4 == 3)
        in_templates = {g for ws in known.values() for w in ws for g in grams(w)}
        self.vocabulary = {g: i for i, g in enumerate(sorted(in_templates))}
        x = np.zeros((len(rows), len(self.vocabulary) + 2), np.float32)
        for i, r in enumerate(rows):
            x[i] = self.vector(r)
        y = np.eye(len(FAMILIES), dtype=np.float32)[labels]
        train = ~np.array(held)
        w = np.zeros((x.shape[1], len(FAMILIES)), np.float32)
        speed = np.zeros_like(w)
        for _ in range(EPOCHS):
            grad = x[train].T @ (self._softmax(x[train] @ w) - y[train]) / train.sum() + DECAY * w
            speed = 0.9 * speed - RATE * grad
            w = w + speed
        self.weights = w
        z, t = x[~train] @ w, y[~train]
        loss = {s: -np.log(np.maximum((self._softmax(z / s) * t).sum(1), 1e-9)).mean() for s in np.geomspace(0.2, 5, 41)}
        self.temperature = min(loss, key=loss.get)
        self.held_out_accuracy = float((z.argmax(1) == t.argmax(1)).mean())

    def vector(self, gram_set: set[str]) -> np.ndarray:
        """Known n-grams, the share of n-grams that are not known, and a constant."""
        out = np.zeros(len(self.vocabulary) + 2, np.float32)
        hits = [i for i in map(self.vocabulary.get, gram_set) if i is not None]
        out[hits] = 1.0 / np.sqrt(len(hits) + 1.0)
        out[-2] = 1 - len(hits) / max(len(gram_set), 1)
        out[-1] = 1
        return out

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def classify(self, words: list[str]) -> tuple[str, float, float, set] | None:
        """(family, probability, template similarity, three-grams of the template most of which is there), or None where the class is unknown."""
        p = self._softmax(self.vector(grams(words)) @ self.weights / self.temperature)
        k = int(p.argmax())
        if FAMILIES[k] == UNKNOWN or p[k] < LEAST_PROBABILITY:
            return None
        own = _triples(words)
        shared = [(len(own & t) / len(t), len(own & t), t) for t in self.triples[FAMILIES[k]]]
        return FAMILIES[k], float(p[k]), max(s for s, _, _ in shared), max(shared, key=lambda x: (x[0] >= CONFIRM, x[1]))[2]

    def notices(self, text: str) -> list[tuple[int, int, str, float, float]]:
        """(first line, last line, family, probability, template similarity) of each notice."""
        out, block, before = [], [], ""
        for number, line in enumerate([*text.split("\n"), ""]):
            words = words_of(line)
            if words:
                # a template's word that was wrapped at its hyphen
                if block and before.endswith("-") and block[-1][1] and f"{block[-1][1][-1]}-{words[0]}" in self.vocabulary:
                    block[-1][1][-1] += f"-{words.pop(0)}"
                block.append((number, words))
            elif block:
                out += self._in_block(block)
                block = []
            before = line.rstrip()
        return out

    def _in_block(self, block: list[tuple[int, list[str]]]) -> list[tuple[int, int, str, float, float]]:
        words = [w for _, ws in block for w in ws]
        known = self.vocabulary
        # two neighbouring words that some template has: without them nothing speaks for a family
        pairs = [k for k, (a, b) in enumerate(zip(words, words[1:])) if f"{a} {b}" in known]
        if not pairs:
            return []
        line_of = [i for i, (_, ws) in enumerate(block) for _ in ws]
        start = [0]
        for _, ws in block:
            start.append(start[-1] + len(ws))
        spots = [k for k, after in zip(pairs, pairs[1:]) if after == k + 1 and tuple(words[k : k + 3]) in self.any_triple]
        spans = {(line_of[k], line_of[k]) for k in pairs if line_of[k] == line_of[k + 1]}
        lasts = sorted({line_of[k + 2] for k in spots})
        for i in {line_of[k] for k in spots}:
            for j in lasts[bisect.bisect_right(lasts, i) :]:
                if start[j] - start[i + 1] > self.reach:
                    break
                spans.add((i, j))
        found = []
        for i, j in spans:
            a, b = start[i], start[j + 1]
            hit = self.classify(words[a:b])
            if hit:
                family, p, s, template = hit
                at = [k for k in spots[bisect.bisect_left(spots, a) : bisect.bisect_left(spots, b - 2)] if tuple(words[k : k + 3]) in template]
                found.append((s < CONFIRM, -len(_triples(words[a:b]) & template), j - i, -p, i, j, family, s, at[0] if at else a, at[-1] + 3 if at else b))
        taken, out = bytearray(len(words)), []
        for *_, p, i, j, family, s, a, b in sorted(found):
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((block[i][0], block[j][0], family, -p, s))
        return sorted(out)


def train(docs: DataFrame) -> Model:
    total = docs.count()
    every = max(1, total // SAMPLE_DOCUMENTS)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    # those of the least hashes, so that the model is the same however the table is dealt out
    drawn = some.withColumn("h", F.xxhash64("doc_id", "at", "line")).orderBy("h", "doc_id", "at", "line").limit(SAMPLE_LINES)
    return Model([r["line"] for r in drawn.collect() if r["line"]])


def license_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), last_line, family, probability, similarity, confirmed.

    One row per notice, of one line or more, that the classifier gives to a family.  Null and
    empty texts have none; rows with a null id and repeated rows are scanned
    like others; an empty table gives no rows; other columns are not read.
    """
    model = model or train(docs)

    def run(batches):
        for b in batches:
            at, first, last, family, p, s = [], [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                for found in model.notices(text or ""):
                    at.append(row)
                    for column, value in zip((first, last, family, p, s), found):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(family, pa.string()), pa.array(p, pa.float64()), pa.array(s, pa.float64()), pa.array([x >= CONFIRM for x in s], pa.bool_())], names=["doc_id", "paragraph", "last_line", "family", "probability", "similarity", "confirmed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, paragraph int, last_line int, family string, probability double, similarity double, confirmed boolean")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))
