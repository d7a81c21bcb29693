"""Licence scans: a trained paragraph classifier, an unknown class, and a comparison with templates.

A paragraph is a run of lines up to a blank one (marks of comments don't count); its lines are scored one by one and
joined, both in overlapping windows of WINDOW words, by multinomial logistic regression over sparse word n-grams (one to
three words). Probabilities are calibrated by a temperature on held-out rows; what looks like a licence but whose best
family has less than the calibrated probability is ``unknown``. A predicted family is confirmed by comparing the window
with the family's templates (share of a template's word pairs that it holds, among them one with a word that few
families' templates have), else it is ``unknown`` too.

The classifier is trained in the driver from variants of the templates below and of misleading lines; the temperature
and the thresholds come from variants made otherwise (words swapped and lost more often) and from strange licences that
training hasn't seen. Its n-grams all hold a content word of the templates, so windows without any are certain to be no
licence and are not scored. Windows of many texts are scored at once.

Null and empty texts have no paragraphs; every text is scanned whole, however long; repeated rows are judged each on its
own; null ids are carried; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Usual short notices of licence families.
TEMPLATES = {
    "agpl": ["This program is free software under the GNU Affero General Public License, version 3.", "Licensed under the AGPL-3.0.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license."],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the 2-clause BSD license."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution license CC-BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC-BY-NC for noncommercial use."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL-3.0-or-later.", "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission.", "Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying is prohibited."],
    "public-domain": ["This work has been released into the public domain.", "This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal."],
}
#: Licences of none of these families, for calibrating the unknown class, and lines that aren't licences.
OTHERS = ["Licensed under the Zebra Community License, version 4.", "Released under the Harbor Source License.", "This work is licensed under the Open Lantern Agreement 1.1.", "Distributed under the terms of the Quartz Public Terms.", "Use is subject to the Meadow End User Agreement.", "Licensed under the Eclipse Terms of Use."]
MISLEADING = ["the driver lost his license last year", "a fishing license costs twenty dollars in this state", "the general public was invited to the free concert", "version 2 of the report was released in May", "she studied at MIT and worked for the city", "permission to enter was granted by the guard", "the apache helicopter landed on the source of the river", "the copyright office moved to a new building", "the work of the foundation is public", "all conditions of the contract were met without modification", "a free copy of the book was given to any person", "commons and fields under the castle", "mozilla opened a new office", "the library is open to the public", "terms of use of the swimming pool", "die zeit mit der familie und dem hund", "mit dem zug in die stadt", "und mit einem public viewing", "er kam mit ihr", "mit", "all the files and notes by the software maker", "the modified version of the source code form was distributed", "no rights were granted and none reserved", "international work under the commons", "the domain of the function"]

COMMON = frozenset("a an and any are as at be been by for from has have in into is it its may no not of on or other that the this to under was which will with you your part use made can".split())
WORD = re.compile(r"[^\W_][\w.+-]*")
#: Marks of comments before a line's text.
MARKS = re.compile(r"^\s*(?:[^\w\s]+\s*|(?:rem|dnl)\s+)+")
WINDOW, STRIDE = 48, 24
PAIR_SHARE = 0.5
#: A word tells a family if at most so many families' templates have it.
FEW_FAMILIES = 3
#: Texts whose windows are scored at once.
STEP = 64


def words(text: str) -> list[str]:
    return [w.rstrip(".-+") for w in WORD.findall(text.lower())]


def ngrams(own: list[str], content: frozenset[str]) -> set[str]:
    out = set()
    for n in (1, 2, 3):
        for i in range(len(own) - n + 1):
            some = own[i : i + n]
            if not content.isdisjoint(some):
                out.add(" ".join(some))
    return out


def _varied(text: str, rnd: random.Random, lost: float = 0.04) -> str:
    """A template with words lost, cut or joined to invented ones."""
    own = text.split()
    if lost > 0.04 and len(own) > 3:  # two neighbours swapped
        i = rnd.randrange(len(own) - 1)
        own[i : i + 2] = own[i + 1], own[i]
    if rnd.random() < 0.3:
        own = own[rnd.randint(0, min(2, len(own) // 4)) :]
    if rnd.random() < 0.3 and len(own) > 8:
        own = own[: rnd.randint(max(6, len(own) * 2 // 3), len(own))]
    own = [w for w in own if rnd.random() > lost] or own
    return " ".join([*_made_up(rnd, rnd.choice([0, 0, 2, 6, 15])), *own, *_made_up(rnd, rnd.choice([0, 0, 2, 6, 15]))])


def _made_up(rnd: random.Random, n: int) -> list[str]:
    return [rnd.choice([*COMMON]) if rnd.random() < 0.3 else "".join(rnd.choice("abcdefghilmnorstuvw") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def samples(n: int, seed: int, lost: float = 0.04, others: tuple[str, ...] | None = None) -> list[tuple[str, str]]:
    """Labelled paragraphs: families, ``none`` and ``unknown`` (of ``others``; the last only for calibrating)."""
    rnd = random.Random(seed)
    out = [(_varied(rnd.choice(own), rnd, lost), family) for family, own in TEMPLATES.items() for _ in range(n)]
    out += [(" ".join([*_made_up(rnd, rnd.randint(0, 15)), rnd.choice(MISLEADING) if rnd.random() < 0.7 else "", *_made_up(rnd, rnd.randint(0, 15))]), "none") for _ in range(5 * n)]
    return out + [(_varied(rnd.choice(others or OTHERS), rnd, lost), "unknown") for _ in range(2 * n)]


class Classifier:
    def __init__(self, classes: list[str], content: frozenset[str], vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float, least: float, nothing: float, pairs: dict[str, list[tuple[frozenset, frozenset]]]):
        self.classes, self.content, self.vocabulary, self.weights, self.bias = classes, content, vocabulary, weights, bias
        self.temperature, self.least, self.nothing, self.pairs = temperature, least, nothing, pairs

    def probabilities(self, many: list[list[str]]) -> np.ndarray:
        ids = [[self.vocabulary[g] for g in ngrams(own, self.content) if g in self.vocabulary] for own in many]
        size = np.array([len(x) for x in ids])
        score = np.tile(self.bias, (len(many), 1))
        if size.any():
            starts = (np.cumsum(size) - size)[size > 0]
            score[size > 0] += np.add.reduceat(self.weights[np.concatenate([x for x in ids if x])], starts, axis=0)
        score /= self.temperature
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def judge(self, many: list[list[str]]) -> list[tuple[str, float]]:
        """(family, unknown or none; probability) of windows' words."""
        if not many:
            return []
        p = self.probabilities(many)
        none = self.classes.index("none")
        out = []
        family = p.copy()
        family[:, none] = 0
        best, sum_ = family.argmax(1), family.sum(1)
        for i, own in enumerate(many):
            if p[i, none] >= self.nothing:
                out.append(("none", float(p[i, none])))
                continue
            sure, name = float(family[i, best[i]] / sum_[i]), self.classes[best[i]]
            have = set(zip(own, own[1:], strict=False))
            alike = max((len(t & have) / len(t) for t, telling in self.pairs[name] if t and not telling.isdisjoint(have)), default=0.0)
            out.append((name if sure >= self.least and alike >= PAIR_SHARE else "unknown", sure))
        return out


@functools.lru_cache(maxsize=1)
def trained(n: int = 150, rounds: int = 300) -> Classifier:
    classes = [*TEMPLATES, "none"]
    content = frozenset(w for own in TEMPLATES.values() for t in own for w in words(t)) - COMMON
    table = [(words(t), c) for t, c in samples(n, 5) if c in classes]
    grams = [ngrams(own, content) for own, _ in table]
    count: dict[str, int] = {}
    for own in grams:
        for g in own:
            count[g] = count.get(g, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, c in count.items() if c >= 3))}
    # Sparse rows: features of all rows one after another; sums over rows and over features are sums of runs.
    ids = [sorted(vocabulary[g] for g in own if g in vocabulary) for own in grams]
    row, feature = np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.array([g for x in ids for g in x])
    by_row, by_feature = np.flatnonzero(np.append(True, np.diff(row) != 0)), np.argsort(feature, kind="stable")
    runs = np.flatnonzero(np.append(True, np.diff(feature[by_feature]) != 0))
    y = np.eye(len(classes))[[classes.index(c) for _, c in table]]
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    b[-1] = 1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        s = np.zeros((len(ids), len(classes)))
        s[row[by_row]] = np.add.reduceat(w[feature], by_row, axis=0)
        s += b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = np.zeros_like(w)
        g[feature[by_feature][runs]] = np.add.reduceat((y - p)[row[by_feature]], runs, axis=0)
        g = g / len(ids) - 1e-4 * w
        b += 0.2 * (y - p).mean(0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    spread = {w: sum(any(w in words(t) for t in own) for own in TEMPLATES.values()) for w in content}
    few = {w for w, n in spread.items() if n <= FEW_FAMILIES}
    whole = {c: [frozenset(zip(words(t), words(t)[1:], strict=False)) for t in own] for c, own in TEMPLATES.items()}
    pairs = {c: [(t, frozenset(x for x in t if not few.isdisjoint(x)) or t) for t in own] for c, own in whole.items()}
    model = Classifier(classes, content, vocabulary, w, b, 1.0, 0.0, 0.5, pairs)
    # Temperature: least held-out loss. Least probability: best balanced accuracy between known and unknown licences.
    held = [(words(t), c) for t, c in samples(40, 6, lost=0.08)]
    known = [(own, classes.index(c)) for own, c in held if c in classes]

    def loss(t: float) -> float:
        model.temperature = t
        p = model.probabilities([own for own, _ in known])
        return -float(np.log(np.maximum(1e-12, p[np.arange(len(known)), [c for _, c in known]])).mean())

    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
    p = model.probabilities([own for own, _ in held])[:, :-1]
    top = p.max(1) / p.sum(1)
    strange = np.array([c == "unknown" for _, c in held])
    family = np.array([c in TEMPLATES for _, c in held])
    model.least = max((x / 100 for x in range(20, 96, 5)), key=lambda t: (top[family] >= t).mean() + (top[strange] < t).mean())
    # The same between unknown licences and no licence; a false alarm weighs ten times a miss.
    held = [(words(t), c) for t, c in samples(120, 8)]
    quiet = model.probabilities([own for own, _ in held])[:, -1]
    strange, none = (np.array([c == x for _, c in held]) for x in ("unknown", "none"))
    model.nothing = max((x / 100 for x in range(50, 100, 2)), key=lambda t: 10 * (quiet[none] >= t).mean() + (quiet[strange] < t).mean())
    return model


def scan(text: str, model: Classifier) -> tuple[int, list[tuple[int, str, float]]]:
    """(number of lines, hits: place of the line, family or unknown, probability)."""
    return scanned([text], model)[0]


def scanned(texts: list[str], model: Classifier) -> list[tuple[int, list[tuple[int, str, float]]]]:
    """``scan`` of many texts, their windows scored together."""
    counts, owners, windows = [], [], []
    for i, text in enumerate(texts):
        n, run = 0, []
        for line in [*text.split("\n"), ""]:
            own = words(MARKS.sub("", line.lower()))
            if own:
                run.append((n, own, line.rstrip().endswith("-")))
            elif run:
                for some in _windows_of(run, model.content):
                    owners.append((i, run[0][0]))
                    windows.append(some)
                run = []
            n += bool(line.strip())
        counts.append(n)
    judged = model.judge([[w for _, w in some] for some in windows])
    hits: list[list[tuple[int, str, float]]] = [[] for _ in texts]
    at = 0
    while at < len(windows):
        end = at
        while end < len(windows) and owners[end] == owners[at]:
            end += 1
        hits[owners[at][0]] += _merged([(some[0][0], some[-1][0], *x) for some, x in zip(windows[at:end], judged[at:end], strict=True)])
        at = end
    return list(zip(counts, hits, strict=True))


def _windows(own: list, content: frozenset[str]) -> Iterator[list]:
    for at in range(0, max(1, len(own) - STRIDE), STRIDE):
        some = own[at : at + WINDOW]
        if not content.isdisjoint(w for _, w in some):
            yield some


def _windows_of(run: list[tuple[int, list[str], bool]], content: frozenset[str]) -> Iterator[list]:
    """Windows, as (line, word) lists, of each line of a paragraph, and those across line ends."""
    for n, own, _ in run:
        yield from _windows([(n, w) for w in own], content)
    if len(run) > 1:
        joined, broken = [], False
        for n, own, breaks in run:
            if broken:  # a word parted at its hyphen
                joined[-1] = (joined[-1][0], f"{joined[-1][1]}-{own[0]}")
            joined += [(n, w) for w in own[broken:]]
            broken = breaks
        yield from (some for some in _windows(joined, content) if some[0][0] != some[-1][0])


def _merged(windows: list[tuple[int, int, str, float]]) -> list[tuple[int, str, float]]:
    """Hits of a paragraph's windows (first and last line, family, probability): of lines, and of windows across line ends that say more than the lines within."""
    hits: dict[tuple[int, str], float] = {}
    for first, last, family, p in windows:
        if family == "none":
            continue
        if first == last:
            hits.setdefault((first, family), p)
            continue
        within = [h for h in hits if first <= h[0] <= last]
        if any(f == family for _, f in within) or (family == "unknown" and within):
            continue
        for h in within:
            if h[1] == "unknown":  # a part of what is known now
                del hits[h]
        hits[first, family] = p
    return [(n, f, p) for (n, f), p in sorted(hits.items(), key=lambda h: h[0])]


def found(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id -> paragraphs, those with a known and an unknown licence, the families, and all hits as place:family."""
    kind = docs.schema[doc_id].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [x for at in range(0, len(texts), STEP) for x in scanned(texts[at : at + STEP], model.value)]
            known = [sorted({f for _, f, _ in hits} - {"unknown"}) for _, hits in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([len({i for i, f, _ in hits if f != "unknown"}) for _, hits in rows], pa.int64()),
                    pa.array([len({i for i, f, _ in hits if f == "unknown"}) for _, hits in rows], pa.int64()),
                    pa.array([",".join(x) for x in known], pa.string()),
                    pa.array([",".join(f"{i}:{f}" for i, f, _ in hits) for _, hits in rows], pa.string()),
                ],
                names=["doc_id", "n_paragraphs", "n_licensed", "n_unknown", "families", "hits"],
            )

    return docs.select(doc_id, text).mapInArrow(task, f"doc_id {kind}, n_paragraphs long, n_licensed long, n_unknown long, families string, hits string")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
