"""Licence scan: matching statistics against a generalised suffix automaton.

All licence templates and base phrases go into one suffix automaton over word
numbers. A text is streamed through it once: after each word the automaton
knows the longest run of words ending there that occurs in any template.
Maximal runs of at least ``MIN_RUN`` words are chained, in order and with small
gaps, into spans of one template; a template whose best span covers at least
``MIN_COVER`` of it gives its label. Base phrases are found on the way: a
phrase stands at a place when it is a suffix of the current run.

The automaton is built from the constants below (some hundred words) and goes
to the tasks in the function's closure; texts are scanned whole, row by row, so
no row moves and memory is bounded by the longest text.

Null and empty texts have no words: counts 0, no labels, score 0, first and
last word null. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import NOT_ALNUM, chunks, words

# Base phrases and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Usual licence notices (label, text).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "either version 3 of the License, or at your option any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    # Names that no other licence's text holds, and passages of the licences themselves that their relatives do not share.
    ("agpl", "GNU Affero General Public License"),
    ("agpl", "It requires the operator of a network server to provide the source code of the modified version running there to the users of that server"),
    ("apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("artistic-2.0", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc", "NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation"),
    ("cc-by-sa-4.0", "The Adapter's License You apply must be a Creative Commons license with the same License Elements, this version or later, or a BY-SA Compatible License"),
    ("cc0", "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights"),
    ("epl", "The accompanying program is provided under the terms of this Eclipse Public License (\"Agreement\"). Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    ("gpl-2.0", "the output from the Program is covered only if its contents constitute a work based on the Program (independent of having been made by running the Program)"),
    ("gpl-3.0", "the GPL requires that modified versions be marked as changed, so that their problems will not be attributed erroneously to authors of previous versions"),
    ("isc", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "When a program is linked with a library, whether statically or using a shared library, the combination of the two is legally speaking a combined work, a derivative of the original library"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl-2.0", "Covered Software means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof"),
    ("public-domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
)
MIN_RUN = 3
MAX_GAP = 6
MIN_COVER = 0.8


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: (sequence, end position) pairs of each state's strings.
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """Copy of state q holding only its strings of up to length[p] + 1 words."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            q = self.step[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def add(self, sequences: list[list[int]]) -> None:
        for s in sequences:
            last = 0
            for c in s:
                last = self._extend(last, c)
        # Where each state's strings end: walk every sequence, then hand positions up the links.
        for k, s in enumerate(sequences):
            state = 0
            for i, c in enumerate(s):
                state = self.step[state][c]
                self.ends[state].add((k, i + 1))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]


class Scanner:
    """Automaton of templates and base phrases, with the tables a scan needs."""

    def __init__(self, templates=TEMPLATES, base=BASE, min_run=MIN_RUN, max_gap=MAX_GAP, min_cover=MIN_COVER):
        texts = [t for _, t in templates] + [p for p, _ in base]
        split = words(pa.array(texts, pa.large_string()), NOT_ALNUM, lower=True)
        h = split.hashes()
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        sequences = [ids[a:b].tolist() for a, b in zip(split.first[:-1], split.first[1:])]
        self.min_run, self.max_gap, self.min_cover = min_run, max_gap, min_cover
        self.labels = [label for label, _ in templates]
        self.sizes = [len(s) for s in sequences[: len(templates)]]
        self.automaton = a = Automaton()
        a.add(sequences)
        self.pairs = np.zeros((len(self.vocabulary), len(self.vocabulary)), dtype=bool)
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True
        # Base phrases that end a state's runs, as (phrase, its length), by climbing the links.
        home: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(sequences[len(templates) :]):
            v = 0
            for c in s:
                v = a.step[v][c]
            home.setdefault(v, []).append((k, len(s)))
        self.base_at: list[list[tuple[int, int]]] = []
        for v in range(len(a.length)):
            found, u = [], v
            while u > 0:
                found += home.get(u, [])
                u = a.link[u]
            self.base_at.append(found)
        self.base_labels = [label for _, label in base]

    def matches(self, ids: list[int], offset: int):
        """Matching statistics of a run of known words: maximal runs and base places."""
        a = self.automaton
        state, n = 0, 0
        runs, places = [], []
        for i, c in enumerate(ids):
            before, was = state, n
            while state and c not in a.step[state]:
                state = a.link[state]
                n = a.length[state]
            if c in a.step[state]:
                state, n = a.step[state][c], n + 1
            if n != was + 1 and was >= self.min_run:
                runs.append((offset + i, was, before))
            places += [(offset + i + 1 - size, k) for k, size in self.base_at[state] if n >= size]
        if n >= self.min_run:
            runs.append((offset + len(ids), n, state))
        return runs, places

    def spans(self, runs: list[tuple[int, int, int]]):
        """Best chain of runs for each template: (label, first word, end word, covered share)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in runs:
            for k, at in self.automaton.ends[state]:
                if k < len(self.sizes):
                    by_template.setdefault(k, []).append((end, at, n))
        out = []
        for k, found in by_template.items():
            found.sort()
            # covered words, first word of the best chain that ends with each run
            best: list[tuple[int, int]] = []
            low = 0
            for i, (end, at, n) in enumerate(found):
                cover, first = n, end - n
                while found[low][0] < end - self.sizes[k] - self.max_gap:
                    low += 1
                for j in range(low, i):
                    e, t, _ = found[j]
                    gain = min(n, end - e, at - t)
                    if end - n - self.max_gap <= e < end and t < at and best[j][0] + gain > cover:
                        cover, first = best[j][0] + gain, best[j][1]
                best.append((cover, first))
            for (end, _, _), (cover, first) in zip(found, best):
                share = min(1.0, cover / self.sizes[k])
                if share >= self.min_cover:
                    out.append((self.labels[k], first, end, share))
        return out

    def scan(self, texts: pa.Array):
        """Rows (n_words, n_base, first, last, base labels, labels, score, spans) of a chunk."""
        w = words(texts, NOT_ALNUM, lower=True)
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        # Only neighbours that stand so in a template can be part of a run of two words or more.
        pair = np.zeros(len(h) + 1, dtype=bool)
        if len(h) > 1:
            pair[1:-1] = known[:-1] & known[1:] & self.pairs[at[:-1], at[1:]]
        inner = w.first[(w.first > 0) & (w.first < len(h))]
        pair[inner] = False
        edge = np.diff(pair.astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        owner = np.searchsorted(w.first, lo, side="right") - 1
        found: dict[int, tuple[list, list]] = {}
        for d, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist()):
            runs, places = self.matches(at[a:b].tolist(), a - int(w.first[d]))
            mine = found.setdefault(d, ([], []))
            mine[0].extend(runs)
            mine[1].extend(places)
        for d, n in enumerate(w.counts.tolist()):
            runs, places = found.get(d, ((), ()))
            spans = self.spans(runs) if runs else []
            base = sorted({self.base_labels[k] for _, k in places})
            labels = sorted({*base, *(s[0] for s in spans)})
            starts = [p for p, _ in places]
            sure = 1.0 if places else max((s[3] for s in spans), default=0.0)
            yield n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), sure, spans


SCHEMA = (
    "_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, spans array<struct<label:string,first:bigint,end:bigint,covered:double>>"
)
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, counts, places, labels, score and spans for every row of docs (doc_id, text)."""
    scanner = scanner or Scanner()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]

    def run(batches):
        for b in batches:
            for row, part in chunks(b.column("_text")):
                rows = list(scanner.scan(part))
                columns = [pa.array([_spans(r[i]) if i == 7 else r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(row, len(part)), *columns],
                    names=["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("_text"))
    return source.mapInArrow(run, SCHEMA).withColumnRenamed("_id", "doc_id")


def _spans(spans) -> list[dict]:
    return [{"label": a, "first": b, "end": c, "covered": d} for a, b, c, d in spans]
