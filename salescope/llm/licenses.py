"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

A block is one line of a text, as the set of its words; or, for notices wrapped over lines, a window of
consecutive words of two or more lines that has at most 1 / ``threshold`` times as many words as the
template, blank lines and comment signs between them or not. A block meets a template if it contains at
least ``threshold`` (0.9) of the template's words. Windows are looked for between lines that meet the
template by themselves; of windows that overlap, the fullest counts, then the first, from its first word
of the template to its last, and its line is that of its first word.

The join is exact: words are ordered by how many
blocks of the whole corpus have them, rarest first; a template is listed under its prefix, the first
|T| - a + 1 words for a required overlap of a words, of which every block that meets it must have
one. A listed pair goes on only if the block has at least ``a`` words of the templates (length
filter) and the words still to come on both sides can make up the overlap (positional filter); the
rest is counted. Windows are formed only for the templates of which the text has the overlap. The templates are a parameter and go to every task; documents are not shuffled.

Apart from the join, ``phrases`` are found at every place where their words stand consecutively,
across lines.

Defined results: null text is empty; templates or phrases without words match nothing; without a
match first and last place are null; several templates may carry one label. Extra columns pass
through; columns named like the output are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import chain
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import parts, with_columns

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
THRESHOLD = 0.9

#: Phrases and labels of the base scan.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices as licensors word them; a parameter of the join.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: letters, digits and everything beyond ASCII."""
    return text.translate(_CLEAN).split()


class Templates:
    """The prefix index over the templates; ``counts`` are the numbers of blocks that have a word."""

    def __init__(self, templates, threshold: float, counts: dict[bytes, int]):
        sets = [(label, set(words(t.encode()))) for label, t in templates]
        self.sets = [(label, s) for label, s in sets if s]
        self.rank = {w: i for i, w in enumerate(sorted(set().union(*(s for _, s in self.sets)), key=lambda w: (counts.get(w, 0), w)))}
        self.words = frozenset(self.rank)
        self.need = [ceil(threshold * len(s) - 1e-9) for _, s in self.sets]
        self.least = min(self.need, default=1)
        lengths = [len(words(t.encode())) for _, t in templates]
        self.widths = [int(n / threshold + 1 - 1e-9) for n in lengths if n]  # longest windows, in words
        self.ordered = [sorted(self.rank[w] for w in s) for _, s in self.sets]
        self.listed: dict[int, list[tuple[int, int]]] = {}
        for t, order in enumerate(self.ordered):
            for at, rank in enumerate(order[:len(order) - self.need[t] + 1]):
                self.listed.setdefault(rank, []).append((t, at))

    def meets(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block meets."""
        common = self.words.intersection(block)
        if len(common) < self.least:
            return []
        order = sorted(map(self.rank.__getitem__, common))
        own, seen, out = set(order), set(), []
        for j, rank in enumerate(order):
            for t, at in self.listed.get(rank, ()):
                if t in seen:
                    continue
                seen.add(t)
                # Nothing before this word is shared: it is the first one met in both orders.
                if 1 + min(len(order) - j - 1, len(self.ordered[t]) - at - 1) < self.need[t]:
                    continue
                shared = len(own.intersection(self.ordered[t]))
                if shared >= self.need[t]:
                    out.append((t, shared / len(self.ordered[t])))
        return out

    def wrapped(self, lines: list[list[bytes]], met: list[list[int]]) -> list[tuple[int, int, float]]:
        """(line, template, containment) of the windows over lines; ``met``: the templates that each line meets."""
        common = self.words.intersection(chain.from_iterable(lines))
        if len(lines) < 2 or len(common) < self.least:
            return []
        out = []
        for t, (_, wanted) in enumerate(self.sets):
            if len(common & wanted) < self.need[t]:
                continue
            hits, at, part = [], 0, 0  # (place, line, word, part): parts are the runs between lines that meet the template
            for i, line in enumerate(lines):
                if t in met[i]:
                    part += 1
                elif not wanted.isdisjoint(line):
                    hits += [(at + j, i, w, part) for j, w in enumerate(line) if w in wanted]
                at += len(line)
            found, seen, stop = [], Counter(), 0
            for start, (place, line, word, part) in enumerate(hits):
                while stop < len(hits) and hits[stop][0] < place + self.widths[t] and hits[stop][3] == part:
                    seen[hits[stop][2]] += 1
                    stop += 1
                if len(seen) >= self.need[t] and hits[stop - 1][1] > line:
                    found.append((-len(seen), place, hits[stop - 1][0], line))
                seen[word] -= 1
                if not seen[word]:
                    del seen[word]
            taken: list[tuple[int, int]] = []
            for n, first, last, line in sorted(found):
                k = bisect_left(taken, (first, last))
                if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or taken[k][0] > last):
                    taken.insert(k, (first, last))
                    out.append((line, t, -n / len(wanted)))
        return out


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Starts, counted in words, of a phrase in blank-framed words."""
    out, at = [], joined.find(phrase)
    while at >= 0:
        out.append(joined.count(b" ", 0, at))
        at = joined.find(phrase, at + 1)
    return out


def block_counts(df: DataFrame, templates=TEMPLATES, *, text: str = "text") -> dict[bytes, int]:
    """Number of blocks that have each word of the templates, over all rows."""
    wanted = frozenset(w for _, t in templates for w in words(t.encode()))

    def run(batches):
        n: Counter[bytes] = Counter()
        for _, own in parts(batches, text):
            for t in own:
                for line in t.split(b"\n"):
                    n.update(wanted.intersection(words(line)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

    rows = df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most the templates' words
    return {bytes(r.word): r.n for r in rows}


def scan(df: DataFrame, *, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """All rows with ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the phrases; and
    ``blocks``: array of (line, label, containment) of the template join."""
    counts = block_counts(df, templates, text=text)

    def start():
        index = Templates(templates, threshold, counts)
        framed = [(b" " + b" ".join(words(p.encode())) + b" ", label) for p, label in phrases if words(p.encode())]

        def row(t: bytes):
            lines = [words(line) for line in t.split(b"\n")]
            n = sum(map(len, lines))
            met = [index.meets(line) for line in lines]
            found = [(i, k, c) for i, ks in enumerate(met) for k, c in ks] + index.wrapped(lines, [[k for k, _ in ks] for ks in met])
            blocks = [{"line": i, "label": index.sets[k][0], "containment": c} for i, k, c in sorted(found)]
            joined = b" " + b" ".join(w for line in lines for w in line) + b" "
            found = [(at, label) for p, label in framed for at in _places(joined, p)]
            at = [a for a, _ in found]
            return n, len(at), min(at, default=None), max(at, default=None), sorted({label for _, label in found}), blocks

        return lambda batch: list(zip(*map(row, batch))) or [[]] * 6

    return with_columns(df, text, [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "array<string>"),
                                   ("blocks", "array<struct<line:int,label:string,containment:double>>")], start)
