"""Licence scan: matching statistics from a generalised suffix automaton of licence tokens.

The automaton recognises every run of words of every template.  A text streams
through it word by word; the longest run that ends at each word is its matching statistic.
Maximal long runs are chained, per template and in the template's order, into covered spans.

Edge cases: a null or empty text has no words and no labels; the score is the largest
covered share of a template, 0 without a match; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases of the base rule and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Openings and notices of public licences.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["licensed under cc by 4 0", "creative commons attribution 4 0 international license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}

#: Words of a run that counts as long, of a gap that a chain bridges, and the share of a
#: template that its chain has to cover.
LONG = 3
GAP = 8
SHARE = 0.6

# What separates words, and A-Z in lower case, for bytes.
BREAKS = bytes(
    32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BREAKS).split()


class SuffixAutomaton:
    """All runs of words of several templates; a state knows where in the templates its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((t, place + 1))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.ends[self.link[state]] |= self.ends[state] if self.link[state] else set()

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(following)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, state: int, target: int, word: int) -> int:
        """The state for the shorter runs of ``target`` that ``state`` leads to."""
        copy = self._state(self.size[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None:
            return there if self.size[there] == self.size[last] + 1 else self._split(last, there, word)
        made = self._state(self.size[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = made
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[made] = target if self.size[target] == self.size[state] + 1 else self._split(state, target, word)
        return made

    def statistics(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(place behind the word, length, state)`` of the longest run ending at each word."""
        state = length = 0
        for place, word in enumerate(words.tolist()):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield place + 1, length, state


class Scanner:
    """Templates and phrases of one scan."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.labels = [label for label, texts in templates.items() for _ in texts]
        texts = [words_of(t) for group in templates.values() for t in group]
        self.ids: dict[bytes, int] = {}
        for word in [w for t in texts for w in t] + [w for p in phrases for w in words_of(p)]:
            self.ids.setdefault(word, len(self.ids) + 1)
        coded = [[self.ids[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in coded]
        self.automaton = SuffixAutomaton(coded)
        self.phrases = [([self.ids[w] for w in words_of(p)], label) for p, label in phrases.items()]

    def long_runs(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(start, end, state)`` of the maximal long runs of a text."""
        known = np.flatnonzero(ids)
        if not len(known):
            return
        for part in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
            if len(part) < LONG:
                continue
            held = None
            for end, length, state in self.automaton.statistics(ids[part[0] : part[-1] + 1]):
                if held and length <= held[1]:
                    if held[1] >= LONG:
                        yield int(part[0]) + held[0] - held[1], int(part[0]) + held[0], held[2]
                held = end, length, state
            if held and held[1] >= LONG:
                yield int(part[0]) + held[0] - held[1], int(part[0]) + held[0], held[2]

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Chains ``(template, start, end, covered share)`` that cover enough of their template."""
        open_: dict[int, list] = {}
        done = []

        def close(t: int) -> None:
            start, end, _, covered = open_.pop(t)
            if covered >= SHARE * self.sizes[t]:
                done.append((t, start, end, min(1.0, covered / self.sizes[t])))

        for start, end, state in self.long_runs(ids):
            places: dict[int, list[int]] = {}
            for t, place in self.automaton.ends[state]:
                places.setdefault(t, []).append(place)
            for t, ends in places.items():
                if t in open_ and start - open_[t][1] > GAP:
                    close(t)
                # The first place in the template behind what the chain has covered.
                after = open_[t][2] if t in open_ else 0
                later = [p for p in ends if p > after]
                if not later:
                    close(t)
                    later, after = ends, 0
                place = min(later)
                if t not in open_:
                    open_[t] = [start, end, place, end - start]
                else:
                    new = min(end - max(start, open_[t][1]), place - after)
                    open_[t] = [open_[t][0], end, place, open_[t][3] + max(0, new)]
        for t in list(open_):
            close(t)
        return sorted(done, key=lambda x: (x[1], x[2], x[0]))

    def places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """Where the phrases stand, with their labels."""
        found = []
        for phrase, label in self.phrases:
            count = len(ids) - len(phrase) + 1
            if count > 0:
                same = np.ones(count, bool)
                for k, word in enumerate(phrase):
                    same &= ids[k : k + count] == word
                found += [(int(i), label) for i in np.flatnonzero(same)]
        return found


RESULT = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, "
    "labels array<string>, score double, spans array<struct<label:string,start:bigint,end:bigint,share:double>>"
)


def scan_licenses(
    docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, text: str = "text"
) -> DataFrame:
    """Adds the words, the base places and labels, all labels, the score and the template spans; drops the text.

    Columns of ``docs`` with the name of a result are replaced by it.
    """
    made = T.StructType.fromDDL(RESULT)
    rest = [c for c in docs.columns if c != text and c not in made.names]
    light = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).cast("string").alias(text))
    schema = T.StructType(light.schema.fields[:-1] + made.fields)
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        code = scanner.ids.get
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                words = words_of(value)
                ids = np.array([code(w, 0) for w in words], np.int32)
                places, spans = scanner.places(ids), scanner.spans(ids)
                base = sorted({label for _, label in places})
                starts = [p for p, _ in places]
                rows.append(
                    (
                        len(words),
                        len(places),
                        min(starts, default=None),
                        max(starts, default=None),
                        base,
                        sorted({*base, *(scanner.labels[t] for t, *_ in spans)}),
                        max((s for *_, s in spans), default=0.0),
                        [{"label": scanner.labels[t], "start": a, "end": b, "share": s} for t, a, b, s in spans],
                    )
                )
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names
            )

    return light.mapInArrow(run, schema)
