"""Licence scans with a generalised suffix automaton.

The templates' words make one suffix automaton (states are sets of places in the templates with the
same right contexts). A file streams through it once; at each word the automaton gives the longest
run of words ending there that stands in some template (the matching statistics). Runs that cannot
grow further and are long enough become matches at their places in each template; matches in the
same order in file and template are chained into spans, and a template is found where the chain
covers enough of it. Short base phrases are found by the same walk, as templates that must be
matched in full.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from geodemand.llm.common import alnum_words, by_slices, columns_only

# Base phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Openings of well-known notices, by label (fixed values).
TEMPLATES = {
    "notice-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "notice-bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "notice-apache-2.0": "licensed under the apache license version 2 0",
    "notice-gpl-3": "this work is licensed under the gnu general public license version 3",
    "notice-cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "notice-mit-release": "released under the mit license",
    "notice-no-warranty": "the software is provided as is without warranty of any kind express or implied",
}
MIN_RUN = 3  # words of the shortest match that may join a chain
COVER = 0.75  # share of a template that a chain must cover
MAX_GAP = 8  # words that may lie between two matches of a chain


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences: for each state its arcs, link, length and template places."""

    arcs: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.arcs.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.arcs) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """Copy of q for the shorter runs that come in from p and its suffixes."""
        clone = self._state(self.length[p] + 1, dict(self.arcs[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.arcs[p].get(word) == q:
            self.arcs[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, number: int, words: list[int]) -> None:
        last = 0
        for i, w in enumerate(words):
            q = self.arcs[last].get(w)
            if q is not None:  # the run is known from an earlier template
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and w not in self.arcs[p]:
                    self.arcs[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.arcs[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
                last = new
            self.ends[last].add((number, i))

    def finish(self) -> None:
        """Hand each state's places on to its suffixes, longest first."""
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_run: int = MIN_RUN, cover: float = COVER, max_gap: int = MAX_GAP):
        entries = [(label, [w.encode() for w in text.split()]) for label, text in templates.items()]
        entries += [(label, [w.encode() for w in text.split()]) for text, label in phrases.items()]
        self.labels = [label for label, _ in entries]
        self.sizes = [len(words) for _, words in entries]
        self.n_templates, self.min_run, self.cover, self.max_gap = len(templates), min_run, cover, max_gap
        self.ids: dict[bytes, int] = {}
        self.automaton = Automaton()
        for number, (_, words) in enumerate(entries):
            self.automaton.add(number, [self.ids.setdefault(w, len(self.ids)) for w in words])
        self.automaton.finish()

    def statistics(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Maximal runs (end, length, state) and base phrases (start, number); words of no template are passed over fast."""
        a, runs, phrases = self.automaton, [], []
        arcs, link, longest = a.arcs, a.link, a.length
        state = length = 0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                if length >= self.min_run:
                    runs.append((i - 1, length, state))
                state = length = 0
                continue
            before, kept = state, length
            while state and w not in arcs[state]:
                state = link[state]
                length = longest[state]
            if kept >= self.min_run and state != before:
                runs.append((i - 1, kept, before))
            step = arcs[state].get(w)
            state, length = (step, length + 1) if step is not None else (0, 0)
            s = state
            while s > 0 and longest[s] > 1:  # all suffixes of the run that are a whole phrase
                for number, end in a.ends[s] if s == state or longest[s] <= length else ():
                    if number >= self.n_templates and end == self.sizes[number] - 1 and self.sizes[number] <= min(length, longest[s]) and self.sizes[number] > longest[link[s]]:
                        phrases.append((i - end, number))
                s = link[s]
        if length >= self.min_run:
            runs.append((len(words) - 1, length, state))
        return runs, phrases

    def spans(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains of runs in the order of file and template: (template, first word, last word, share covered)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in runs:
            for number, at in self.automaton.ends[state]:
                if number < self.n_templates:
                    by_template.setdefault(number, []).append((end, at, length))
        found = []
        for number, matches in by_template.items():
            chain: tuple[int, int, int, int] | None = None  # first word, last word, last place, words covered
            for end, at, length in sorted(matches):
                if chain and end - length + 1 - chain[1] <= self.max_gap and at > chain[2]:
                    fresh = min(length, at - chain[2], end - chain[1])
                    chain = (chain[0], end, at, chain[3] + fresh)
                else:
                    if chain:
                        found.append((number, chain[0], chain[1], chain[3] / self.sizes[number]))
                    chain = (end - length + 1, end, at, length)
            found.append((number, chain[0], chain[1], chain[3] / self.sizes[number]))
        return found

    def scan(self, text: str | None) -> dict:
        words = alnum_words(text)
        runs, phrases = self.statistics(words)
        chains = self.spans(runs)
        full = [c for c in chains if c[3] >= self.cover]
        base = {self.labels[n] for _, n in phrases}
        starts = [s for s, _ in phrases]
        best = max([c[3] for c in chains], default=0.0)
        return {
            "n_words": len(words), "n_base": len(phrases), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {self.labels[c[0]] for c in full})),
            "score": 1.0 if base else min(1.0, best),
            "spans": [{"label": self.labels[n], "first": a, "last": b, "cover": share} for n, a, b, share in sorted(full, key=lambda c: (c[1], c[0]))],
        }


FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))),
]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of `docs`: key, word count, base phrases, labels, score and the covered template spans.

    Null and empty texts have no words and no labels. Repeated rows give repeated results; extra
    columns are not read. Templates and phrases are parameters, so the automaton's size is theirs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases))

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [sent.value.scan(t) for t in b.column(text).to_pylist()]
        return pa.record_batch([b.column(key), *[pa.array([r[n] for r in rows], k) for n, k in FIELDS]], [key, *[n for n, _ in FIELDS]])

    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first: long, last: long, cover: double>>"
    )
    return columns_only(docs, key, text).mapInArrow(by_slices(work, text), schema)
