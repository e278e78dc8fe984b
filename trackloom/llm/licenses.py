"""Operator 12: license scans by template markup.

A license is given as its text with markup: optional regions between
``<<beginOptional>>`` and ``<<endOptional>>``, and replaceable regions
``<<var;match="...">>``, whose match is either ``.{a,b}``, any words of b bytes
at most, or alternatives ``one|another``. A template is compiled into an
automaton over words; it accepts a place of a text whose mandatory wording stands
there exactly, word by word, whatever stands in the other regions. All automata
run in one pass over a text's words, as a set of states that keep, for a
replaceable region, where they entered it last.

The longest mandatory wording of a template tells first which texts it can match;
only those are run through. Fixed phrases are found in all texts.

Results for odd rows: a null or empty text has no words, no places, empty labels
and score 0; texts are scanned whole; equal labels of several places count once;
repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_rows, text_slices, utf8_of

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Bytes that belong to words, A-Z lower-cased; all others become spaces.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Words that count as one in templates.
EQUAL = {b"licence": b"license", b"licenced": b"licensed", b"licences": b"licenses"}
#: Score of a text that holds a phrase, but no accepted template.
PHRASE_SCORE = 0.5

#: Public license texts and notices, with markup.
TEMPLATES = {
    "apache-2.0-notice": 'Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>Version<<endOptional>> <<var;match="2 0|2">>',
    "cc-by-notice": 'CC BY <<beginOptional>><<var;match="NC|ND|SA|NC SA|NC ND">><<endOptional>> <<var;match="1 0|2 0|2 5|3 0|4 0">>',
    "cc-by-text-notice": """This work is licensed under <<var;match="a|the">> Creative Commons Attribution <<beginOptional>><<var;match="NonCommercial|Non Commercial">><<endOptional>>
        <<beginOptional>><<var;match="ShareAlike|Share Alike|NoDerivatives|No Derivatives|NoDerivs">><<endOptional>> <<var;match="1 0|2 0|2 5|3 0|4 0">> <<var;match="International|Unported|Generic">> License""",
    "gpl-notice": 'licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<var;match="version|v">> <<var;match="1|2|3">>',
    "gpl-header": """This <<var;match="program|library|file|software">> is free software you can redistribute it and or modify it under the terms of the GNU <<beginOptional>><<var;match="Lesser|Library|Affero">><<endOptional>>
        General Public License as published by the Free Software Foundation either version <<var;match="1|2|2 1|3">> of the License or at your option any later version""",
    "mit-notice": '<<var;match="Released|Licensed|Distributed|Available">> under the <<beginOptional>>terms of the<<endOptional>> MIT License',
    "spdx-identifier": 'SPDX License Identifier <<var;match="MIT|ISC|Zlib|Apache 2 0|GPL 2 0|GPL 3 0|LGPL 2 1|LGPL 3 0|AGPL 3 0|BSD 2 Clause|BSD 3 Clause|CC BY 4 0|CC0 1 0|MPL 2 0">>',
    "isc-text": """Permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies
        THE SOFTWARE IS PROVIDED AS IS AND <<var;match=".{1,80}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS""",
    "mit-text": """Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software
        and to permit persons to whom the Software is furnished to do so subject to the following conditions
        The above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the Software
        THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT
        IN NO EVENT SHALL <<var;match=".{1,200}">> BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY""",
    "zlib-text": """This software is provided as is without any express or implied warranty In no event will <<var;match=".{1,200}">> be held liable for any damages arising from the use of this software
        Permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions""",
    "bsd-conditions": """Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var;match=".{0,40}">>
        Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<var;match=".{0,40}">>
        Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution""",
}

MARK = re.compile(r'<<(beginOptional|endOptional)>>|<<var;match="([^"]*)">>')
ANY = re.compile(r"\.\{(\d+),(\d+)\}\Z")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """States 0 to n; ``moves[state]`` leads by a word, ``loose[state]`` is a state of a replaceable
    region that any word keeps, for so many bytes; ``free[state]`` follows without a word.
    ``passed[state]`` is the share of mandatory words before it; ``end`` accepts."""

    label: str
    moves: list[dict[bytes, set[int]]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    loose: dict[int, int] = field(default_factory=dict)
    passed: list[float] = field(default_factory=list)
    end: int = 0
    wording: bytes = b""

    def state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        self.passed.append(0)
        return len(self.moves) - 1

    def chain(self, at: int, words: list[bytes], to: int | None = None) -> int:
        for k, word in enumerate(words):
            after = to if to is not None and k == len(words) - 1 else self.state()
            self.moves[at].setdefault(EQUAL.get(word, word), set()).add(after)
            at = after
        return at

    def closed(self, state: int) -> tuple[int, ...]:
        """The state and all that follow it without a word."""
        found, todo = {state}, [state]
        while todo:
            for after in self.free[todo.pop()] - found:
                found.add(after)
                todo.append(after)
        return tuple(sorted(found))


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template. A template that begins or ends with a region that may be left out
    is as good without it; one without mandatory wording is refused."""
    out, opened, at, runs, count = Automaton(label), [], 0, [], {}
    here = out.state()
    for mark in [*MARK.finditer(template), None]:
        words = words_of(template[at : mark.start() if mark else len(template)].encode())
        if not opened and words:
            runs.append(words)
        for word in words:
            after = out.chain(here, [word])
            count[after] = count.get(here, 0) + (not opened)
            here = after
        if mark is None:
            break
        at, before = mark.end(), count.get(here, 0)
        if mark[1] == "beginOptional":
            opened.append(here)
        elif mark[1]:
            end = out.state()
            out.free[here].add(end)
            out.free[opened.pop()].add(end)
            here = end
        elif found := ANY.match(mark[2]):
            region, end = out.state(), out.state()
            out.loose[region] = int(found[2])
            out.free[here].add(region)
            out.free[region].add(end)
            here = end
            count[region] = before
        else:
            end = out.state()
            for choice in mark[2].split("|"):
                out.chain(here, words_of(choice.encode()), end)
            here = end
        count[here] = before
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    if not runs:
        raise ValueError(f"{label}: no mandatory wording")
    total = sum(map(len, runs))
    # Only the end is worth 1: behind the last mandatory word an alternative may still be missing.
    out.passed, out.end = [count.get(s, 0) / (total + 1) for s in range(len(out.moves))], here
    # A run of equal-counting words cannot be looked for literally: it is cut there.
    plain, cut = [], set(EQUAL) | set(EQUAL.values())
    for run in runs:
        part: list[bytes] = []
        for word in [*run, None]:
            if word is None or word in cut:
                plain.append(part)
                part = []
            else:
                part.append(word)
    out.wording = b" " + b" ".join(max(plain, key=lambda p: sum(map(len, p)))) + b" " if any(plain) else b""
    return out


class Scanner:
    """All automata over one text's words in one pass."""

    def __init__(self, templates: dict[str, str]):
        self.automata = [compiled(label, text) for label, text in templates.items()]
        self.closed = [[a.closed(s) for s in range(len(a.moves))] for a in self.automata]

    def scan(self, words: list[bytes], joined: bytes) -> tuple[dict[str, list[tuple[int, int]]], float]:
        """Accepted places (words from, to) of each label, and the greatest share of mandatory words that stood in place."""
        chosen = [k for k, a in enumerate(self.automata) if a.wording in joined]
        found: dict[str, list[tuple[int, int]]] = {}
        best = 0.0
        if not chosen:
            return found, best
        # A state holds where the match began and, in a replaceable region, how many bytes the region may still take.
        active: dict[tuple[int, int], tuple[int, int]] = {}
        for n, word in enumerate(words):
            word = EQUAL.get(word, word)
            for k in chosen:
                for s in self.closed[k][0]:
                    if word in self.automata[k].moves[s]:
                        active.setdefault((k, s), (n, 0))
            if not active:
                continue
            after: dict[tuple[int, int], tuple[int, int]] = {}

            def enter(k: int, s: int, start: int, after=after) -> None:
                loose = self.automata[k].loose
                for t in self.closed[k][s]:
                    after[k, t] = max(after.get((k, t), (-1, -1)), (start, loose.get(t, 0)))

            for (k, s), (start, rest) in active.items():
                automaton = self.automata[k]
                for t in automaton.moves[s].get(word, ()):
                    enter(k, t, start)
                    best = max(best, automaton.passed[t])
                if s in automaton.loose and rest > len(word):
                    left = (start, rest - len(word) - 1)
                    for t in self.closed[k][s]:
                        after[k, t] = max(after.get((k, t), (-1, -1)), left if t == s else (start, automaton.loose.get(t, 0)))
            for k in chosen:
                end = after.get((k, self.automata[k].end))
                if end:
                    found.setdefault(self.automata[k].label, []).append((end[0], n + 1))
                    best = 1.0
            active = after
        return found, best


def phrase_places(joined: bytes, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(word, label) of each place where a phrase's words stand consecutively; words between single spaces."""
    found = []
    for phrase, label in phrases.items():
        needle = f" {phrase} ".encode()
        at, word, counted = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            found.append((word, label))
            at = joined.find(needle, at + 1)
    return found


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def _scan_batches(batches: Iterator[pa.RecordBatch], templates: tuple[tuple[str, str], ...], phrases: dict[str, str], spans: bool) -> Iterator[pa.RecordBatch]:
    scanner = _scanner(templates)
    for batch in text_slices(batches):
        rows = []
        for text in utf8_of(batch.column(1)):
            words = words_of(text)
            joined = b" " + b" ".join(words) + b" "
            places = phrase_places(joined, phrases)
            accepted, score = scanner.scan(words, joined)
            base = {label for _, label in places}
            starts = [word for word, _ in places]
            row = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(accepted))), max(score, PHRASE_SCORE * bool(places)))
            if spans:
                row += ([{"label": label, "first_word": a, "end_word": b} for label in sorted(accepted) for a, b in accepted[label]],)
            rows.append(row)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [SPANS] * spans
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *NAMES, *["spans"] * spans])


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrases and accepted templates of each row: counts of words and places, labels, and a score: 1 for an
    accepted template, else the greatest share of a template's mandatory words that stood in place, and 0.5
    at least for a phrase. With ``spans``, where each template was accepted too."""
    templates, phrases = tuple((TEMPLATES if templates is None else templates).items()), PHRASES if phrases is None else phrases
    rows = text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA + (", spans array<struct<label: string, first_word: long, end_word: long>>" if spans else "")
    return rows.mapInArrow(lambda batches: _scan_batches(batches, templates, phrases, spans), schema)
