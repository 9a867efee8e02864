"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is its mandatory wording with `<<beginOptional>> ... <<endOptional>>` around wording that may be absent and
`<<var;max=N>>` for up to N words of any kind, or any but those of `<<var;max=N;not=word,word>>`. A label may have several
templates: a license's notice, its name and its mandatory paragraphs. All templates share one automaton over words, built by subset
construction as words are met; it starts only at words that can open a template, so most of a text is passed over.
A template is accepted where its mandatory words stand in order and exactly, with nothing between them but what the
markup allows.

Of the templates accepted from the same word the longest counts, so a license is not taken for one that its wording begins.

Nulls read as empty texts: no words, no labels, score 0. A text may match any number of templates at any number of
places; labels are distinct and sorted. Rows are handled one by one, so repeated rows and long texts need no care.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, arrow_pass, documents, text_bytes

#: Word bytes after lower-casing: digits, a-z and every byte of a character beyond ASCII; others part words.
WORDS = bytes(LOWER[b] if 48 <= LOWER[b] <= 57 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))

# The phrases every scan reports, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording that templates share. O(x): x or nothing.
O = "<<beginOptional>>{}<<endOptional>>".format  # noqa: E741
UNDER = f"licensed under {O('the')} {O('terms of the')}"
VERSION = f"{O('version')} {O('v')}"
FSF = "as published by the free software foundation"
BSD_TERMS = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
             "<<var;max=1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
             "<<var;max=1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
             "in the documentation and or other materials provided with the distribution")
ENDORSE = "may <<var;max=1>> be used to endorse or promote products derived from this software without specific prior written permission"
NO_NAMES = f"<<var;max=1>> neither the name <<var;max=12>> nor the names of <<var;max=2>> contributors {ENDORSE}"
PERMIT = ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
          "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted")


def gnu(name: str, short: str, number: str, date: str) -> tuple[str, ...]:
    """A GNU license's names, notices and heading."""
    major = number.split()[0]
    minor = number[len(major):].strip()
    tail = minor if minor not in ("", "0") else O("0")
    whole = f"gnu {name}public license"
    return (f"{UNDER} {whole} {VERSION} {major} {tail}", f"{UNDER} {whole} v{major} {tail}", f"{UNDER} {O('gnu')} {short} {VERSION} {major} {tail}",
            f"{UNDER} {O('gnu')} {short} v{major} {tail}", f"{UNDER} {O('gnu')} {short}v{major} {tail}",
            f"under the terms of {O('version ' + number + ' of')} the {whole} {VERSION} {major} {tail}", f"under the terms of the {whole} v{major} {tail}",
            f"under the terms of version {major} {tail} of the {whole}",
            f"under the terms of the {whole} {FSF} either version {major} {tail} of the license",
            f"under the terms of the {whole} {FSF} version {major} {tail} of the license",
            f"under the terms of version {major} {tail} of the {whole} {FSF}", f"{whole} version {number} {date}")


def creative(*terms: str) -> tuple[str, ...]:
    """A Creative Commons license's name, in words and in letters."""
    words = {"by": "attribution", "nc": "non commercial", "sa": "share alike", "nd": "no derivatives"}
    joined = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    older = {**joined, "nd": "noderivs"}
    names = dict.fromkeys(" ".join(d[t] for t in terms) for d in (words, joined, older, {**older, "nc": words["nc"]}, {**joined, "nc": words["nc"]}))
    return (*(f"creative commons {n}" for n in names), *(f"{UNDER} creative commons {n}" for n in names), f"{UNDER} {O('a')} {O('creative commons')} cc {' '.join(terms)}")


TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "apache-2.0": (f"licensed under {O('the')} apache license {O('version')} 2 0", f"{UNDER} apache {O('software')} license {VERSION} 2 {O('0')}",
                   f"{UNDER} apache {O('license')} v2 {O('0')}", f"you under the apache license {O('version')} 2 0", "apache license version 2 0 january 2004",
                   f"you may obtain a copy of the license at <<var;max=1>> {O('www')} apache org licenses license 2 0"),
    "mit": (f"{O('released')} under the mit license", "under the terms of the mit license", f"{UNDER} mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this <<var;max=3>> and associated documentation files <<var;max=2>> "
            "to deal in the <<var;max=2>> without restriction including without limitation the rights to use copy modify merge publish distribute "
            "sublicense and or sell copies of the"),
    "isc": (f"{UNDER} isc license", *(f"{p} provided that the above copyright notice and this permission notice appear in all copies" for p in PERMIT)),
    "0bsd": (*(f"{p} the software is provided" for p in PERMIT), f"{UNDER} zero clause bsd license", f"{UNDER} bsd zero clause license"),
    "bsd-2-clause": (f"{BSD_TERMS} this software is provided by", f"{UNDER} bsd 2 clause", f"{UNDER} 2 clause bsd",
                     f"{UNDER} simplified bsd"),
    "bsd-3-clause": (f"{BSD_TERMS} {NO_NAMES}", f"{BSD_TERMS} <<var;max=1>> the names <<var;max=12>> {ENDORSE}", f"{BSD_TERMS} <<var;max=1>> the name of <<var;max=12>> {ENDORSE}",
                     f"{UNDER} bsd 3 clause", f"{UNDER} 3 clause bsd", f"{UNDER} new bsd", f"{UNDER} modified bsd", f"{UNDER} revised bsd"),
    "bsd-4-clause": (f"{BSD_TERMS} <<var;max=1>> all advertising materials mentioning features or use of this software must display the following acknowledgement",
                     f"{UNDER} bsd 4 clause", f"{UNDER} 4 clause bsd", f"{UNDER} original bsd"),
    "gpl-2.0": (*gnu("general ", "gpl", "2", "june 1991"), f"{UNDER} gnu <<var;max=1;not=lesser,library,affero>> general public license {O('version')} 2"),
    "gpl-3.0": (*gnu("general ", "gpl", "3", "29 june 2007"), f"{UNDER} gnu <<var;max=1;not=lesser,library,affero>> general public license {O('version')} 3"),
    "lgpl-2.0": (*gnu("library general ", "lgpl", "2 0", "june 1991"), "gnu library general public license version 2 june 1991"),
    "lgpl-2.1": gnu("lesser general ", "lgpl", "2 1", "february 1999"),
    "lgpl-3.0": gnu("lesser general ", "lgpl", "3", "29 june 2007"),
    "agpl-3.0": gnu("affero general ", "agpl", "3", "19 november 2007"),
    "mpl-1.1": (f"{UNDER} mozilla public license {VERSION} 1 1", "subject to the mozilla public license version 1 1", f"{UNDER} mpl {VERSION} 1 1"),
    "mpl-2.0": (f"{UNDER} mozilla public license {VERSION} 2 {O('0')}", f"{UNDER} mozilla public license v2 {O('0')}", f"{UNDER} mpl {VERSION} 2 {O('0')}",
                "subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0 <<var;max=1>> 1 definitions"),
    "epl-2.0": (f"{UNDER} eclipse public license {VERSION} 2 {O('0')}", f"under the terms of the eclipse public license {VERSION} 2 {O('0')}"),
    "bsl-1.0": (f"{UNDER} boost software license {VERSION} 1 0", "distributed under the boost software license version 1 0", "boost software license version 1 0 august 17th 2003"),
    "zlib": (f"{UNDER} zlib license", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
             "and redistribute it freely subject to the following restrictions"),
    "unlicense": ("this is free and unencumbered software released into the public domain", f"{UNDER} unlicense"),
    "cc0-1.0": (f"{O('creative commons')} cc0 1 0 universal", f"{UNDER} {O('creative commons')} cc0"),
    "cc-by": creative("by")[:-1],
    "cc-by-sa": creative("by", "sa"),
    "cc-by-nd": creative("by", "nd"),
    "cc-by-nc": (f"licensed under {O('a creative commons')} cc by nc {O('4 0')}", *creative("by", "nc")),
    "cc-by-nc-sa": creative("by", "nc", "sa"),
    "cc-by-nc-nd": creative("by", "nc", "nd"),
    "copyright-reserved": "copyright <<var;max=6>> all rights reserved",
}

MARK = re.compile(r"<<(beginOptional|endOptional|var;max=\d+(?:;not=[\w,]+)?)>>")


def tokens(raw: bytes) -> list[bytes]:
    """Lower-cased words of a text's UTF-8 bytes."""
    return raw.translate(WORDS).split()


@dataclass
class Automaton:
    """A non-deterministic automaton over words, made deterministic as it runs."""

    on_word: list[dict[bytes, int]] = field(default_factory=list)
    on_any: list[int | None] = field(default_factory=list)
    barred: dict[int, set[bytes]] = field(default_factory=dict)
    skip: list[list[int]] = field(default_factory=list)
    accepts: dict[int, str] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)

    def state(self) -> int:
        self.on_word.append({})
        self.on_any.append(None)
        self.skip.append([])
        return len(self.on_word) - 1

    def add(self, label: str, template: str) -> None:
        at = self.state()
        self.starts.append(at)
        open_at: list[int] = []
        for k, part in enumerate(MARK.split(template)):
            if k % 2 == 0:
                for word in tokens(part.encode()):
                    nxt = self.state()
                    self.on_word[at][word] = nxt
                    at = nxt
            elif part == "beginOptional":
                # An empty move into the region, so that the way round it does not lead back through its words.
                inside = self.state()
                self.skip[at].append(inside)
                open_at.append(at)
                at = inside
            elif part == "endOptional":
                after = self.state()
                self.skip[at].append(after)
                self.skip[open_at.pop()].append(after)
                at = after
            else:
                ways = [at]
                most, _, barred = part.removeprefix("var;max=").partition(";not=")
                for _ in range(int(most)):
                    nxt = self.state()
                    self.on_any[at] = nxt
                    self.barred[at] = set(tokens(barred.encode()))
                    at = nxt
                    ways.append(at)
                after = self.state()
                for w in ways:
                    self.skip[w].append(after)
                at = after
        if open_at:
            raise ValueError(f"{label}: an optional region is not closed")
        self.accepts[at] = label

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.skip[s]
        return frozenset(seen)

    def ready(self) -> "Automaton":
        self.start = self.closed(self.starts)
        if any(self.on_any[s] is not None for s in self.start) or self.start & self.accepts.keys():
            raise ValueError("a template must open with a word")
        self.first = {w for s in self.start for w in self.on_word[s]}
        self.alphabet = {w for d in self.on_word for w in d}.union(*self.barred.values())
        self.moves: dict[tuple[frozenset[int], bytes | None], tuple[frozenset[int], list[str]]] = {}
        return self

    def move(self, states: frozenset[int], word: bytes) -> tuple[frozenset[int], list[str]]:
        key = (states, word if word in self.alphabet else None)
        got = self.moves.get(key)
        if got is None:
            to = {self.on_word[s][word] for s in states if word in self.on_word[s]} | {
                self.on_any[s] for s in states if self.on_any[s] is not None and word not in self.barred[s]}
            to = self.closed(to)
            got = self.moves[key] = (to, sorted(self.accepts[s] for s in to if s in self.accepts))
        return got

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, words, label) of every accepted template at every place, the longest way each."""
        first, out = self.first, []
        for i in [k for k, w in enumerate(words) if w in first]:
            states, found = self.start, {}
            for j in range(i, len(words)):
                states, labels = self.move(states, words[j])
                for label in labels:
                    found[label] = j + 1 - i
                if not states:
                    break
            out += [(i, n, label) for label, n in found.items()]
        return out


def compiled(templates: dict[str, str | tuple[str, ...]] = TEMPLATES) -> Automaton:
    automaton = Automaton()
    for phrase, label in BASE.items():
        automaton.add(f"base:{label}", phrase)
    for label, forms in templates.items():
        for template in (forms,) if isinstance(forms, str) else forms:
            automaton.add(label, template)
    return automaton.ready()


def longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base phrases, and of the templates accepted from the same word those that take most words."""
    most: dict[int, int] = {}
    for i, n, label in found:
        if not label.startswith("base:"):
            most[i] = max(n, most.get(i, 0))
    return [(i, n, label) for i, n, label in found if label.startswith("base:") or n == most[i]]


def scan(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    score is 1 where a template is accepted, 0.5 where base phrases alone stand, else 0. spans lists
    (label, first word, words) of every match, base phrases included, in text order.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())])))])
    held: list[Automaton] = []

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(compiled(templates))
        rows = []
        for raw in text_bytes(batch.column(1)):
            words = tokens(raw)
            found = longest(held[0].matches(words))
            base = [(i, label[5:]) for i, _, label in found if label.startswith("base:")]
            own = {label for _, _, label in found if not label.startswith("base:")}
            base_labels = {label for _, label in base}
            rows.append((len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
                         ",".join(sorted(base_labels)), ",".join(sorted(base_labels | own)), 1.0 if own else 0.5 if base else 0.0,
                         [{"label": label.removeprefix("base:"), "first": i, "words": n} for i, n, label in found]))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    return arrow_pass(documents(docs), one, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                      "labels string, score double, spans array<struct<label:string,first:long,words:long>>")
