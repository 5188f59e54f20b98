"""Licence scans: templates with optional and replaceable regions, as automata over words.

Mark-up: ``[[...]]`` is optional, ``{n}`` is replaceable by any words, at most n, and everything else
must stand word for word. Words are runs of ASCII letters and digits (A-Z lower-cased) and of characters
beyond ASCII, so case, punctuation and line ends make no difference. A text has a licence if some
run of its words is accepted, from its first mandatory word to its last: part of a licence is none. A text may have several labels, ties
included. Null and empty texts have no words and no label; repeated rows are scanned one by one. A text is held whole, however long.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from martloom.llm.rows import map_batches, pick
from martloom.llm.suffix_decontam import words_of

# Phrases that alone make a label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_NO_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall "
    "[[the]] {8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
    "from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_DISCLAIMER = (
    "this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect "
    "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)

# Wording of public licences and of their usual notices.
TEMPLATES = {
    "template:mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "[[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _NO_WARRANTY
    ),
    "template:mit-notice": "[[{6} is]] released under the [[terms of the]] mit license",
    "template:isc": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {6} "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall {6} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of "
        "use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software"
    ),
    "template:bsd-2-clause": _BSD + _BSD_DISCLAIMER,
    "template:bsd-3-clause": (
        _BSD + "[[3]] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission " + _BSD_DISCLAIMER
    ),
    "template:apache-2.0": "licensed under the apache license version 2 0 [[the license you may not use {4} except in compliance with the license]]",
    "template:apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use {4} except in compliance with the license you may obtain a "
        "copy of the license at {1} www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
        "implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "template:gpl-notice": "this {4} is licensed under the gnu general public license [[version {2}]]",
    "template:gpl-program": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation [[either]] version {3} [[of the license]] [[or at your option any later version]] "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details"
    ),
    "template:cc-by-notice": "licensed under [[a]] [[the]] [[creative commons]] cc by [[nc]] [[sa]] [[nd]] {2}",
    "template:unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by "
        "any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment "
        "of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law " + _NO_WARRANTY
    ),
}
BASE_SCORE, TEMPLATE_SCORE = 0.5, 1.0
_TOKEN = re.compile(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+")


class Automaton:
    """Words on arcs; ``None`` stands for any word. States are sets of places, moved together."""

    def __init__(self, template: str):
        self.arcs: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        tokens = _TOKEN.findall(template)
        end, rest = self._sequence(tokens, 0, 0)
        if rest != len(tokens):
            raise ValueError("]] without [[")
        self.end = end
        self.closed = [self._closure(s) for s in range(len(self.arcs))]

    def _new(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _sequence(self, tokens: list[str], at: int, state: int) -> tuple[int, int]:
        while at < len(tokens) and tokens[at] != "]]":
            token = tokens[at]
            if token == "[[":
                before = state
                state, at = self._sequence(tokens, at + 1, state)
                if at == len(tokens):
                    raise ValueError("[[ without ]]")
                self.free[before].append(state)
            elif token.startswith("{"):
                first = state
                steps = [first]
                for _ in range(int(token[1:-1])):
                    new = self._new()
                    self.arcs[steps[-1]].append((None, new))
                    steps.append(new)
                state = self._new()
                for s in steps:
                    self.free[s].append(state)
            else:
                new = self._new()
                self.arcs[state].append((token.encode(), new))
                state = new
            at += 1
        return state, at

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def end_of(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run from ``start``; -1 if none is."""
        states, found = set(self.closed[0]), -1
        for at in range(start, len(words)):
            moved = {t for s in states for w, t in self.arcs[s] if w is None or w == words[at]}
            if not moved:
                break
            states = set().union(*(self.closed[t] for t in moved))
            if self.end in states:
                found = at + 1
        return found


class Scanner:
    """All phrases and templates against one list of words."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.automata = {label: Automaton(anchored(t)) for label, t in templates.items()}
        self.anchors = {label: anchor(t) for label, t in templates.items()}
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        known = {w for p, _ in self.phrases for w in p} | {w for a in self.anchors.values() for w in a}
        self.number = {w: i + 1 for i, w in enumerate(sorted(known))}

    def places(self, ids: np.ndarray, phrase: list[bytes]) -> np.ndarray:
        """Starts of the phrase's words in a row."""
        size = len(ids) - len(phrase) + 1
        if size <= 0:
            return np.zeros(0, np.int64)
        found = np.flatnonzero(ids[:size] == self.number[phrase[0]])
        for k, w in enumerate(phrase[1:], 1):
            found = found[ids[found + k] == self.number[w]]
        return found

    def scan(self, text: str | None) -> tuple[int, list[int], list[str], list[str]]:
        """Number of words, starts of base phrases, base labels and template labels."""
        words = words_of(text)
        known = self.number.get
        ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        starts, labels = [], set()
        if not ids.any():
            return len(words), [], [], []
        for phrase, label in self.phrases:
            found = self.places(ids, phrase)
            if len(found):
                starts += found.tolist()
                labels.add(label)
        more = [k for k, a in self.automata.items() if any(a.end_of(words, s) >= 0 for s in self.places(ids, self.anchors[k]).tolist())]
        return len(words), sorted(starts), sorted(labels), sorted(more)


def anchored(template: str) -> str:
    """The template from its first mandatory word on: what is optional or replaceable before it accepts the empty run."""
    tokens, depth = _TOKEN.findall(template), 0
    for at, token in enumerate(tokens):
        depth += (token == "[[") - (token == "]]")
        if not depth and token != "]]" and not token.startswith("{"):
            return " ".join(tokens[at:])
    raise ValueError("a template without a mandatory word")


def anchor(template: str) -> list[bytes]:
    """The leading mandatory words that stand together, at most four: a match can begin only where they do."""
    out = []
    for token in _TOKEN.findall(anchored(template)):
        if token in ("[[", "]]") or token.startswith("{") or len(out) == 4:
            break
        out.append(token.encode())
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(key, n_words, starts, base_labels, template_labels) of every row."""
    rows = pick(docs, key, text)

    def work(steps):
        scanner = Scanner(templates)
        for keys, texts in steps:
            yield [keys, *(list(c) for c in zip(*map(scanner.scan, texts), strict=True))] if keys else [[]] * 5

    schema = f"{key} {dict(rows.dtypes)[key]}, n_words long, starts array<long>, base_labels array<string>, template_labels array<string>"
    return map_batches(rows, schema, work)
