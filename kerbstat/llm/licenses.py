"""License notices by template-markup matching.

A template is wording with markup: ``[[...]]`` is optional, ``{{m-n}}`` stands for m to n words of any
kind, ``(a|b)`` for one of several words; the rest is mandatory. It compiles to a token automaton whose
states are the places between words. A text has a template's label if somewhere in it the automaton
accepts: the mandatory wording stands there exactly, in order, with nothing but optional or replaceable
words between. Words are runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z, so that
punctuation, case and line ends make no difference.

Beside it stand the base phrases, whose places are counted. Texts are read whole; one that holds no
template's longest mandatory word is known not to match without running an automaton. Rows are handled
where they lie, without a shuffle.

Nulls and edge cases: a null text counts as empty (no words, no labels, score 0); a null id is kept;
repeated rows get a row each; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kerbstat.llm.common import slices

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licenses and notices in common use, by label. Licenses are whole: a text that alters or leaves out a
# clause is another license. What users fill in (names of holders) is replaceable, numbers of clauses are optional.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "licensed under the apache license [[version]] 2 0",
        "apache license version 2 0 january 2004",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution [[[[3]] neither the name of {{1-12}} nor the names of [[its]] contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission]] this software is provided by {{1-12}} as "
        "is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
        "fitness for a particular purpose are disclaimed in no event shall {{1-12}} be liable for any direct indirect incidental "
        "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss "
        "of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
        "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised "
        "of the possibility of such damage",
        "(released|licensed) under [[the terms of]] the [[new|modified]] [[2|3]] [[clause]] bsd [[2|3]] [[clause]] license",
    ],
    "cc-by": [
        "licensed under [[a|the]] creative commons attribution [[{{1-2}}]] [[4|3|2]] [[0|5]] [[international|unported|generic]] license",
    ],
    "gpl-2.0": [
        "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license",
    ],
    "gpl-3.0": [
        "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license",
    ],
    "isc": [
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is "
        "and {{1-12}} disclaims all warranties with regard to this software including all implied warranties of merchantability "
        "and fitness in no event shall {{1-12}} be liable for any special direct indirect or consequential damages or any damages "
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
        "action arising out of or in connection with the use or performance of this software",
    ],
    "mit": [
        "(released|licensed|distributed|available) under [[the terms of]] the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this {{1-6}} [[and associated documentation "
        "files]] [[the {{1-3}}]] to deal in the {{1-3}} without restriction including without limitation the rights to use copy "
        "modify merge publish distribute sublicense and or sell copies of the {{1-3}} and to permit persons to whom the {{1-3}} is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including "
        "the next paragraph]] shall be included in all copies or substantial portions of the {{1-3}} the {{1-3}} is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness "
        "for a particular purpose and noninfringement in no event shall {{1-12}} be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the {{1-3}} or the "
        "use or other dealings in the {{1-3}}",
    ],
    "mpl-2.0": ["subject to the terms of the mozilla public license [[v|version]] 2 0"],
    "proprietary": ["all rights reserved [[{{0-12}}]] (unauthorized|unauthorised) (copying|use|reproduction) [[{{0-12}}]] prohibited"],
}
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _WORD[b] else 0x20 for b in range(256))
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+-\d+\}\}|\(|\)|\||[^\s\[\](){}|]+")


def pattern(markup: str) -> str:
    """The regular expression that a template is over words that are each followed by a blank."""
    marks = {"[[": "(", "]]": ")?"}
    parts = []
    for token in _MARKUP.findall(markup):
        if token.startswith("{{"):
            least, most = token[2:-2].split("-")
            parts.append(f"([^ ]+ ){{{least},{most}}}")
        else:
            parts.append(marks.get(token, token if token in "(|)" else f"{token} "))
    return "".join(parts)


class Automaton:
    """A template as a token automaton; state ``i`` has edges on words, on any word (None), and empty ones."""

    def __init__(self, markup: str) -> None:
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.mandatory: list[bytes] = []
        tokens = _MARKUP.findall(markup)
        self.final, rest = self._sequence(tokens, 0, 0, 0)
        if rest != len(tokens):
            raise ValueError(f"unbalanced markup: {markup}")
        self.closed = [self._closure({i}) for i in range(len(self.edges))]
        self.first = {word for state in self.closed[0] for word, _ in self.edges[state]}
        if None in self.first or self.final in self.closed[0] or not self.mandatory:
            raise ValueError(f"a template begins with a word that is not replaceable: {markup}")
        self.probe = max(self.mandatory, key=len)

    def _state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _sequence(self, tokens: list[str], at: int, state: int, depth: int) -> tuple[int, int]:
        """Alternatives of sequences up to the closing token; returns the state behind and the place."""
        begin, ends = state, []
        while at < len(tokens) and tokens[at] not in ("]]", ")"):
            token = tokens[at]
            if token == "|":
                ends.append(state)
                state = begin
            elif token in ("[[", "("):
                behind, at = self._sequence(tokens, at + 1, state, depth + 1)
                if token == "[[":
                    self.empty[state].append(behind)
                state = behind
            elif token.startswith("{{"):
                least, most = map(int, token[2:-2].split("-"))
                end = self._state()
                for k in range(most):
                    if k >= least:
                        self.empty[state].append(end)
                    following = self._state()
                    self.edges[state].append((None, following))
                    state = following
                self.empty[state].append(end)
                state = end
            else:
                following = self._state()
                self.edges[state].append((token.encode(), following))
                if depth == 0:
                    self.mandatory.append(token.encode())
                state = following
            at += 1
        if depth or ends:
            end = self._state()
            for one in [*ends, state]:
                self.empty[one].append(end)
            state = end
        return state, at

    def _closure(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for state in self.empty[todo.pop()]:
                if state not in found:
                    found.add(state)
                    todo.append(state)
        return frozenset(found)

    def end(self, words: list[bytes], start: int) -> int | None:
        """Where the shortest acceptance from ``start`` ends, or None."""
        states = self.closed[0]
        for at in range(start, len(words)):
            word = words[at]
            reached = {t for s in states for label, t in self.edges[s] if label is None or label == word}
            if not reached:
                return None
            states = frozenset().union(*(self.closed[t] for t in reached))
            if self.final in states:
                return at + 1
        return None


@lru_cache(maxsize=1)
def automata() -> list[tuple[str, Automaton]]:
    return [(label, Automaton(markup)) for label, markups in TEMPLATES.items() for markup in markups]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def templates_in(words: list[bytes], plain: bytes) -> list[tuple[str, int, int]]:
    """``(label, first word, end)`` of each template's first acceptance."""
    found = []
    places: dict[bytes, list[int]] | None = None
    for label, automaton in automata():
        if automaton.probe not in plain:
            continue
        if places is None:
            places = {}
            for i, word in enumerate(words):
                places.setdefault(word, []).append(i)
        starts = sorted(i for word in automaton.first for i in places.get(word, ()))
        ends = ((i, automaton.end(words, i)) for i in starts)
        first = next(((i, e) for i, e in ends if e is not None), None)
        if first:
            found.append((label, *first))
    return found


def phrases_in(words: list[bytes]) -> list[tuple[str, int]]:
    """``(label, first word)`` of every place where a base phrase stands."""
    found = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                found.append((label, at))
    return found


def count_words(texts: pa.StringArray) -> np.ndarray:
    """Words of each text, from the bytes of the whole batch at once."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    word = _WORD[np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, bool)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1] - offsets[0]
    inner = inner[inner < len(word)]
    begins[inner] = word[inner]
    before = np.concatenate([[0], np.cumsum(begins)])
    return before[offsets[1:] - offsets[0]] - before[offsets[:-1] - offsets[0]]


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_words, places, matches, score)``.

    ``places``: label and word of every base phrase; ``matches``: label, first word and end of each template's
    first acceptance. The score is 1 for a template, 0.5 for a phrase alone, else 0.
    """
    schema = (
        "doc_id bigint, n_words bigint, places array<struct<label:string,word:bigint>>, "
        "matches array<struct<label:string,word:bigint,`end`:bigint>>, score double"
    )
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    match_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {a.probe for _, a in automata()} | {b"license"}
        for whole in batches:
            for batch in slices(whole, 1):
                texts = pc.fill_null(batch.column(1), "").cast(pa.string())
                places, matches = [], []
                for text in texts.cast(pa.binary()).to_pylist():
                    plain = text.translate(_TO_WORDS)
                    hit = any(p in plain for p in probes)
                    words = plain.split() if hit else []
                    places.append([{"label": k, "word": i} for k, i in phrases_in(words)])
                    matches.append([{"label": k, "word": i, "end": e} for k, i, e in templates_in(words, plain)] if hit else [])
                score = [1.0 if m else 0.5 if p else 0.0 for p, m in zip(places, matches, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(count_words(texts), pa.int64()), pa.array(places, place_type),
                        pa.array(matches, match_type), pa.array(score, pa.float64()),
                    ],
                    ["doc_id", "n_words", "places", "matches", "score"],
                )

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(scan, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, places and labels of the scan."""
    base, starts = F.col("places.label"), F.col("places.word")

    def joined(labels):
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("matches.label"))).alias("labels"), "score",
    )
