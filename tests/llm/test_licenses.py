"""License scans: the base rules against SQL-free plain code, automata against expansions."""

from __future__ import annotations

import itertools
import re

import pytest

from kerbstat.llm import licenses
from kerbstat.llm.queries import op7_license_scan
from tests.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words = plain_words(text)
    places = [(label, i) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for _, i in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for k, _ in places}))


def row(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


TEXTS = [
    None, "", "?!", "The MIT License; mit-license MIT\nLICENSE.", "mit licensé mit license", "general public license general public general public license",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "x " * 50_000 + "apache license",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the apache license version 3 0",
    "All rights reserved. Any unauthorized copying of it is strictly prohibited", "\x00mit\x7flicense`{",
]
LABELS = {6: "mit", 7: "apache,apache-2.0", 9: "gpl,gpl-3.0", 10: "apache", 11: "proprietary", 5: "gpl"}


def test_edge_rows(spark, tmp_path):
    rows = [*enumerate(TEXTS), (None, "mit license"), (3, TEXTS[3])]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id bigint, text string, n_words int, labels string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert row(r) == plain_base("mit license" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        if r["doc_id"] in LABELS:
            assert r["labels"] == LABELS[r["doc_id"]]
        assert r["score"] == (0.0 if not r["labels"] else 1.0 if r["doc_id"] in (6, 7, 9, 11) else 0.5)


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op7_license_scan(spark, SMALL).collect():
        assert row(r) == plain_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op7_license_scan(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(
    ("markup", "pattern"),
    [
        ("a b", "a b"), ("a [[b]] c", "a( b)? c"), ("a {{0-2}} c", "a( [abcd]){0,2} c"), ("a {{1-2}} c [[d]] b", "a( [abcd]){1,2} c( d)? b"),
        ("(a|b) [[c|d]] a", "(a|b)( c| d)? a"), ("a [[b [[c]] d]] a", "a( b( c)? d)? a"), ("a [[{{0-1}}]] b", "a( [abcd])? b"),
    ],
)
def test_automata_accept_what_the_markup_means(markup, pattern):
    automaton = licenses.Automaton(markup)
    for n in range(1, 6):
        for words in itertools.product("abcd", repeat=n):
            joined = " ".join(words)
            ends = [m for m in range(1, n + 1) if re.fullmatch(pattern, " ".join(words[:m]))]
            assert automaton.end([w.encode() for w in words], 0) == (ends[0] if ends else None), joined


def whole(label, place=-1):
    """A license's text with its optional parts left out, and names filled in."""
    markup = licenses.TEMPLATES[label][place]
    while "[[" in markup:
        markup = re.sub(r"\[\[[^\[\]]*\]\]", "", markup)
    return re.sub(r"\{\{\d+-\d+\}\}", "Example Holders", markup)


def labels_of(text):
    plain = text.encode().translate(licenses._TO_WORDS)
    return {label for label, _, _ in licenses.templates_in(plain.split(), plain)}


@pytest.mark.parametrize(("label", "place"), [("mit", 1), ("bsd", 0), ("isc", 0), ("gpl-2.0", 1), ("gpl-3.0", 1)])
def test_whole_licenses_and_altered_ones(label, place):
    text = whole(label, place)
    assert labels_of(f"Copyright 2024 Someone. {text.upper()}! More text.") == {label}
    words = text.split()
    for at in range(0, len(words), 3):
        if words[at] in ("Example", "Holders"):
            continue
        assert labels_of(" ".join([*words[:at], "altered", *words[at + 1 :]])) == set(), words[at]
    assert labels_of(" ".join(words[: len(words) // 2]) + " commercial use is forbidden") == set()


def test_three_clauses_and_numbers():
    two = whole("bsd", 0)
    numbered = two.replace("met  redistributions", "met 1. Redistributions").replace("disclaimer  redistributions", "disclaimer; 2. Redistributions")
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert labels_of(numbered.replace("distribution  this software", f"distribution. {third} This software")) == {"bsd"}
    assert labels_of(numbered.replace("distribution  this software", f"distribution. {third[:60]} This software")) == set()


@pytest.mark.parametrize("markup", [m for own in licenses.TEMPLATES.values() for m in own])
def test_pattern_and_automaton_agree(markup):
    text = re.sub(r"\(([^|()]*)\|[^()]*\)", r"\1", re.sub(r"\[\[|\]\]|\|\S+(?=\]\])", " ", re.sub(r"\{\{\d+-\d+\}\}", "name", markup)))
    for words in (text.split(), text.split()[:-1]):
        found = re.search(" (" + licenses.pattern(markup) + ")", " " + " ".join(words) + " ")
        accepted = any(licenses.Automaton(markup).end([w.encode() for w in words], i) for i in range(len(words)))
        assert accepted == bool(found)


def test_markup_must_begin_with_a_word():
    for bad in ("{{0-1}} a", "[[a]]", "", "a ]] b"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)
