"""Personal data: base spans against a plain reading of the rules, and the weakly supervised part."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kerbstat.llm import pii
from kerbstat.llm.common import running_ends
from kerbstat.llm.queries import op1_pii
from tests.conftest import SMALL

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def keeps(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(reversed(digits)):
            d = d * 2 if i % 2 else d
            total += d - 9 if d > 9 else d
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def plain_spans(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if keeps(kind, m.group())]
    return sorted(spans)


def plain_row(text):
    spans = plain_spans(text)
    said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return [sum(s[3] == k for s in spans) for k in PATTERNS] + [hashlib.sha256(said.encode()).hexdigest()]


TEXTS = [
    None, "", "plain words", "a@b.c@d.e", "x_a@b.cc_d@e.f and x@y..z", "éé q@w.de, 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255",
    "4111 1111 1111 1111 or 4111-1111-1111-1112 4111  1111", "+1 (437) 555-0689 +1 2 +123456789012345678 ++1-23-456-7890)",
    "\U0001f600 +44 20 7946 0958 mail me@example.org \U0001f600me@x.io", "@@@ +++ ... 1.1.1 a@", "." * 300 + "1" * 500 + "@" + "a.b" * 200,
    "1.1.1.1+1 2345678901@x.yz", "a.b-c%d@e-f.g-h.i-", "0" * 16,
]


def test_base_spans_match_the_rules(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "x@y.de")], "doc_id bigint, text string")
    docs.withColumn("spans", F.lit(1)).withColumn("base", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or -1, [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]]) for r in op1_pii(spark, str(tmp_path)).collect())
    want = sorted([(i or -1 if i is not None else -1, plain_row(t)) for i, t in [*enumerate(TEXTS), (3, TEXTS[3]), (None, "x@y.de")]])
    assert got == [(i or -1, row) for i, row in want]


def test_whole_table_matches_the_rules(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op1_pii(spark, SMALL).collect():
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] == plain_row(texts[r["doc_id"]])
        base = [f"{k}:{a}:{b}" for a, _, b, k in plain_spans(texts[r["doc_id"]])]
        assert [s for s in r["spans"].split(",") if s and s.split(":")[0] in PATTERNS] == base


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op1_pii(spark, str(tmp_path)).count() == 0


def corpus():
    good = [f"Please call our office by phone {200 + i} 555-{1000 + i} today." for i in range(40)]
    bad = [f"See order part serial 1{i % 90 + 10} 155-{1000 + i}x for the table." for i in range(40)]
    names = ["Dear Mr. Thomas Weber, thank you.", "Dear Mrs. Anna Klein, thank you."] * 20
    return [(i, t) for i, t in enumerate(good + bad + names)]


def test_classifier_adds_likely_spans_and_no_others(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    rows = pii.find_personal_data(docs).collect()
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in rows}
    assert all(kinds[i] == ["local_phone"] for i in range(40))
    assert all("local_phone" not in kinds[i] for i in range(40, 80))
    assert all(kinds[i] == ["name"] for i in range(80, 120))


def test_reliabilities_follow_agreement(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    model = pii.fit(pii._one_per_row(docs.select(pii.candidates(F.col("text")).alias("cands"))))
    assert model.reliability["cue"][1][1] > model.reliability["cue"][0][1]
    assert model.reliability["checksum"][1][1] > model.reliability["checksum"][0][1]


def test_redaction(spark):
    docs = spark.createDataFrame(
        [(1, "é x@y.de, +1 (437) 555-0689 end", 5), (2, None, None), (3, "nothing", 7), (4, "1.1.1.1+1 2345678901@x.yz", 1)],
        "doc_id bigint, text string, n_chars bigint",
    )
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact_personal_data(docs).collect()}
    assert got[1] == ("é [EMAIL], [PHONE] end", 22)
    assert got[2] == (None, None) and got[3] == ("nothing", 7)
    assert got[4][0].startswith("[IP]")


def test_redaction_leaves_nothing_of_overlapping_spans(spark):
    texts = {
        "1.1.1.1+1 2345678901@x.yz": "[IP][PHONE][EMAIL]",
        "é 1.1.1.1+1 2345678901@x.yz, a@b.de": "é [IP][PHONE][EMAIL], [EMAIL]",
        "4111111111111 129.0.0.1 end": "[CARD][IP] end",
    }
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [r["text"] for r in pii.redact_personal_data(docs).collect()]
    assert got == list(texts.values())


@pytest.mark.parametrize(
    ("spans", "want"),
    [
        ([(0, 4), (2, 6)], "[A][A]ghij"), ([(0, 4), (1, 3), (2, 6)], "[A][A]ghij"), ([(0, 6), (1, 3), (3, 5)], "[A]ghij"),
        ([(1, 3), (1, 5), (4, 7), (8, 9)], "a[A][A][A]h[A]j"),
    ],
)
def test_redaction_covers_the_union(spark, spans, want):
    rows = [("abcdefghij", [(a, 0, b, "a", "", "", "") for a, b in spans])]
    df = spark.createDataFrame(rows, f"text string, spans {pii.SPAN}")
    assert df.select(pii.redacted(F.col("text"), F.col("spans"))).first()[0] == want


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_running_ends(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "xs array<bigint>")
    got = df.select(running_ends(F.col("xs")).alias("s")).first()["s"]
    assert got == [i * (i + 1) // 2 for i in range(n)]


def test_plan_runs_no_python(spark):
    plan = op1_pii(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
