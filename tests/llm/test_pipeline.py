"""The pipeline against a plain version of its stages, and each stage's columns."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline
from kerbstat.session import work_dir
from tests.conftest import SMALL
from tests.llm import test_packing, test_pii, test_simhash


def plain_kept(text):
    words = test_simhash.plain_words_cased(text)
    if len(words) < 10:
        return False
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for starts in seen.values() if len(starts) > 1 for i in starts for k in range(5)}
    lines = [x for x in text.split("\n") if test_simhash.plain_words_cased(x)]
    chars, symbols = sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>")
    return not (
        100 * len(repeated) > 20 * len(words)
        or 2 * symbols > 3 * len(words)
        or (len(lines) >= 4 and 10 * (len(lines) - len(set(lines))) > 3 * len(lines))
        or chars < 2 * len(words)
        or chars > 40 * len(words)
    )


def plain_redacted(text):
    out, at = "", 0
    for start, _, end, kind in test_pii.plain_spans(text):
        if end > at:  # of a span that reaches beyond those before it, the rest goes as well
            out, at = f"{out}{text[at:start]}[{kind.upper()}]", end
    return out + text[at:]


def test_run_matches_plain_stages(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    docs = [(d, t) for d, t in docs if plain_kept(t)]
    fps = [test_simhash.plain_fingerprint(t) for _, t in docs]
    roots = test_simhash.plain_components([d for d, _ in docs], fps)
    docs = [(d, plain_redacted(t)) for (d, t), root in zip(docs, roots, strict=True) if d == root]
    rows = corpus_pipeline.run(spark, SMALL).collect()
    test_packing.check(rows, docs)


def test_long_repeated_and_tied_rows_without_ids(spark, tmp_path):
    overlap = "mail 1.1.1.1+1 2345678901@x.yz or call +1 (437) 555-0689 about the ten words that follow here today"
    long = " ".join(f"word{i} of the long text" for i in range(20_000))
    lone = "a text without an id that stands alone and has more than ten words in it as well"
    rows = [
        (1, overlap), (1, overlap), (2, overlap), (None, overlap), (None, lone), (None, lone), (3, long), (4, long), (3, "short"),
        (None, None), (5, ""), (6, "###### $$$ %%%%% &&&& |||| <<<< >>>> **** #### $$$$ %%%% &&&&"), (7, "same words " * 30),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, i, "x") for i, (d, t) in enumerate(rows)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, failures int, fp string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = [(1, plain_redacted(overlap)), (None, lone), (3, long)]
    assert plain_redacted(overlap).startswith("mail [IP][PHONE][EMAIL] or call [PHONE] about")
    test_packing.check(got, want)
    for doc, text in want:
        pieces = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == doc)
        assert [i for _, ids in pieces for i in ids] == test_packing.whole_ids(text)


def test_a_run_leaves_its_result_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " + " ".join(f"w{i * j}" for j in range(20))) for i in range(1, 6)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(urlparse(work_dir(spark)).path)
    before = {p for p in shared.rglob("*.parquet")}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
    left = {p.relative_to(shared).parts for p in shared.rglob("*.parquet") if p not in before}
    assert {parts[1] for parts in left} == {"packing"} and len({parts[0] for parts in left}) == 1


def test_packing_returns_the_ids(spark):
    docs = [(1, "some text"), (2, "word " * 5000), (None, None)]
    rows = corpus_pipeline.packed_sequences(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), SMALL).collect()
    got = {d: [i for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == d for i in r["ids"]] for d, _ in docs}
    assert got == {d: test_packing.whole_ids(t) for d, t in docs}


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(
        [(i, f"{t} text number {i} with more than ten words in it so that it stays here", "en", "s", 1, i) for i, t in enumerate("abc")]
        + [(None, None, None, None, None, None)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, failures int",
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "failures"]
    assert docs.count() == 3


def test_empty_table(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "packing"]
