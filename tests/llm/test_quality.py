"""Quality ledger: SQL over the whole table, edge rows against a plain version, policies and ablation."""

from __future__ import annotations

from kerbstat.llm import quality
from kerbstat.llm.queries import op8_quality_rules
from tests.llm.test_pipeline import plain_kept

TEXTS = [None, "", " \n\t ", "one two", "a b c d e f g h i j", "x y z w v x y z w v x y z w v", "% # * " * 9, "ab\nab\nab\nab\n" * 5,
         "a b c d e\x0b" * 3 + "f g", "é" * 900 + " x" * 12, " ".join(f"w{i}" for i in range(30_000)),
         "a b c d e q a b c d e r a b c d e", "line one here\n\nline one here\n \nline two there\nlast line of five\nand six"]


def test_edge_rows_match_a_plain_version(spark, tmp_path):
    rows = [*enumerate(TEXTS), (None, "x"), (3, TEXTS[3])]
    docs = spark.createDataFrame([(d, t, 5, "z") for d, t in rows], "doc_id bigint, text string, n_words int, failures string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_quality_rules(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got) == sorted((str(d), plain_kept(t or "")) for d, t in rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[11]["n_repeat_words"] == 15 and by_id[5]["n_repeat_words"] == 15 and by_id[4]["n_repeat_words"] == 0
    assert by_id[12]["n_dup_lines"] == 1 and by_id[1]["n_words"] == 0 and by_id[1]["word_chars"] == 0
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, t in rows if plain_kept(t or "")}


def test_empty_table(spark):
    assert quality.ledger(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_policies_and_ablation_agree_with_the_ledger(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    entries = quality.apply_policies(quality.ledger(docs))
    rows = entries.collect()
    for policy, names in quality.POLICIES.items():
        mask = quality.mask_of(names)
        assert [r[f"kept_{policy.replace('-', '_')}"] for r in rows] == [r["failures"] & mask == 0 for r in rows]
    for r in quality.ablation(entries).collect():
        own, mask = quality.mask_of([r["rule"]]), quality.mask_of(quality.POLICIES[r["policy"]])
        assert r["failed"] == sum(bool(x["failures"] & own) for x in rows)
        assert r["failed_alone"] == sum(x["failures"] & mask == own for x in rows)
        assert r["kept_without"] == sum(x["failures"] & mask & ~own == 0 for x in rows)
