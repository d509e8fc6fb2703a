"""Chat formatting: round trips of any content, the loss mask, edge rows."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings, strategies as st

from kerbstat.llm import chat
from kerbstat.llm.queries import op6_chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), digest(learned))
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


ROWS = [
    (1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, "system", "a"), (2, 1, "assistant", "b"),
    (None, None, None, "x"), (None, 2, "assistant", "</s>"), (3, 0, "[/INST]", "<s>[INST]user[/INST]</s>"), (4, 0, "assistant", r"<\s> <\\/s> [\INST] [INST <s"),
    (5, 0, "assistant", "é\U0001f600<s>" * 3000), (5, None, "assistant", "first"), (6, 0, "user", "[/INST"), (6, 1, "user", "</s"), (6, 2, "assistant", "<INST] [s>"),
]
BOTH = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_edge_rows(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], SCHEMA + ", raw int, rendered string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(op6_chat_format(spark, str(tmp_path))) == plain(ROWS + BOTH)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(op6_chat_format(spark, str(tmp_path))) == plain(BOTH)


def test_all_are_identical_and_masked_text_is_in_place(spark):
    rows = chat.format_conversations(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert all(r["identical"] for r in rows)
    for r in rows:
        for s in r["loss_spans"]:
            assert r["rendered"][: s["start"]].endswith("[/INST]") and r["rendered"][s["end"] :].startswith("</s>")


PIECES = st.lists(st.sampled_from(["<", "s>", "/s>", "\\", "[", "INST]", "/INST]", "<s>", "</s>", "[INST]", "[/INST]", "a", "\n", "$1"]), max_size=8).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["user", "assistant", "</s>"]), PIECES), min_size=40, max_size=80))
def test_any_content_round_trips(spark, turns):
    rows = [(c, i, r, x) for i, (c, r, x) in enumerate(turns)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    assert all(r["identical"] for r in formatted.select("identical").collect())
    assert got(chat.read_back(formatted)) == plain(rows)
