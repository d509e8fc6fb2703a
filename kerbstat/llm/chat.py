"""Chat formatting by a grammar round trip (native: built-in functions only).

A conversation is rendered as turns of one grammar::

    conversation := turn*
    turn         := "<s>" "[INST]" role "[/INST]" text "</s>"

where role and text hold no control string. The parser is deterministic: it cuts at ``</s>``, then at the
markers, rejects parts with further control strings, and takes one escape back. Each turn is rendered,
parsed and compared with its source; where that differs, its conflicting content is escaped (one backslash
more behind the opening character of every control string, with or without backslashes), after which it is
identical for any content. The whole conversation is parsed and compared once more; ``identical`` says so.

The loss mask covers the text of assistant turns, as spans of the rendered string.

Turns are grouped by conversation, as the output is one string for each: a conversation, like a document,
is held in one row, however many turns it has; two conversations never are.

Nulls and edge cases: a null role or text counts as empty; a null turn number comes first; rows with one
turn number are ordered by role and text; repeated rows are repeated turns; rows without a conversation id
are one conversation with a null id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.llm.common import let, running_ends

LEARNED = "assistant"
#: The control strings, with any number of backslashes behind the opening character.
CONTROL = [r"(<)(\\*)(/?s>)", r"(\[)(\\*)(/?INST\])"]
ANY_CONTROL = r"</?s>|\[/?INST\]"
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
TURN = r"(?s)\A<s>\[INST\](.*?)\[/INST\](.*)\z"


def escaped(text: Column) -> Column:
    for pattern in CONTROL:
        text = F.regexp_replace(text, pattern, r"$1\\$2$3")
    return text


def unescaped(text: Column) -> Column:
    for pattern in CONTROL:
        text = F.regexp_replace(text, pattern.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")
    return text


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parsed_part(part: Column) -> Column:
    """``struct(role, text)`` of what stands before a closing marker; null if the grammar does not fit."""
    role, text = F.regexp_extract(part, TURN, 1), F.regexp_extract(part, TURN, 2)
    fits = F.rlike(part, F.lit(TURN)) & ~F.rlike(role, F.lit(ANY_CONTROL)) & ~F.rlike(text, F.lit(ANY_CONTROL))
    return F.when(fits, F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")))


def parsed(rendered: Column) -> Column:
    """The turns of a rendered conversation, ``array<struct(role, text)>``."""

    def turns(parts: Column) -> Column:
        return F.transform(F.slice(parts, 1, F.size(parts) - 1), parsed_part)

    return let(F.split(rendered, CLOSE), turns)


def round_trips(role: Column, text: Column) -> Column:
    """Whether a turn rendered as it is reads back as it was."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    return F.coalesce(parsed(rendered_turn(role, text)) == source, F.lit(False))


def format_conversations(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, rendered, loss_spans, identical)``; spans are code points of ``rendered``, end exclusive."""
    plain = rows.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    checked = plain.withColumn("raw", round_trips(F.col("role"), F.col("text")))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "raw")))
    grouped = checked.groupBy("conv_id").agg(turns.alias("turns"))

    def drawn(t: Column) -> Column:
        shown_role, shown = (F.when(t["raw"], t[k]).otherwise(escaped(t[k])) for k in ("role", "text"))
        return F.struct(
            F.concat(F.lit(OPEN), shown_role, F.lit(MIDDLE)).alias("head"), shown.alias("body"), (t["role"] == LEARNED).alias("learned")
        )

    parts = grouped.select("conv_id", "turns", F.transform("turns", drawn).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    sizes = F.transform("parts", lambda p: (F.char_length(p["head"]) + F.char_length(p["body"]) + len(CLOSE)).cast("bigint"))

    def mask(ends: Column) -> Column:
        spans = F.transform(
            "parts",
            lambda p, i: F.struct(
                (F.get(ends, i) - len(CLOSE) - F.char_length(p["body"])).alias("start"), (F.get(ends, i) - len(CLOSE)).alias("end"),
                p["learned"].alias("learned"),
            ),
        )
        kept = F.filter(spans, lambda s: s["learned"])
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    formatted = parts.select("conv_id", "turns", whole.alias("rendered"), let(running_ends(sizes), mask).alias("loss_spans"))
    same = F.coalesce(parsed(F.col("rendered")) == source, F.lit(False))
    return formatted.select("conv_id", "rendered", "loss_spans", same.alias("identical"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the rendered strings hold: turns and learned texts, from nothing but the string and the mask."""
    learned = F.transform(
        "loss_spans",
        lambda s: unescaped(F.substring(F.col("rendered"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    read = formatted.select("conv_id", parsed(F.col("rendered")).alias("turns"), F.array_join(learned, "").alias("learned"), "rendered")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("rendered").cast("bigint").alias("formatted_chars"),
    )
