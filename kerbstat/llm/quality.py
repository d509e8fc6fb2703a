"""Quality rules as a ledger of failure bits (native: built-in functions only).

Every rule is evaluated once per document; the ledger keeps what was measured and one bit per failed
rule. A policy is a named, versioned mask over these bits, so that a policy can be changed, compared
or ablated without reading a text again.

Nulls and edge cases: a null text counts as empty (no words, fails ``few_words``); a null id is kept
as it is; repeated rows get a row each; an empty table gives an empty ledger. Only the id and the text
are read, so other columns, whatever their names, do no harm. A document's words are held in one row,
whose size is that of the text; nothing is grouped or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.llm.common import WHITE, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A document fails if ``failed``, a condition on the measurements, is true."""

    bit: int
    name: str
    failed: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = [
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "2 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 40 * n_words"),
]
BASE = ["few_words", "repeated_windows"]
POLICIES = {"base-1": BASE, "default-1": [rule.name for rule in RULES]}


def mask_of(names: list[str], rules: list[Rule] = RULES) -> int:
    by_name = {rule.name: rule.mask for rule in rules}
    return reduce(lambda mask, name: mask | by_name[name], names, 0)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of five that occurs again in the text.

    Windows are compared by a 64-bit hash of their words. Texts without a repeat, by far the most,
    are known by the number of distinct hashes; only the others sort theirs.
    """

    def hashes(w: Column) -> Column:
        windows = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(windows, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                return (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))

            return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["i"]))

        def count(starts: Column) -> Column:
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, i: F.struct(
                    (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")
                ),
                lambda a: a["n"],
            )

        return count(let(ordered, twins))

    def repeats(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes(w), repeats)))


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct of longs."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")

        def counted(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                repeated_words(w).cast("bigint").alias("n_repeat_words"),
            )

        def lined(x: Column) -> Column:
            return F.struct(
                F.size(x).cast("bigint").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            )

        return F.struct(
            let(words_of(t), counted).alias("w"),
            let(lines, lined).alias("l"),
            F.char_length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        )

    def flat(m: Column) -> Column:
        return F.struct(
            m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
            m["l"]["n_lines"].alias("n_lines"), m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
        )

    return let(let(F.coalesce(text, F.lit("")), of), flat)


def failure_bits(rules: list[Rule] = RULES) -> Column:
    """One bit per failed rule, over the columns of the measurements."""
    bits = [F.when(F.expr(rule.failed), F.lit(rule.mask)).otherwise(F.lit(0)) for rule in rules]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint")


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``(id, measurements..., failures)``: one row per document, every rule evaluated once."""
    measured = docs.select(F.col(id_column).alias("_id"), measurements(F.col(text_column)).alias("_m"))
    wide = measured.select("_id", "_m.*")
    return wide.select(F.col("_id").alias(id_column), *MEASURES, failure_bits(rules).alias("failures"))


def verdict(names: list[str], rules: list[Rule] = RULES, failures: str = "failures") -> Column:
    """Whether a document passes a policy."""
    return F.col(failures).bitwiseAND(F.lit(mask_of(names, rules))) == 0


def apply_policies(entries: DataFrame, policies: dict[str, list[str]] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """The ledger with one boolean ``kept_<policy>`` per policy."""
    return entries.withColumns(
        {f"kept_{name.replace('-', '_')}": verdict(rule_names, rules) for name, rule_names in policies.items()}
    )


def ablation(entries: DataFrame, policies: dict[str, list[str]] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents failing it, failing only it, and kept if it were left out.

    Works on the counts per bit pattern, at most two to the power of the number of rules.
    """
    patterns = entries.groupBy("failures").count()
    outcomes = []
    for name, rule_names in policies.items():
        mask = mask_of(rule_names, rules)
        for rule in (r for r in rules if r.name in rule_names):
            outcomes.append(
                F.struct(
                    F.lit(name).alias("policy"), F.lit(rule.name).alias("rule"),
                    F.col("failures").bitwiseAND(F.lit(rule.mask)).alias("own"),
                    F.col("failures").bitwiseAND(F.lit(mask & ~rule.mask)).alias("others"),
                )
            )
    rows = patterns.select("count", F.explode(F.array(*outcomes)).alias("o"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("count")).otherwise(0)).cast("bigint")

    own, others = F.col("o.own") != 0, F.col("o.others") != 0
    return rows.groupBy(F.col("o.policy").alias("policy"), F.col("o.rule").alias("rule")).agg(
        total(own).alias("failed"), total(own & ~others).alias("failed_alone"), total(~others).alias("kept_without")
    )


def quality_filter(docs: DataFrame, policy: str = "default-1", text_column: str = "text") -> DataFrame:
    """The documents that pass the policy, all columns as they came."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    measured = docs.select(row, measurements(F.col(text_column)).alias("_m")).select("_row", "_m.*")
    kept = measured.withColumn("failures", failure_bits()).where(verdict(POLICIES[policy]))
    return kept.select("_row.*")
