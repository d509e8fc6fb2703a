"""Personal data by weak supervision (native: built-in functions only).

1. Candidates. One regex per kind finds spans in whole texts: strict ones (the base kinds, kept whatever
   the rest decides) and loose ones (spelled-out addresses, numbers without a prefix, titled names).
2. Labelers vote +1, 0 or -1 on every candidate: form, checksum, gazetteers, cue words before, text around.
3. Expectation-maximisation over the counts per vote pattern estimates each labeler's reliability and each
   kind's share of true spans.
4. The posteriors train the final span classifier, a naive Bayes model over shape and surroundings; a
   loose span is added if its probability reaches ``THRESHOLD``.

Steps 3 and 4 work on counts per pattern of votes and features. Their number is bounded by the product of
the value ranges, whatever the table's size, and counts are combined before the shuffle; nothing else is
shuffled. A text's candidates stay in its row.

Nulls and edge cases: a null text counts as empty; a null id is kept; repeated rows get a row each; an
empty table gives no rows (and priors for a model); only the id and the text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.llm.common import let, running_ends, spans_text
from kerbstat.session import stage

# The base kinds in the order that sorts spans, and their patterns. A look-behind or \G (the
# end of the last match) starts a match where a run starts, which finds the same spans in linear time.
BASE_KINDS = ["email", "ip", "card", "phone"]
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a span of the kind passes.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

LOOSE = {
    "spelled_email": r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z]{2,24}){1,4}",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) |[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?",
}
LOOSE_HINT = {
    "spelled_email": r"[\[(]at[\])]", "local_phone": r"[0-9]{3}[ .-][0-9]{4}", "national_id": r"-[0-9]{2}-",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\b",
}
KINDS = [*BASE_KINDS, *LOOSE]

# Gazetteers: short lists of plain words.
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
GIVEN = "Anna|Maria|John|James|Mary|Peter|Paul|Hans|Klaus|Pierre|Marie|Jean|Juan|Carlos|Lucia|Elena|Thomas|David|Laura|Sarah"
CUES = {
    "email": "mail|contact|write|reach", "ip": "ip|address|host|server|login|client",
    "card": "card|visa|credit|payment|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|cell|anruf",
    "spelled_email": "mail|contact|write|reach", "local_phone": "phone|tel|call|fax|mobile|cell|anruf",
    "national_id": "ssn|social|security|insurance|identity|id", "name": "dear|contact|patient|client|signed|by",
}
DOUBTS = "version|isbn|issn|order|invoice|figure|page|chapter|section|price|serial|release|doi|table|part"
CONTEXT, THRESHOLD, ROUNDS = 30, 0.8, 12
LABELERS = ["form", "checksum", "gazetteer", "cue", "around"]
FEATURES = ["size", "before", "after", "marks", "cued"]
#: Pseudo-counts of votes +1, 0 and -1 by true and by false spans: labelers are better than chance.
PRIOR = {1: {1: 4.0, 0: 3.0, -1: 1.0}, 0: {1: 1.0, 0: 3.0, -1: 4.0}}

SPAN = "array<struct<start:bigint,rank:int,`end`:bigint,kind:string,value:string,left:string,right:string>>"


def found(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """All matches of a pattern as spans: the gaps between them come from splitting at the same pattern."""
    rank = KINDS.index(kind)

    def spans(hits: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.transform(hits, lambda h, i: (F.char_length(F.get(gaps, i)) + F.char_length(h)).cast("bigint"))
            return let(
                running_ends(steps),
                lambda ends: F.transform(
                    hits,
                    lambda h, i: F.struct(
                        (F.get(ends, i) - F.char_length(h)).alias("start"), F.lit(rank).alias("rank"),
                        F.get(ends, i).alias("end"), F.lit(kind).alias("kind"), h.alias("value"),
                        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"),
                        F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right"),
                    ),
                ),
            )

        return F.when(F.size(hits) > 0, let(F.split(text, pattern), placed))

    hinted = F.contains(text, F.lit(hint)) if len(hint) == 1 else F.rlike(text, F.lit(hint))
    hits = F.when(hinted, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans))
    return F.coalesce(hits.cast(SPAN), F.array().cast(SPAN))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    places = F.transform(F.sequence(F.lit(0), F.char_length(digits) - 1), weighed)
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(span: Column) -> Column:
    """The base rules beyond the pattern."""
    kind, value = span["kind"], span["value"]
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    n = F.char_length(digits_of(value))
    return (
        F.when(kind == "ip", F.rlike(value, F.lit(rf"^{part}\.{part}\.{part}\.{part}\z")))
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits_of(value))).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def base_spans(text: Column) -> Column:
    """The base spans of a text by start, then kind."""
    every = F.concat(*[found(text, kind, STRICT[kind], HINT[kind]) for kind in BASE_KINDS])
    return F.sort_array(F.filter(every, passes))


def loose_spans(text: Column) -> Column:
    return F.concat(*[found(text, kind, LOOSE[kind], LOOSE_HINT[kind]) for kind in LOOSE])


def candidates(text: Column) -> Column:
    """``struct(base, loose)`` of a text; null counts as empty."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.struct(base_spans(t).alias("base"), loose_spans(t).alias("loose")))


def _choice(kind: Column, options: dict[str, Column], other: Column) -> Column:
    cases = [(kind == name, value) for name, value in options.items()]
    first = F.when(*cases[0])
    return reduce(lambda c, case: c.when(*case), cases[1:], first).otherwise(other)


def votes(span: Column) -> list[Column]:
    """One vote of -1, 0 or 1 per labeler."""
    kind, value, left, right = span["kind"], span["value"], span["left"], span["right"]
    digits, abstain = digits_of(value), F.lit(0)

    def says(condition: Column, yes: int = 1, no: int = 0) -> Column:
        return F.when(condition, F.lit(yes)).otherwise(F.lit(no))

    cue = _choice(kind, {k: F.rlike(left, F.lit(rf"(?i)\b(?:{words})")) for k, words in CUES.items()}, F.lit(False))
    form = F.when(F.array_contains(F.array(*[F.lit(k) for k in BASE_KINDS]), kind), F.lit(1)).when(
        kind == "spelled_email", F.lit(1)
    ).otherwise(abstain)
    checksum = _choice(
        kind,
        {
            "card": says(F.rlike(digits, F.lit(r"^([0-9])\1*\z")), -1, 1),
            "ip": says(F.rlike(value, F.lit(r"^(?:0|127|255)\.")), -1, 0),
            "national_id": says(F.rlike(value, F.lit("^(?:000|666|9..)-|-00-|-0000")), -1, 1),
            "local_phone": says(F.rlike(digits, F.lit("^[2-9]..[2-9]")), 1, -1),
        },
        abstain,
    )
    gazetteer = _choice(
        kind,
        {
            "email": says(F.rlike(value, F.lit(rf"(?i)\.(?:{DOMAINS})\z"))),
            "spelled_email": says(F.rlike(value, F.lit(rf"(?i)(?:{DOMAINS})\z")), 1, -1),
            "name": says(F.rlike(value, F.lit(rf" (?:{GIVEN})\b"))),
        },
        abstain,
    )
    context = F.when(F.rlike(left, F.lit(rf"(?i)\b(?:{DOUBTS})[^.]*\z")), F.lit(-1)).when(cue, F.lit(1)).otherwise(abstain)
    around = says(F.rlike(left, F.lit(r"[\p{L}\p{N}_]\z")) | F.rlike(right, F.lit(r"^[\p{L}\p{N}_]")), -1, 0)
    return [x.alias(name) for name, x in zip(LABELERS, [form, checksum, gazetteer, context, around], strict=True)]


def features(span: Column) -> list[Column]:
    """Small categorical features of the final classifier, each within its kind."""
    kind, value, left, right = span["kind"], span["value"], span["left"], span["right"]

    def side(text: Column, pattern: str) -> Column:
        return F.when(text == "", F.lit("edge")).when(F.rlike(text, F.lit(pattern.format(r"\s"))), F.lit("space")).when(
            F.rlike(text, F.lit(pattern.format(r"[\p{L}\p{N}]"))), F.lit("word")
        ).otherwise(F.lit("mark"))

    size = F.least(F.lit(5), F.floor(F.char_length(value) / 8)).cast("string")
    marks = F.least(F.lit(5), F.char_length(F.regexp_replace(value, r"[\p{L}\p{N}]+", ""))).cast("string")
    cued = _choice(kind, {k: F.rlike(left, F.lit(rf"(?i)\b(?:{words})")) for k, words in CUES.items()}, F.lit(False)).cast("string")
    values = [size, side(left, r"{}\z"), side(right, "^{}"), marks, cued]
    return [F.concat_ws("|", kind, F.lit(name), x).alias(name) for name, x in zip(FEATURES, values, strict=True)]


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers, and the classifier's log-odds per kind and per feature value."""

    reliability: dict[str, dict[int, dict[int, float]]]
    share: dict[str, float]
    weight: dict[str, float]

    def log_odds(self, span: Column) -> Column:
        """The classifier's log-odds that a span is personal data."""
        prior = _choice(span["kind"], {k: F.lit(_logit(p)) for k, p in self.share.items()}, F.lit(0.0))
        if not self.weight:
            return prior
        table = F.create_map(*[F.lit(x) for pair in sorted(self.weight.items()) for x in pair])
        return reduce(lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)), features(span), prior)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _posterior(share: dict[str, float], reliability: dict[str, dict[int, dict[int, float]]]) -> Column:
    odds = _choice(F.col("kind"), {k: F.lit(_logit(p)) for k, p in share.items()}, F.lit(0.0))
    for name, by_class in reliability.items():
        ratio = {v: math.log(by_class[1][v] / by_class[0][v]) for v in (1, 0, -1)}
        odds = odds + F.when(F.col(name) == 1, ratio[1]).when(F.col(name) == -1, ratio[-1]).otherwise(ratio[0])
    return 1 / (1 + F.exp(-odds))


def fit(spans: DataFrame, rounds: int = ROUNDS) -> SpanModel:
    """The model from a table with one candidate per row, as a struct ``span``.

    Candidates are counted per pattern of votes and features; what comes to the driver are sums, one per
    labeler, class and vote, kind, or feature value.
    """
    span = F.col("span")
    described = spans.select(span["kind"].alias("kind"), *votes(span), *features(span))
    patterns = stage(described.groupBy(*described.columns).agg(F.count("*").alias("n")), "patterns")
    share = {k: 0.5 for k in KINDS}
    reliability = {name: {y: {v: c / sum(PRIOR[y].values()) for v, c in PRIOR[y].items()} for y in (1, 0)} for name in LABELERS}
    for _ in range(rounds):
        p, n = _posterior(share, reliability), F.col("n")
        sums = []
        for kind in KINDS:
            own = F.when(F.col("kind") == kind, n).otherwise(0)
            sums += [F.sum(own * p).alias(f"true_{kind}"), F.sum(own).alias(f"all_{kind}")]
        for name in LABELERS:
            for v in (1, 0, -1):
                said = F.when(F.col(name) == v, n).otherwise(0)
                sums += [F.sum(said * p).alias(f"1_{name}_{v}"), F.sum(said * (1 - p)).alias(f"0_{name}_{v}")]
        got = {k: float(x or 0) for k, x in patterns.agg(*sums).first().asDict().items()}
        new_share = {k: (got[f"true_{k}"] + 1) / (got[f"all_{k}"] + 2) for k in KINDS}
        for name in LABELERS:
            for y in (1, 0):
                counts = {v: got[f"{y}_{name}_{v}"] + PRIOR[y][v] for v in (1, 0, -1)}
                reliability[name][y] = {v: c / sum(counts.values()) for v, c in counts.items()}
        moved = max(abs(new_share[k] - share[k]) for k in KINDS)
        share = new_share
        if moved < 1e-6:
            break
    scored = patterns.withColumn("p", _posterior(share, reliability))
    values = scored.select("kind", "n", "p", F.explode(F.array(*FEATURES)).alias("feature"))
    rows = values.groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("p")).alias("t"), F.sum(F.col("n") * (1 - F.col("p"))).alias("f")).collect()
    total: dict[str, list[float]] = {k: [0.0, 0.0] for k in KINDS}
    for r in rows:
        total[r["kind"]][0] += r["t"] / len(FEATURES)
        total[r["kind"]][1] += r["f"] / len(FEATURES)
    weight = {
        r["feature"]: math.log((r["t"] + 1) / (total[r["kind"]][0] + 6)) - math.log((r["f"] + 1) / (total[r["kind"]][1] + 6))
        for r in rows
    }
    return SpanModel(reliability, share, weight)


def all_spans(cands: Column, model: SpanModel, threshold: float = THRESHOLD) -> Column:
    """The base spans and the loose ones that the classifier accepts, by start, then kind."""
    added = F.filter(cands["loose"], lambda s: model.log_odds(s) >= F.lit(_logit(threshold)))
    return F.sort_array(F.concat(cands["base"], added))


def _one_per_row(cands: DataFrame) -> DataFrame:
    return cands.select(F.explode(F.concat("cands.base", "cands.loose")).alias("span"))


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: arrays of spans with kind, start and end (code points, end exclusive)."""
    scanned = stage(docs.select(F.col(id_column).alias("doc_id"), candidates(F.col(text_column)).alias("cands")), "candidates")
    model = fit(_one_per_row(scanned))
    return scanned.select("doc_id", F.col("cands.base").alias("base"), all_spans(F.col("cands"), model).alias("spans"))


def digest(found_spans: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found_spans.select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets.

    Of a span that reaches beyond those before it, what is left is replaced as well; one inside them adds nothing.
    """

    def apart(ss: Column) -> Column:
        first = F.array().cast(SPAN)

        def behind(acc: Column, s: Column) -> Column:
            done = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
            rest = s.withField("start", F.greatest(s["start"], done))
            return F.when(s["end"] > done, F.concat(acc, F.array(rest))).otherwise(acc)

        return F.aggregate(ss, first, behind)

    def rewritten(ss: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(ss, i - 1)["end"]).otherwise(F.lit(0))
            return F.concat(F.substring(text, (begin + 1).cast("int"), (s["start"] - begin).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))

        tail = F.substring(text, (F.element_at(ss, -1)["end"] + 1).cast("int"), F.char_length(text))
        return F.concat(F.array_join(F.transform(ss, piece), ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(let(apart(spans), rewritten))


def redact_personal_data(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """The documents with personal data replaced, and ``n_chars``, if there is one, counted anew."""
    model = fit(_one_per_row(docs.select(candidates(F.col(text_column)).alias("cands"))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scanned = docs.select(row, candidates(F.col(text_column)).alias("_c"))
    text = F.col("_row")[text_column]
    changed = scanned.select("_row", let(all_spans(F.col("_c"), model), lambda s: redacted(text, s)).alias("_text"))
    length = F.char_length("_text").cast("bigint")

    def column(name: str) -> Column:
        if name == text_column:
            return F.col("_text").alias(name)
        if name == length_column:
            return F.when(F.col("_text").isNull(), F.col("_row")[name]).otherwise(length).alias(name)
        return F.col("_row")[name].alias(name)

    return changed.select(*[column(c) for c in docs.columns])
