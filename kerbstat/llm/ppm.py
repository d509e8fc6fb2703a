"""Language-model scores: prediction by partial matching over bytes, beside a word baseline.

The model is a byte-context trie of order three: for every context of up to three bytes, how often each
byte (or the end of a text) followed it in the training documents. A byte's probability comes from the
longest context that knows it; each context passed on the way costs its escape (distinct symbols against
all, method C), and symbols it knows are excluded from the shorter ones. With the counts of the training
documents fixed, the probability depends on the last four bytes alone, so a text's code length is a sum
over its four-byte grams.

Two passes over the texts, neither of which shuffles them:

1. Tasks count words and grams of their texts; the counts are summed by key. Grams that share the two
   bytes before the last meet in one group, 65,536 at most, which holds all that exclusion needs; orders
   one and zero are tables of at most 65,536 counts.
2. Tasks score their texts by the most frequent words and grams, whose number ``KNOWN`` is fixed and whose
   words have ``LONGEST`` bytes at most: a bounded broadcast. Whatever else a text holds stays with its row
   as a list and gets its count by a join, where Spark splits hot keys; nothing is left out.

Counts, vocabulary and trie cover all training documents and grow with them; held-out documents are only
scored. Sums of logarithms may differ in the last digits with the order of addition.

Nulls and edge cases: a null text counts as empty (only its end is scored); a null id is the empty text in
the choice of held-out documents and is kept; repeated rows are training rows and get a row each; an empty
table gives no rows; without training documents words have probability one and bytes are uniform; only the
id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.llm.common import slices
from kerbstat.session import stage

FOLDS, HELD_OUT_FOLD = 7, 2
#: Most frequent words, and grams, that a task holds; bytes of such a word; bytes of text handled at once.
KNOWN, LONGEST, SLICE = 65_536, 32, 1 << 20
#: Stands before and behind a text; no UTF-8 text holds this byte.
END = 0xFF
_BUCKETS = 4096


def held_out(id_column: Column) -> Column:
    """Whether a document is only scored: by a checksum of its id as text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT_FOLD


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte gram that ends at each byte and at each text's end, and the text it is of."""
    data = texts.cast(pa.binary()).to_pylist()
    gap = bytes([END] * 3)
    joined = np.frombuffer(gap + gap.join(data) + gap, dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(x) for x in data], dtype=np.int64) + 1
    text = np.repeat(np.arange(len(data)), sizes)
    at = np.arange(len(text)) + 2 * text + 3
    grams = joined[at - 3] << 24 | joined[at - 2] << 16 | joined[at - 1] << 8 | joined[at]
    return grams, text


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z lower-cased), the word at each place, and the text it is of."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    place = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    real = place != empty
    return coded.dictionary, place[real], text[real]


def log_probabilities(first: np.ndarray, symbol: np.ndarray, n: np.ndarray, order1: np.ndarray) -> np.ndarray:
    """log10 of each gram's last byte after its first three; the two bytes between are the same for all.

    ``n`` are training counts (0: only asked for); ``order1`` counts the symbols after the third byte in
    its row of ``[third]``, given here as ``order1[0]``, and after any byte in ``order1[1]``.
    """
    third_order = np.zeros((256, 256))
    third_order[first, symbol] = n
    seen3, second_order = third_order > 0, third_order.sum(axis=0)
    seen2, seen1, seen0 = second_order > 0, order1[0] > 0, order1[1] > 0

    def escape(total, distinct):
        return np.where(distinct > 0, distinct / np.maximum(total + distinct, 1), 1.0)

    total3, distinct3 = third_order.sum(axis=1), seen3.sum(axis=1)
    total2 = second_order.sum() - seen3 @ second_order
    distinct2 = seen2.sum() - seen3.sum(axis=1)
    total1, distinct1 = order1[0][~seen2].sum(), (seen1 & ~seen2).sum()
    total0, distinct0 = order1[1][~seen1].sum(), (seen0 & ~seen1).sum()
    to2 = escape(total3, distinct3)[first]
    to1 = to2 * escape(total2, distinct2)[first]
    to0 = to1 * escape(total1, distinct1)
    rest = to0 * escape(total0, distinct0)

    def share(count, total, distinct):
        return count / np.maximum(total + distinct, 1)

    p = np.select(
        [n > 0, seen2[symbol], seen1[symbol], seen0[symbol]],
        [
            share(n, total3[first], distinct3[first]), to2 * share(second_order[symbol], total2[first], distinct2[first]),
            to1 * share(order1[0][symbol], total1, distinct1), to0 * share(order1[1][symbol], total0, distinct0),
        ],
        rest / max(1, 256 - seen0.sum()),
    )
    return np.log10(p)


def tally(docs: DataFrame) -> DataFrame:
    """``(word, gram, n)``: training counts of every word, and of every gram of any document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                texts = pc.fill_null(batch.column(1), "").cast(pa.string())
                training = ~batch.column(2).to_numpy(zero_copy_only=False)
                words, place, text = words_of(texts)
                n_words = np.bincount(place[training[text]], minlength=len(words))
                some = np.flatnonzero(n_words)
                grams, text = grams_of(texts)
                codes, keys = pd.factorize(grams)
                n_grams = np.bincount(codes[training[text]], minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([words.take(pa.array(some)), pa.nulls(len(keys), pa.string())]),
                        pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(keys.astype(np.int64))]),
                        pa.array(np.concatenate([n_words[some], n_grams]).astype(np.int64)),
                    ],
                    ["word", "gram", "n"],
                )

    return docs.mapInArrow(count, "word string, gram bigint, n bigint").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def gram_scores(grams: DataFrame) -> DataFrame:
    """``(gram, n, score)`` from the trie of all training grams."""
    after = grams.groupBy(F.expr("gram >> 8 & 255").alias("c"), F.expr("gram & 255").alias("s")).agg(F.sum("n").alias("n"))
    order1 = np.zeros((256, 256))
    for c, s, n in after.collect():  # at most 256 x 256 rows
        order1[c, s] = n
    order0 = order1.sum(axis=0)

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for middle, part in rows.groupby(rows["gram"].to_numpy() >> 8 & 0xFFFF):
            gram, n = part["gram"].to_numpy(), part["n"].to_numpy()
            scores = log_probabilities(gram >> 24, gram & 255, n, np.stack([order1[middle & 255], order0]))
            out.append(pd.DataFrame({"gram": gram, "n": n, "score": scores}))
        return pd.concat(out)

    bucket = F.pmod(F.xxhash64(F.expr("gram >> 8 & 65535")), F.lit(_BUCKETS))
    return grams.select("gram", "n").groupBy(bucket).applyInPandas(score, "gram bigint, n bigint, score double")


def most_frequent(table: DataFrame, limit: int = KNOWN) -> DataFrame:
    """The rows with ``n`` at or above the least bound that at most ``limit`` rows reach."""
    bound = F.floor(F.log2(F.greatest("n", F.lit(1))) * 16).cast("int")
    bins = sorted(table.groupBy(bound.alias("b")).count().collect(), reverse=True)
    total, least = 0, None
    for b, n in bins:
        total += n
        if total > limit:
            break
        least = b
    return table.where(F.lit(False)) if least is None else table.where(bound >= least)


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", known: int = KNOWN) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document."""
    read = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"), held_out(F.col(id_column)).alias("held_out"))
    tallies = stage(tally(read), "tallies")
    words = tallies.where("word is not null and n > 0").select("word", "n")
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = read.where(~F.col("held_out")).count()
    tokens, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    floor = float(np.log10(tokens + (distinct + 1)))
    grams = stage(gram_scores(tallies.where("gram is not null")), "grams")
    hot_words = most_frequent(words.where(F.octet_length("word") <= LONGEST), known).toPandas()
    hot_grams = most_frequent(grams, known).toPandas().sort_values("gram")
    word_set = pa.array(hot_words["word"], pa.string())
    word_score = np.append(np.log10(hot_words["n"].to_numpy(dtype=np.float64) + 1) - floor, 0.0)
    gram_set, gram_score = hot_grams["gram"].to_numpy(dtype=np.int64), np.append(hot_grams["score"].to_numpy(dtype=np.float64), 0.0)
    end_score = float(np.log10(ends + 1)) - floor

    rare_word, rare_gram = "array<struct<word:string,k:bigint>>", "array<struct<gram:bigint,k:bigint>>"
    schema = f"doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, words {rare_word}, grams {rare_gram}"

    def lists(owner: np.ndarray, key: np.ndarray, values: pa.Array, name: str, n_docs: int) -> pa.Array:
        """Per document the keys that its places hold, with how often."""
        pairs, k = np.unique(owner * len(values) + key, return_counts=True)
        offsets = np.searchsorted(pairs, np.arange(n_docs + 1) * max(1, len(values)))
        taken = values.take(pa.array(pairs % max(1, len(values))))
        entries = pa.StructArray.from_arrays([taken, pa.array(k.astype(np.int64))], [name, "k"])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                texts, n_docs = pc.fill_null(batch.column(1), "").cast(pa.string()), batch.num_rows
                own, place, text = words_of(texts)
                index = pc.fill_null(pc.index_in(own, value_set=word_set), len(word_set)).to_numpy(zero_copy_only=False)
                at = index[place]
                base = np.bincount(text, word_score[at], n_docs) + end_score
                is_rare = at == len(word_set)
                n_known = np.bincount(text[~is_rare], minlength=n_docs) + (ends > 0)
                rare_words = lists(text[is_rare], place[is_rare], own, "word", n_docs)
                grams_at, gram_text = grams_of(texts)
                codes, keys = pd.factorize(grams_at)
                keys = keys.astype(np.int64)
                where = np.searchsorted(gram_set, keys)
                hit = np.zeros(len(keys), bool) if not len(gram_set) else gram_set[np.minimum(where, len(gram_set) - 1)] == keys
                where = np.where(hit, where, len(gram_set))[codes]
                total = np.bincount(gram_text, gram_score[where], n_docs)
                is_rare = where == len(gram_set)
                rare_grams = lists(gram_text[is_rare], codes[is_rare], pa.array(keys), "gram", n_docs)
                n_tokens = np.bincount(text, minlength=n_docs) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), *(pa.array(x) for x in (n_tokens, n_known, base, total)), rare_words, rare_grams],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "grams"],
                )

    partial = stage(read.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    asked_words = partial.select("row", F.explode("words").alias("w")).select("row", "w.word", "w.k")
    more_words = asked_words.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - floor)).alias("more_base"),
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"),
    )
    asked_grams = partial.select("row", F.explode("grams").alias("g")).select("row", "g.gram", "g.k")
    more_grams = asked_grams.join(grams, "gram").groupBy("row").agg(F.sum(F.col("k") * F.col("score")).alias("more_score"))
    whole = partial.drop("words", "grams").join(more_words, "row", "left").join(more_grams, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
