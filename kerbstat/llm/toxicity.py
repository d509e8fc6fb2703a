"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared per window.

A window is one word between blanks (of a word beyond ``WIDTH`` bytes, overlapping pieces). It is compressed
twice: with a dictionary of ordinary and with one of toxic text. Both begin with the same trained part, which
holds the entropy tables and common passages, so that what a window shares with all text costs the same, and
end with the content of their own class, of equal length. A carrier, a passage of the common part, follows
every window, so that even short ones are stored compressed and their lengths can be compared to the byte. The gain is
how many bytes the toxic dictionary saves.

Fitting, on a bounded sample of labelled rows (``TOXIC_ROWS`` and ``ORDINARY_ROWS`` texts at most, the first by
a hash of the id, none above ``LONGEST`` characters; the bound is on the fit alone):

1. One half trains the dictionaries. The content of a class are the words and beginnings of words that stand in
   more different contexts (neighbouring words) there than the other class's texts explain, by a likelihood ratio
   beyond what that many candidates reach by chance. Contexts count once, so copies of a text count once.
2. The other half calibrates: a logistic curve over the numbers of different windows that reach each of ``GAINS``
   bytes, against the number of windows.

Scoring reads whole texts where they lie, without a shuffle. Distinct windows are compressed once for a slice,
and frequent ones stay in the worker.

Nulls and edge cases: a null text counts as empty; an empty text has the score of no windows; a null id is kept,
is not held out and has no label; repeated rows get a row each, and of repeated ids in the sample the smallest
text trains; a document is toxic if any of its label rows says so; null labels do not count; without labels of
one of the classes every score is the share of toxic ones (0 without any); an empty table gives no rows.
Only the id and the text are read, and of the labels the id and ``toxic``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from kerbstat.llm.common import PLAIN, bounded_sample, coded_words, slices
from kerbstat.session import stage

FOLDS, HELD_OUT_FOLD, LEAST = 4, 2, 0.3
#: The bound of the sample that is fitted on.
TOXIC_ROWS, ORDINARY_ROWS, LONGEST = 3_000, 6_000, 10_000
#: Bytes of the common part and of a class's content; of a window; of the carrier; of text handled at once.
COMMON, CONTENT, WIDTH, CARRIER, SLICE = 65_536, 512, 48, 64, 4 << 20
#: Passages that the common part is trained on.
SAMPLES = 10_000
#: Gains, in bytes, at which windows are counted; windows that a worker keeps.
GAINS, CACHE = (1, 2, 3, 4), 400_000


def held_out(id_column: Column) -> Column:
    """Whether a document's label is never learned from: by a checksum of its id as text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT_FOLD


@dataclass(frozen=True)
class Model:
    """Two dictionaries that differ in their last bytes, the carrier, and the curve's weights."""

    ordinary: bytes
    toxic: bytes
    carrier: bytes
    weights: tuple[float, ...]

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Chance of toxicity by rows of ``counts``: windows, and different ones at or above each gain."""
        return 1.0 / (1.0 + np.exp(-np.clip(evidence(counts) @ np.array(self.weights), -30, 30)))


def evidence(counts: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(counts)), np.log1p(counts)])


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Settings by which single short matches count: least length three, optimal parsing, no headers."""
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=3, target_length=64,
        strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    own = zstandard.ZstdCompressionDict(dictionary)
    own.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=parameters)


class Comparer:
    """Gains of windows under a pair of dictionaries; one per worker process, kept between tasks."""

    def __init__(self, ordinary: bytes, toxic: bytes, carrier: bytes) -> None:
        self.pair = compressor(ordinary), compressor(toxic)
        self.carrier = carrier
        self.known: dict[bytes, int] = {}

    def compare(self, words: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves on each window."""
        framed = [b" " + w + b" " + self.carrier for w in words]
        size = np.array([len(w) for w in framed], dtype=np.uint64)
        segments = np.column_stack([np.cumsum(size) - size, size]).tobytes()
        joined = zstandard.BufferWithSegments(b"".join(framed), segments)
        lengths = [[len(x) for x in c.multi_compress_to_buffer(joined)] for c in self.pair]
        return [a - b for a, b in zip(*lengths, strict=True)]

    def gain(self, word: bytes) -> int:
        """The gain of a word; the largest one of its pieces where it is long."""
        return max(self.known[w] for w in pieces(word))

    def gains(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known = {}
        new = list({w for word in words if word not in self.known for w in pieces(word) if w not in self.known})
        if new:
            self.known.update(zip(new, self.compare(new), strict=True))
        return np.array([self.known[w] if w in self.known else self.gain(w) for w in words], dtype=np.int64)


def pieces(word: bytes, width: int = WIDTH) -> list[bytes]:
    """A word, or overlapping pieces of a long one."""
    return [word] if len(word) <= width else [word[i : i + width] for i in range(0, len(word) - width // 2, width // 2)]


@lru_cache(maxsize=2)
def comparer(ordinary: bytes, toxic: bytes, carrier: bytes) -> Comparer:
    return Comparer(ordinary, toxic, carrier)


def window_counts(texts: pa.StringArray, own: Comparer) -> np.ndarray:
    """Per text: windows, and different ones at or above each gain."""
    words, place, text = coded_words(texts)
    gain = own.gains(words.cast(pa.binary()).to_pylist())
    counts = [np.bincount(text, minlength=len(texts))]
    some = gain[place] >= GAINS[0] if len(place) else np.zeros(0, bool)
    where, which = np.divmod(np.unique(text[some] * len(words) + place[some]), max(1, len(words)))
    return np.column_stack(counts + [np.bincount(where[gain[which] >= g], minlength=len(texts)) for g in GAINS])


def contexts(texts: list[str]) -> tuple[Counter, int]:
    """In how many different contexts every word and beginning of a word stands."""
    seen = set()
    for text in texts:
        words = text.encode().translate(PLAIN).split()
        seen.update(zip([b"", *words[:-1]], words, [*words[1:], b""], strict=True))
    found: Counter = Counter()
    for word, times in Counter(word for _, word, _ in seen).items():
        if 4 <= len(word) <= WIDTH:
            found[b" " + word + b" "] += times
            for n in (4, 5, 6, 8):
                if n < len(word):
                    found[b" " + word[:n]] += times
    return found, len(seen)


def content(own: Counter, own_total: int, other: Counter, other_total: int, size: int = CONTENT) -> bytes:
    """The expressions that mark a class, strongest last, in ``size`` bytes at most."""
    bound, share = 2 * math.log(max(2, len(own))), own_total / max(1, own_total + other_total)

    def ratio(a: int, b: int) -> float:
        n = a + b
        if a <= share * n:
            return 0.0
        return 2 * (a * math.log(a / (share * n)) + (b * math.log(b / ((1 - share) * n)) if b else 0.0))

    marked = [(r, w) for w, a in own.items() if (r := ratio(a, other[w])) > bound and a * other_total >= 4 * other[w] * own_total]
    picked: list[bytes] = []
    for _, word in sorted(marked, reverse=True):
        if sum(map(len, picked)) + len(word) > size:
            break
        if not any(word in p or (p in word and len(word) <= len(p) + 1) for p in picked):
            picked.append(word)
    return b"".join(reversed(picked))


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, bytes]:
    """The ordinary and the toxic dictionary, and the carrier."""
    texts = [t.encode().translate(PLAIN) for t in ordinary]
    samples = [t[i : i + 256] for t in texts for i in range(0, len(t), 256)]
    samples = samples[:: max(1, len(samples) // SAMPLES)]
    try:
        common = zstandard.train_dictionary(COMMON, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        common = b"".join(samples)[-COMMON:] or b" "
    (a, n), (b, m) = contexts(toxic), contexts(ordinary)
    own, other = content(a, n, b, m), content(b, m, a, n)
    size = max(len(own), len(other))
    return common + other.rjust(size), common + own.rjust(size), common[-CARRIER - 64 : -64] or common[-CARRIER:]


def fit_curve(counts: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton's steps, with a penalty on all but the constant."""
    x, w = evidence(counts), np.zeros(counts.shape[1] + 1)
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit_texts(texts: list[str], toxic: list[bool], halves: list[int]) -> Model:
    """A model from labelled texts; half 0 trains the dictionaries, half 1 calibrates."""
    flags = np.array(toxic, dtype=bool)
    share = float(flags.mean()) if len(flags) else 0.0
    if not 0 < share < 1:
        flat = math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0)
        return Model(b" ", b" ", b" ", (flat, *[0.0] * (len(GAINS) + 1)))
    own = [[t for t, f, h in zip(texts, toxic, halves, strict=True) if f == kind and h == 0] for kind in (True, False)]
    ordinary, marked, carrier = dictionaries(*own)
    judge = Comparer(ordinary, marked, carrier)
    rest = [i for i, h in enumerate(halves) if h == 1]
    parts = [pa.array([texts[i] for i in rest[k : k + 256]], pa.string()) for k in range(0, len(rest), 256)]
    counts = np.concatenate([np.zeros((0, len(GAINS) + 1)), *(window_counts(part, judge) for part in parts)])
    return Model(ordinary, marked, carrier, fit_curve(counts, flags[rest].astype(float)))


def fit(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS,
    id_column: str = "doc_id", text_column: str = "text",
) -> Model:
    """A model of the labelled documents that are not held out, from a bounded sample of them."""
    key = F.col(id_column).cast("bigint").alias("doc_id")
    marked = labels.select(key, F.col("toxic").cast("boolean").alias("toxic")).where("doc_id is not null and toxic is not null")
    marked = stage(marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return fit_texts([""] * len(sizes), list(sizes), [0] * len(sizes))
    bounds = {True: toxic_rows, False: ordinary_rows}
    parts = [
        bounded_sample(marked.where(F.col("toxic") == F.lit(kind)), "doc_id", rows, sizes[kind]).withColumn("toxic", F.lit(kind))
        for kind, rows in bounds.items()
    ]
    sample = stage(parts[0].unionByName(parts[1]), "sample")
    texts = docs.select(key, F.col(text_column).alias("text")).where(F.length("text") <= LONGEST)
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    halves = [crc32(f"half {r['doc_id']}".encode()) % 2 for r in rows]
    return fit_texts([r["text"] for r in rows], [r["toxic"] for r in rows], halves)


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_windows, gains, score)``: windows, how many reach each gain, chance of toxicity."""
    schema = "doc_id bigint, held_out boolean, n_windows bigint, gains array<bigint>, score double"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = comparer(model.ordinary, model.toxic, model.carrier)
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                counts = window_counts(pc.fill_null(batch.column(2), "").cast(pa.string()), own)
                reached = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(counts) + 1, dtype=np.int32) * len(GAINS)), pa.array(counts[:, 1:].ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(counts[:, 0]), reached, pa.array(model.scores(counts))],
                    ["doc_id", "held_out", "n_windows", "gains", "score"],
                )

    own = F.col(id_column)
    picked = docs.select(own.cast("bigint").alias("doc_id"), held_out(own).alias("held_out"), F.col(text_column).alias("text"))
    return picked.mapInArrow(judge, schema)


def digest(scored: DataFrame, least: float = LEAST) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), "n_windows", "gains")
