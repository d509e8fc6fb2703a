"""A training corpus from raw documents: quality rules, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, folder)``, works on all that the stage before it kept, and is written
as Parquet and read again for the next. All but the last return the columns of ``documents``:

1. ``quality_rules`` drops the documents that the rules reject;
2. ``simhash_near_dedup`` keeps one document of each component of near-duplicates (three-word shingles,
   two differing bits), the one with the smallest id;
3. ``pii`` replaces personal data in texts by the kind in brackets and counts ``n_chars`` anew;
4. ``packing`` returns the pieces of the remaining documents, token ids and all, with their places in sequences of 4096.

Null texts fail the first stage (no words); null ids are kept; repeated rows are near-duplicates of each
other, so one stays; an empty table passes through; further columns are carried along to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from kerbstat.llm import packing, pii, quality, queries, simhash
from kerbstat.llm.common import table
from kerbstat.session import remove, staging, work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality.quality_filter(docs, "default-1")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return pii.redact_personal_data(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", personal_data),
    ("packing", packed_sequences),
]

#: No SQL: SimHash needs XXH64, and packing a tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage staged, and the documents that it read, are removed once its own are written; the result's folder stays.
    """
    docs, root, before = table(spark, folder, "documents"), f"{work_dir(spark)}/pipeline-{uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{root}/{name}"
        with staging(spark):
            stage(spark, docs, folder).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


QUERIES: dict[str, queries.Query] = {**queries.QUERIES, "pipeline": run}
ORACLES: dict[str, str] = {**queries.ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
