"""The corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage takes and returns documents, all columns, but the last, which
returns windows. In every stage columns may have any other name besides
doc_id, text, lang and source, rows may repeat, and an empty table gives an
empty one; what nulls, empty texts and ties come to stands below. Part of the ``velumra.llm`` package; it stands here so that jobs can be
submitted by its path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velumra.llm import minhash, mixing, packing, quality, secrets
from velumra.plans.lineage import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. It is fitted on the
    labelled documents among ``docs``; without labels of both classes all stay.
    A null text is scored as an empty one, null metadata as a value of their
    own; equal rows, and rows of equal score, stay or go together."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least doc_id stays. Documents with
    a null doc_id or with a null, empty or wordless text are in no group and
    stay; rows that repeat a doc_id stay or go together."""
    return minhash.kept_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays. Null and empty
    texts stay as they are, and a null source is an empty path."""
    return secrets.redacted_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents served before the token budget is spent stay. The budget is
    half of all words between white space, not of the tokenizer's tokens. A
    null text counts no word, a null source is a source of its own, a null
    doc_id an id of its own, and rows that repeat both are one unit; ties go by
    source, shuffle key and doc_id."""
    return mixing.kept_documents(docs, weights=mixing.WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens with their boundary records. Null and empty texts are
    documents of no token but the end mark; a null doc_id comes first; ties go
    by a hash of the text; repeated rows are packed as often as they occur."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]

#: A fitted classifier, MinHash, a forest and a tokenizer are beyond SQL;
#: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all stages over the whole table ``documents``; each stage
    but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
