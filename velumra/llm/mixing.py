"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import table
from ..plans.prefix import prefix_sum
from .words import unused

#: A token here is a run of characters other than ASCII white space.
WORD = r"[^ \t\n\r\f\x0B]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    default_weight: float = 1.0,
    budget_fraction: float = 0.5,
    budget_tokens: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """The queue of documents up to the budget.

    Each source's documents are shuffled by md5 of (seed, doc_id). A document's
    virtual finish is the cumulative token count of its source up to and
    including it, divided by the source's weight. All are served in order of
    (finish, source, shuffle key, doc_id) until the next one would exceed the budget:
    ``budget_tokens``, or ``budget_fraction`` of all tokens, rounded down. A
    source that runs dry leaves its share to the others.

    Cumulative sums are two-pass prefix sums over range partitions, so one hot
    source is spread over as many tasks as its size needs. Only ids, sources
    and counts are sorted, never texts.

    Defined results: a null text has 0 tokens, as has an empty one; a null
    source is a source of its own and a null doc_id an id of its own, both
    first in order; rows that repeat (source, doc_id) are one unit with the sum
    of their tokens; an empty table gives an empty queue; other columns are
    ignored. A weight must be positive, else ValueError.

    Columns: source, doc_id, tokens, virtual_finish, queue_start (tokens served
    before it).
    """
    if default_weight <= 0 or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    units = (
        docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text")).alias("tokens"))
        .groupBy("source", "doc_id")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    lined = table(prefix_sum(units, [F.col("source"), F.col("shuffle"), F.col("doc_id")], "tokens", "_before"), "lined")
    per_source = lined.groupBy("source").agg(F.min("_before").alias("_source_start"))
    weight = F.lit(float(default_weight))
    for name, w in sorted(weights.items()):
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    # One row for each source; Spark broadcasts it while it is under its threshold.
    finish = (
        lined.alias("u")
        .join(per_source.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
        .select("u.source", "u.doc_id", "tokens", "shuffle", (F.col("_before") + F.col("tokens") - F.col("_source_start")).alias("_cum"))
        .withColumn("virtual_finish", F.col("_cum").cast("double") / weight)
        .drop("_cum")
    )
    order = [F.col(c) for c in ("virtual_finish", "source", "shuffle", "doc_id")]
    queue = prefix_sum(finish, order, "tokens", "queue_start")
    if budget_tokens is None:
        total = lined.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(budget_fraction))).cast("long").alias("_budget"))
    else:
        total = docs.sparkSession.range(1).select(F.lit(int(budget_tokens)).cast("long").alias("_budget"))
    return (
        queue.crossJoin(F.broadcast(total))
        .where(F.col("queue_start") + F.col("tokens") <= F.col("_budget"))
        .select("source", "doc_id", "tokens", "virtual_finish", "queue_start")
    )


#: What the registered query and the pipeline mix to.
WEIGHTS = {"src0": 4.0, "src1": 2.0}


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose unit is in the queue. Defined
    results as ``mix``: null sources and ids are values of their own, rows that
    repeat (source, doc_id) stay or go together, null and empty texts cost
    nothing, an empty table stays empty, and columns may have any other name."""
    s, d = unused(docs.columns, "_s", "_d")
    queue = mix(docs, **options).select(F.col("source").alias(s), F.col("doc_id").alias(d))
    same = F.col("source").eqNullSafe(F.col(s)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d))
    return docs.join(queue, same, "left_semi")


SQL = r"""
WITH units AS (
  SELECT source, doc_id, CAST(sum(coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')), 0)) AS BIGINT) AS tokens
  FROM documents GROUP BY source, doc_id
), lined AS (
  SELECT source, doc_id, tokens, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM units
), finish AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY shuffle, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE)
    / CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS virtual_finish
  FROM lined
), queue AS (
  SELECT *, CAST(coalesce(sum(tokens) OVER (ORDER BY virtual_finish, source NULLS FIRST, shuffle, doc_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS queue_start
  FROM finish
)
SELECT source, doc_id, tokens, virtual_finish, queue_start FROM queue
WHERE queue_start + tokens <= (SELECT CAST(floor(sum(tokens) * 0.5::DOUBLE) AS BIGINT) FROM units)
"""
