"""Global prefix sums in two passes: local sums in range partitions, then the
partitions' totals, of which there are only as many as partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import table
from .memory import Kernel, released


def _running(column: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            values = np.asarray(batch.column(column).to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = np.cumsum(values) + total
            if len(values):
                total = int(ends[-1])
            yield batch.append_column(out, pa.array(ends - values, pa.int64()))

    return run


def range_sorted(df: DataFrame, order: list[Column], value: str, then: Kernel | None = None, schema: str = "", within: tuple[Column, ...] = ()) -> DataFrame:
    """``df`` range-sorted, mapped by the kernel ``then`` to ``schema`` (in the
    same Python worker; it must keep the order of rows) and written, with
    ``part`` (the range partition) and ``local_start`` (sum of ``value`` before
    the row, in its partition). Finding the ranges sends a sample of ``order``
    to the driver, so wide columns that only break ties belong in ``within``."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order, *within)
    sums = _running(value, "local_start")
    fields = T.StructType.fromDDL(schema).fields if then else ranged.schema.fields
    mapped = ranged.mapInArrow(released(lambda batches: sums(then(batches) if then else batches)), T.StructType([*fields, T.StructField("local_start", T.LongType())]))
    return table(mapped.withColumn("part", F.spark_partition_id()), "ranged")


def starts(ranged: DataFrame, value: str, out: str = "start") -> DataFrame:
    """Turn ``local_start`` into the global sum before each row. The totals are
    one row for each range partition, so their window and broadcast stay small."""
    totals = ranged.groupBy("part").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "part")
        .withColumn(out, F.col("_offset") + F.col("local_start"))
        .drop("part", "local_start", "_offset")
    )


def prefix_sum(df: DataFrame, order: list[Column], value: str, out: str = "start") -> DataFrame:
    """``df`` with ``out``: the sum of the non-negative integers ``value`` over
    all rows before this one in ``order``, which must not leave ties."""
    return starts(range_sorted(df, order, value), value, out)
