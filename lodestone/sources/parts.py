"""Files of many parts: each task writes whole documents, and lines know their place in the input."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_framed(lines: DataFrame, path: str, first: str, last: str, between: str = "", extension: str = "") -> None:
    """Write ``lines`` (value) as text files that each begin with ``first`` and end with ``last``, each but the last line of a part followed by ``between``.

    Parts are complete documents, written by their tasks and made visible
    together by the writer's commit; a task that runs again changes nothing.
    A part without lines is no file, or an empty one; an empty table is one
    document without lines.
    """

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if held is None:
                    yield pa.RecordBatch.from_arrays([pa.array([first])], names=["value"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([held + between])], names=["value"])
                held = line
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held, last])], names=["value"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of ``framed`` in batches of some thousand."""
        held: list[pa.RecordBatch] = []
        for b in framed(batches):
            held.append(b)
            if len(held) == 4096:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    out = lines.select("value").mapInArrow(gathered, "value string")
    if lines.isEmpty():
        out = lines.sparkSession.range(1).select(F.lit(f"{first}\n{last}").alias("value"))
    out.write.mode("overwrite").text(path)


def in_file_order(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """``rows``, read from files, with ``n``, their number (from 0) in the order of files and places; only those for which ``keep`` holds.

    Rows are numbered within each split of a file; only the splits' counts, a
    row each, are summed over the whole.
    """
    marked = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    if keep is not None:
        marked = marked.where(keep)
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    held = marked.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_k"))
    held = held.select("_file", "_start", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_at")) - 1
    return marked.withColumn("_in", inside).join(held, ["_file", "_start"]).withColumn("n", F.col("_before") + F.col("_in")).drop("_file", "_start", "_at", "_in", "_before")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``n``, their number (from 0) in the order of a column of distinct values; no task sorts more than its range of them."""
    from lodestone.plans.staging import stage

    ranges = stage(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    held = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = held.select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranges.withColumn("_in", inside).join(held, "_part").withColumn("n", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
