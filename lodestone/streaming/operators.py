"""The operators that run incrementally: chunks, edges, windowed counts, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import chunking
from lodestone.operators.text_index import TextIndex


def chunk_stream(passages: DataFrame, window: int) -> DataFrame:
    """Stateless: each passage's chunks as it arrives."""
    return chunking.chunk_passages(passages, window)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Counts and sums per tumbling or sliding window and kind. Rows later than ``late`` are dropped by the watermark."""
    at = events.withColumn(time, F.col(time).cast("timestamp"))
    if late:
        at = at.withWatermark(time, late)
    return at.groupBy(F.window(time, size, slide) if slide else F.window(time, size), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Counts per session of a user."""
    at = events.withColumn(time, F.col(time).cast("timestamp"))
    if late:
        at = at.withWatermark(time, late)
    return at.groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n"))


def edge_stream(triples: DataFrame) -> DataFrame:
    """Running edges with the number of triples behind each (update mode)."""
    return triples.groupBy("head", "relation", "tail").agg(F.count(F.lit(1)).alias("n"))


def query_stream(queries: DataFrame, index: TextIndex, query: str, k: int, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Arriving queries (``query``, terms) against a saved index: the ``k`` best passages of each, a folder ``batch=n`` of ``path`` for each batch.

    The index is read, never made anew; segments added between batches count
    from the next one. A batch that is run again replaces its own folder.
    """

    def answer(batch: DataFrame, n: int) -> None:
        index.search(batch, query, k).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
