"""Writers: JSON, vocabularies, vector indexes, snapshots, grouped files, graph databases."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.parts import write_framed


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """Indented JSON arrays, one a part; parts by name, and rows in them, follow ``order``. Nulls are written out."""
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order)
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})
    write_framed(lines.select(F.concat(F.lit("    "), F.replace(body, F.lit("\n"), F.lit("\n    "))).alias("value")), path, "[", "]", ",")


def write_vocabulary(df: DataFrame, path: str) -> None:
    """word, id (and freq) as tab-separated lines; parts by name, and lines in them, follow the ids."""
    cols = [c for c in ("word", "id", "freq") if c in df.columns]
    df.select(*cols).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def write_grouped(df: DataFrame, path: str, index: str, group_size: int) -> None:
    """Folders ``group=k`` of ``group_size`` consecutive rows each."""
    df.withColumn("group", F.floor(F.col(index) / group_size)).write.mode("overwrite").partitionBy("group").json(path)


def save_vectors(df: DataFrame, path: str) -> None:
    """A vector index: ids, vectors and metadata as one table."""
    df.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_snapshot(path: str, spark: SparkSession, config: dict, **tables: DataFrame) -> None:
    """A component's settings and tables below one folder."""
    spark.range(1).select(F.lit(json.dumps(config)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/config")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(path: str, spark: SparkSession, *tables: str) -> tuple[dict, dict[str, DataFrame]]:
    config = json.loads(spark.read.text(f"{path}/config", wholetext=True).first()[0])
    return config, {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def write_property_graph(nodes: DataFrame, edges: DataFrame, connect: Callable[[], Callable[[str, Iterable[dict]], None]], batch: int = 1000) -> None:
    """Merge nodes, then relations, into a graph database, partition by partition.

    ``connect`` runs on the executors and returns ``send(kind, rows)``, which
    must merge by key, so that a task that is run again changes nothing.
    """

    def sender(kind: str):
        def send_rows(rows) -> None:
            send, held = connect(), []
            for r in rows:
                held.append(r.asDict())
                if len(held) >= batch:
                    send(kind, held)
                    held = []
            if held:
                send(kind, held)

        return send_rows

    nodes.dropDuplicates(["entity_id"]).foreachPartition(sender("node"))
    edges.dropDuplicates(["head", "relation", "tail"]).foreachPartition(sender("edge"))
