"""A property graph kept up to date from a stream of triples.

All state is that of built-in stateful operators. Edges, and the document keys
of nodes, are rows whose repeats are dropped by state, one small entry each, so
a hub's state is never one large value. First appearances are a running least
for each entity. What is new goes to append-only tables; the graph is what those
tables add up to, and equals the batch graph however the triples were split into
batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import graph

#: The state store that keeps its entries on disk.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

APPEARANCE = "entity_id string, entity_type string, part int, pos bigint, side int, doc_key string"
EDGE = "head string, relation string, tail string, doc_key string"


def appearances(triples: DataFrame) -> DataFrame:
    """Each end of each triple (head, relation, tail, doc_key, ingest; perhaps head_type and tail_type) as a row of APPEARANCE."""
    ends = []
    for side, c in enumerate(("head", "tail")):
        kind = F.col(f"{c}_type") if f"{c}_type" in triples.columns else F.lit(None)
        ends.append(F.struct(F.col(c).alias("entity_id"), kind.cast("string").alias("entity_type"), F.col("ingest.part").cast("int").alias("part"), F.col("ingest.pos").cast("bigint").alias("pos"), F.lit(side).alias("side"), F.col("doc_key").cast("string").alias("doc_key")))
    return triples.select(F.explode(F.array(*ends)).alias("e")).select("e.*").where("entity_id IS NOT NULL")


def key_changes(triples: DataFrame) -> DataFrame:
    """A stream with one appearance (any) for each distinct entity_id and doc_key."""
    return appearances(triples).where("doc_key IS NOT NULL").dropDuplicates(["entity_id", "doc_key"])


def first_appearances(triples: DataFrame) -> DataFrame:
    """A stream (update mode) of the first appearance of each entity so far, without a document key."""
    least = F.min_by(F.struct("entity_type", "part", "pos", "side"), F.struct("part", "pos", "side")).alias("_first")
    return appearances(triples).groupBy("entity_id").agg(least).select("entity_id", "_first.*", F.lit(None).cast("string").alias("doc_key"))


def edge_changes(triples: DataFrame) -> DataFrame:
    """A stream of the distinct (head, relation, tail, doc_key)."""
    return triples.select("head", "relation", "tail", F.col("doc_key").cast("string").alias("doc_key")).dropDuplicates(["head", "relation", "tail", "doc_key"])


def start_upserts(triples: DataFrame, path: str, initial: DataFrame | None = None, trigger: dict | None = None, what: tuple[str, ...] = ("nodes", "edges")) -> list[StreamingQuery]:
    """Queries that append the changes of nodes (two queries) and edges (one) below ``path``; ``initial`` triples are the graph to start from.

    Checkpoints are below ``path`` too: queries started again go on where the
    last ones stopped, and a batch that is run again writes nothing twice.
    """
    spark = triples.sparkSession
    if initial is not None and "nodes" in what and not _there(spark, f"{path}/nodes/initial"):
        appearances(initial).write.mode("overwrite").parquet(f"{path}/nodes/initial")
    if initial is not None and "edges" in what and not _there(spark, f"{path}/edges/initial"):
        edge_changes(initial).write.mode("overwrite").parquet(f"{path}/edges/initial")

    def updated(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/nodes/first/batch={n}")

    started = []
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)  # a query keeps the settings that it was started with
    appended = lambda changes, name: changes.writeStream.format("parquet").outputMode("append").option("path", f"{path}/{name}/stream")
    writers = {}
    if "nodes" in what:
        writers["nodes"] = appended(key_changes(triples), "nodes")
        writers["first"] = first_appearances(triples).writeStream.outputMode("update").foreachBatch(updated)
    if "edges" in what:
        writers["edges"] = appended(edge_changes(triples), "edges")
    for name, writer in writers.items():
        started.append(writer.option("checkpointLocation", f"{path}/checkpoints/{name}").trigger(**(trigger or {"availableNow": True})).start())
    spark.conf.set(STORE[0], before) if before is not None else spark.conf.unset(STORE[0])
    return started


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the initial graph and the stream have written, under ``schema``."""
    out = spark.createDataFrame([], schema)
    for part in ("initial", "stream", "first"):
        if _there(spark, f"{path}/{part}"):
            out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/{part}").select(out.columns))
    return out


def nodes_now(spark: SparkSession, path: str, dictionary: DataFrame | None = None) -> DataFrame:
    """The nodes that the changes add up to, as ``graph.build_nodes`` has them."""
    rows = _changes(spark, f"{path}/nodes", APPEARANCE)
    # Each change is one end of a triple; the other end plays no part.
    ends = rows.select(F.col("entity_id").alias("head"), F.col("entity_id").alias("tail"), F.col("entity_type").alias("head_type"), F.col("entity_type").alias("tail_type"), "doc_key", F.struct("part", "pos", "side").alias("ingest"))
    return graph.build_nodes(ends, dictionary)


def edges_now(spark: SparkSession, path: str) -> DataFrame:
    """The edges that the changes add up to, as ``graph.build_edges`` has them."""
    return graph.build_edges(_changes(spark, f"{path}/edges", EDGE))
