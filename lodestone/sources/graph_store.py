"""A property graph kept as a folder of commits: merged into, listed, deleted.

Each merge is a commit of its own name, written as a whole or not at all, so a
merge that is run again replaces itself. Reading resolves the commits: of an
entity or edge that several hold, the one of the greatest name counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_KEY, EDGE_KEY = ["entity_id"], ["head", "relation", "tail"]


class GraphStore:
    """The graph below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, *parts: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """The names of all whole commits, in order."""
        where, fs = self._folder("nodes")
        if not fs.exists(where):
            return []
        names = [x.getPath().getName().removeprefix("commit=") for x in fs.listStatus(where)]
        return sorted(n for n in names if all(fs.exists(self._folder(kind, f"commit={n}", "_SUCCESS")[0]) for kind in ("nodes", "edges")))

    def merge(self, nodes: DataFrame, edges: DataFrame, commit: str) -> None:
        """Add nodes (entity_id and attributes) and edges (head, relation, tail and attributes) under the commit's name; rows of one key once, those without a key not at all."""
        if not commit or not all(c.isalnum() or c in "_.-" for c in commit):
            raise ValueError("a commit is named by letters, digits, '_', '.' and '-'")
        for kind, rows, key in (("edges", edges, EDGE_KEY), ("nodes", nodes, NODE_KEY)):
            known = rows.dropna(subset=key).dropDuplicates(key)
            known.write.mode("overwrite").parquet(f"{self.path}/{kind}/commit={commit}")

    def _read(self, kind: str, key: list[str]) -> DataFrame:
        names = self.commits()
        if not names:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in key))
        paths = [f"{self.path}/{kind}/commit={n}" for n in names]
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").option("mergeSchema", True).parquet(*paths)
        attributes = [c for c in rows.columns if c not in (*key, "commit")]
        last = F.max_by(F.struct(*attributes), F.col("commit").cast("string")).alias("_a") if attributes else F.count(F.lit(1)).alias("_n")
        return rows.groupBy(*key).agg(last).select(*key, *(F.col(f"_a.{c}").alias(c) for c in attributes))

    def nodes(self) -> DataFrame:
        return self._read("nodes", NODE_KEY)

    def edges(self) -> DataFrame:
        """Edges whose ends are both nodes of the graph."""
        found = self._read("edges", EDGE_KEY)
        known = self.nodes().select("entity_id")
        for end in ("head", "tail"):
            found = found.join(known.withColumnRenamed("entity_id", end), end, "left_semi")
        return found.select(*EDGE_KEY, *(c for c in found.columns if c not in EDGE_KEY))

    def listing(self) -> DataFrame:
        """(kind, name, n): how many nodes of each type and edges of each relation there are."""
        nodes = self.nodes()
        kind = F.coalesce("entity_type", F.lit("UNKNOWN")) if "entity_type" in nodes.columns else F.lit("UNKNOWN")
        a = nodes.groupBy(kind.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
        b = self.edges().groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
        return a.unionByName(b)

    def delete_all(self) -> None:
        """Remove the graph; a store that is empty stays so."""
        for kind in ("nodes", "edges"):
            where, fs = self._folder(kind)
            fs.delete(where, True)
