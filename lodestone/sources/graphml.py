"""GraphML as a data source for reading, and as files for writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.parts import write_framed

NODE = "entity_id string, entity_type string, name string, description string, doc_key_list string"


def _rows(spark: SparkSession, path: str, tag: str, attributes: str) -> DataFrame:
    data = "data array<struct<_key:string,_VALUE:string>>"
    return spark.read.format("xml").option("rowTag", tag).schema(f"{attributes}, {data}").load(path)


def _keys(spark: SparkSession, path: str) -> dict[tuple[str, str], str]:
    """(element kind, attribute name) to the key that the file uses for it."""
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, _for string, `_attr.name` string").load(path)
    return {(r[1], r[2]): r[0] for r in keys.collect()}  # a few declarations


def _value(key: str | None):
    found = F.try_element_at(F.filter("data", lambda d: d["_key"] == F.lit(key)), F.lit(1))["_VALUE"]
    return found if key else F.lit(None).cast("string")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (head, relation, tail, doc_key_list) of a GraphML file."""
    keys = _keys(spark, path)
    nodes = _rows(spark, path, "node", "_id string")
    nodes = nodes.select(F.col("_id").alias("entity_id"), *(_value(keys.get(("node", a))).alias(a) for a in ("entity_type", "name", "description", "doc_key_list")))
    edges = _rows(spark, path, "edge", "_source string, _target string, _id string")
    edges = edges.select(F.col("_source").alias("head"), F.coalesce(_value(keys.get(("edge", "relation"))), F.col("_id")).alias("relation"), F.col("_target").alias("tail"), _value(keys.get(("edge", "doc_key_list"))).alias("doc_key_list"))
    return nodes, edges


NODE_KEYS = {"entity_id": "d0", "entity_type": "d1", "name": "d2", "description": "d3", "doc_key_list": "d4"}
EDGE_KEYS = {"relation": "d5", "doc_key_list": "d6"}


def _escaped(value: Column) -> Column:
    """Text as XML has it, quotes included."""
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        value = F.replace(value, F.lit(plain), F.lit(written))
    return value


def graphml_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): a line for each node and edge."""

    def data(keys: dict[str, str], columns: list[str]) -> list[Column]:
        return [F.coalesce(F.concat(F.lit(f'<data key="{key}">'), _escaped(F.col(name).cast("string")), F.lit("</data>")), F.lit("")) for name, key in keys.items() if name in columns]

    named = lambda c: F.concat(F.lit('"'), _escaped(F.col(c)), F.lit('"'))
    n = nodes.select(F.concat(F.lit("<node id="), named("entity_id"), F.lit(">"), *data(NODE_KEYS, nodes.columns), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit("<edge source="), named("head"), F.lit(" target="), named("tail"), F.lit(" id="), named("relation"), F.lit(">"), *data(EDGE_KEYS, edges.columns), F.lit("</edge>")).alias("value"))
    return n.unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of GraphML documents, each written by one task; together they are the graph, and ``read_graphml`` reads them as one."""
    keys = [f'<key id="{key}" for="{kind}" attr.name="{name}" attr.type="string"/>' for kind, of in (("edge", EDGE_KEYS), ("node", NODE_KEYS)) for name, key in of.items()]
    first = "\n".join(['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">'])
    write_framed(graphml_elements(nodes, edges), path, first, "</graph>\n</graphml>")
