"""Property graphs as two tables: nodes and edges built from triples with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components

#: The document key of triples known beforehand (fixed value).
EXISTING = "ExistingKG"


def ordered_triples(documents: DataFrame, additional: DataFrame | None = None) -> DataFrame:
    """Triples in ingestion order: additional ones first (doc_key ``ExistingKG``), then those of documents.

    ``documents``: head, relation, tail, doc_key, pos (a number that orders
    them); ``additional``: head, relation, tail, pos. Gives an ``ingest`` column.
    """
    out = documents.select("head", "relation", "tail", "doc_key", F.struct(F.lit(1).alias("part"), F.col("pos").cast("bigint").alias("pos")).alias("ingest"))
    if additional is not None:
        first = additional.select("head", "relation", "tail", F.lit(EXISTING).alias("doc_key"), F.struct(F.lit(0).alias("part"), F.col("pos").cast("bigint").alias("pos")).alias("ingest"))
        out = first.unionByName(out)
    return out


def triples_of_documents(documents: DataFrame) -> DataFrame:
    """Triples (head, relation, tail, doc_key, pos) of documents with entities and relations by position."""
    rel = documents.select("doc_key", "entities", F.posexplode("relations").alias("pos", "r"))
    at = lambda a: F.element_at("entities", F.col(f"r.{a}") + 1)["entity_id"]
    return rel.select(at("arg1").alias("head"), F.col("r.relation").alias("relation"), at("arg2").alias("tail"), "doc_key", "pos")


def keys_of(docs="doc_key"):
    """The distinct document keys of a group, sorted and joined by ``|``."""
    return F.array_join(F.array_sort(F.collect_set(docs)), "|")


def build_nodes(triples: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """entity_id, entity_type, name, description, doc_key_list; attributes from the first appearance.

    Triples may carry head_type / tail_type. The dictionary (entity_id,
    canonical_name, entity_type, entity_type_names, description; any but the
    first may be missing) gives names and descriptions; an id that is not in
    it is its own name with ``NO DESCRIPTION.``. The type is the stated one,
    else the dictionary's type names joined by `` | ``, else its type, else
    ``UNKNOWN``.
    """
    side = lambda c, i: triples.select(
        F.col(c).alias("entity_id"), "doc_key", F.struct("ingest", F.lit(i).alias("side")).alias("_at"), (F.col(f"{c}_type") if f"{c}_type" in triples.columns else F.lit(None).cast("string")).alias("_type")
    )
    found = side("head", 0).union(side("tail", 1)).groupBy("entity_id").agg(F.min_by("_type", "_at").alias("_type"), keys_of().alias("doc_key_list"))
    page = {c: F.lit(None).cast("string") for c in ("canonical_name", "entity_type", "description")} | {"entity_type_names": F.lit(None).cast("array<string>")}
    if dictionary is not None:
        found = found.join(dictionary.select("entity_id", *(c for c in page if c in dictionary.columns)), "entity_id", "left")
        page |= {c: F.col(c) for c in page if c in dictionary.columns}
    names = F.when(F.size(page["entity_type_names"]) > 0, F.array_join(page["entity_type_names"], " | "))
    kind = F.coalesce(F.nullif("_type", F.lit("")), names, page["entity_type"], F.lit("UNKNOWN"))
    return found.select(
        "entity_id", kind.alias("entity_type"), F.coalesce(page["canonical_name"], F.col("entity_id")).alias("name"), F.coalesce(page["description"], F.lit("NO DESCRIPTION.")).alias("description"), "doc_key_list"
    )


def build_edges(triples: DataFrame) -> DataFrame:
    """head, relation, tail, doc_key_list; one edge per (head, tail, relation)."""
    return triples.groupBy("head", "tail", "relation").agg(keys_of().alias("doc_key_list")).select("head", "relation", "tail", "doc_key_list")


def counts(triples: DataFrame) -> DataFrame:
    """One row: how many nodes and edges the triples' graph has."""
    edges = triples.select("head", "tail", "relation").distinct().agg(F.count(F.lit(1)).alias("edges"))
    nodes = triples.select(F.explode(F.array("head", "tail")).alias("id")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.crossJoin(edges).select("nodes", "edges")  # one row each


def simple_directed(triples: DataFrame) -> DataFrame:
    """One relation per ordered pair: the last in ingestion order."""
    return triples.groupBy("head", "tail").agg(F.max_by("relation", F.struct("ingest", "relation")).alias("relation"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b), a <= b."""
    return edges.select(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, relation, neighbour) in both directions, the incoming ones as ``relation#inverse``; self-loops left out."""
    out = edges.select(F.col("head").alias("node"), "relation", F.col("tail").alias("neighbour"))
    back = edges.select(F.col("tail").alias("node"), F.concat("relation", F.lit("#inverse")).alias("relation"), F.col("head").alias("neighbour"))
    return out.union(back).where("node <> neighbour")


#: Neighbours of one node that one task pairs with the others (fixed value).
NODES_A_TASK = 512


def two_hop(edges: DataFrame) -> DataFrame:
    """Distinct (node, neighbour) two steps away, the node itself left out.

    The neighbours of a hub go in parts, each against all of them. Two nodes
    can meet over several others only if both have several neighbours, so only
    such pairs are looked at for repeats; the others are never shuffled.
    """
    n = neighbours(edges).select("node", "neighbour").distinct()
    several = n.groupBy("node").agg((F.count(F.lit(1)) > 1).alias("several"))
    held = n.groupBy("neighbour").agg(F.count(F.lit(1)).alias("_held"))
    n = n.join(several, "node").join(held, "neighbour").withColumn("_parts", F.expr(f"cast(1 + (_held - 1) div {NODES_A_TASK} as int)"))
    a = n.select("node", "neighbour", "several", F.expr("pmod(xxhash64(node), _parts)").cast("int").alias("_part"))
    far = n.select(F.col("node").alias("far"), "neighbour", F.col("several").alias("_far"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    # By a shuffle: few bytes of nodes make many pairs, which need the tasks.
    met = lambda x, y: x.hint("shuffle_hash").join(y, ["neighbour", "_part"]).where("node <> far").select("node", F.col("far").alias("neighbour"))
    both = met(a.where("several"), far.where("_far")).distinct()
    return both.union(met(a.where("NOT several"), far)).union(met(a.where("several"), far.where("NOT _far")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of the multigraph: parallel edges count each, a self-loop twice."""
    return edges.select(F.explode(F.array("head", "tail")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is connected."""
    return connected_components(edges, "head", "tail")


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the largest component (ties: the smaller label)."""
    parts = components(edges)
    top = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return parts.join(F.broadcast(top.select("component")), "component").select("node")  # one row


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose ends both belong to the community: community_id beside the edge's columns. ``members``: community_id, node."""
    heads = edges.join(members.withColumnRenamed("node", "head"), "head")
    return heads.join(members.withColumnRenamed("node", "tail"), ["community_id", "tail"])


def merge_nodes(old: DataFrame, new: DataFrame, key: str = "entity_id") -> DataFrame:
    """Upsert by key: rows of ``new`` replace those of ``old``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def rank_within(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
