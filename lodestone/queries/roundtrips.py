"""Tables written by the sinks and read again by the readers: the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph
from lodestone.queries import graphs
from lodestone.queries.base import query, table
from lodestone.queries.indexes import fresh_path
from lodestone.sources import corpora, graphml, readers, sinks
from lodestone.sources.graph_store import GraphStore


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer")
def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_mktsegment")
    where = fresh_path(spark, "json")
    sinks.write_json_array(rows, where, ["c_custkey"])
    return readers.read_json(spark, where, rows.schema)


@query("SELECT doc_id, text, source FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    where = fresh_path(spark, "jsonl")
    sinks.write_jsonl(rows, where)
    return readers.read_jsonl(spark, where, rows.schema)


@query("SELECT p_type AS word, (row_number() OVER (ORDER BY p_type))::INT AS id, n AS freq FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)")
def vocabulary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    counted = readers.vocabulary(p, "p_type", "-").where("id > 0").join(p.groupBy(F.col("p_type").alias("word")).agg(F.count(F.lit(1)).alias("freq")), "word")
    where = fresh_path(spark, "vocabulary")
    sinks.write_vocabulary(counted, where)
    return readers.read_vocabulary(spark, where)


@query(f"WITH {graphs.NODES_SQL} SELECT entity_id, entity_type, name, nullif(description, '') AS description, doc_key_list FROM nodes")
def graphml_nodes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graphs.triples(spark, sf_dir)
    where = fresh_path(spark, "graphml")
    graphml.write_graphml(graph.build_nodes(t, graphs.dictionary(spark, sf_dir)), graph.build_edges(t), where)
    return graphml.read_graphml(spark, where)[0].withColumn("description", F.nullif("description", F.lit("")))


@query(f"WITH {graphs.EDGES_SQL} SELECT * FROM edges")
def graphml_edges_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graphs.triples(spark, sf_dir)
    where = fresh_path(spark, "graphml")
    graphml.write_graphml(graph.build_nodes(t), graph.build_edges(t), where)
    return graphml.read_graphml(spark, where)[1]


@query(
    f"""WITH {graphs.NODES_SQL} SELECT 'node' AS kind, entity_type AS name, count(*) AS n FROM nodes GROUP BY entity_type
    UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY relation"""
)
def graph_store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph merged into a store in two commits, one of them twice, and listed."""
    t = graphs.triples(spark, sf_dir)
    nodes, edges = graph.build_nodes(t, graphs.dictionary(spark, sf_dir)), graph.build_edges(t)
    store = GraphStore(spark, fresh_path(spark, "graph-store"))
    late = F.col("relation") == "returned"
    for commit in ("1", "1", "2"):
        store.merge(nodes, edges.where(~late if commit == "1" else late), commit)
    return store.listing()


@query(
    r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)
    SELECT 'ID' || (row_number() OVER (ORDER BY item_id) - 1) AS doc_key, 0 AS sent_idx, unnest(w) AS token, unnest(range(len(w)))::INT AS idx, 'B-T' || (len(w) % 3) AS tag FROM w"""
)
def conll_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    lines = F.array_join(F.transform("w", lambda x: F.concat(x, F.lit(" X Y B-T"), (F.size("w") % 3).cast("string"))), "\n")
    where = fresh_path(spark, "conll")
    b.repartitionByRange("item_id").sortWithinPartitions("item_id").select(F.concat(F.lit("-DOCSTART- -X- O O\n\n"), lines, F.lit("\n"))).write.text(where)
    return corpora.read_conll(spark, where).select("doc_key", "sent_idx", F.col("idx").cast("int").alias("idx"), "token", "tag")


@query("SELECT o_orderkey // 1000 AS \"group\", count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def grouped_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = fresh_path(spark, "grouped")
    sinks.write_grouped(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), where, "o_orderkey", 1000)
    out = spark.read.schema("o_orderkey bigint, o_orderstatus string, group bigint").json(where)
    return out.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT s_suppkey::VARCHAR AS key, s_name AS name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def pipes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    where = fresh_path(spark, "pipes")
    s.select(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name", "n_name", F.lit(""))).write.text(where)
    return readers.read_rrf(spark, where, ["key", "name", "nation"])


@query(
    """WITH b AS (SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark)
    SELECT item_id::VARCHAR AS doc_key, 'Item ' || item_id AS title, t AS text, length('Item ' || item_id) + 1 AS "begin", length('Item ' || item_id) + 6 AS "end", substr(t, 1, 5) AS name, 'Start' AS entity_type, 'C' || item_id AS entity_id
    FROM b WHERE length(t) >= 5 AND NOT contains(t, '|') AND NOT contains(t, chr(9))"""
)
def pubtator_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as records of title, text and a mention of their first five characters; items with separators in their text cannot be records."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("k"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    b = b.where((F.length("t") >= 5) & ~F.contains("t", F.lit("|")) & ~F.contains("t", F.lit("\t")))
    title = F.concat(F.lit("Item "), "k")
    first = F.length(title) + 1
    mention = F.concat_ws("\t", "k", first.cast("string"), (first + 5).cast("string"), F.substring("t", 1, 5), F.lit("T1"), F.concat(F.lit("UMLS:C"), "k"))
    where = fresh_path(spark, "pubtator")
    b.select(F.concat_ws("\n", F.concat("k", F.lit("|t|"), title), F.concat("k", F.lit("|a|"), "t"), mention, F.lit(""))).write.text(where)
    m = corpora.read_pubtator(spark, where, {"T1": "Start"}).select("doc_key", "title", "text", F.explode("mentions").alias("m"))
    span = F.col("m.span")
    return m.select("doc_key", "title", "text", F.get(span, F.lit(0)).cast("bigint").alias("begin"), (F.get(span, F.lit(1)) + 1).cast("bigint").alias("end"), "m.name", "m.entity_type", "m.entity_id")
