"""Knowledge-base tables over the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import filters, kb, linking
from lodestone.queries import graphs
from lodestone.queries.base import query, table


def concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as concepts and their parts' names as concept names, those of medium size preferred."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("CUI"), F.col("p_name").alias("STR"), F.when(F.col("p_size") > 5, "P").otherwise("S").alias("TS"), F.when(F.col("p_size") < 15, "Y").otherwise("N").alias("ISPREF"), F.lit("PF").alias("STT"))


@query(
    """WITH c AS (SELECT p_brand AS id, min(p_name) FILTER (p_size > 5 AND p_size < 15) AS name FROM part GROUP BY 1)
    SELECT id AS entity_id, name AS canonical_name, coalesce((SELECT string_agg(DISTINCT p_name, '|' ORDER BY p_name) FROM part WHERE p_brand = id AND p_name <> name), '') AS synonyms FROM c WHERE name IS NOT NULL"""
)
def concept_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.concept_dictionary(concept_names(spark, sf_dir)).withColumn("synonyms", F.array_join("synonyms", "|"))


@query(
    """SELECT p_brand AS entity_id, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS entity_type_names, string_agg(DISTINCT p_size::VARCHAR, '|' ORDER BY p_size::VARCHAR) AS tree_numbers,
    string_agg(p_name, ' | ' ORDER BY p_partkey) AS description FROM part GROUP BY 1"""
)
def concept_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ids = p.select(F.col("p_brand").alias("entity_id")).distinct()
    types = p.select(F.col("p_brand").alias("CUI"), F.col("p_type").alias("TUI"), F.col("p_type").alias("STY"), F.col("p_size").cast("string").alias("STN"))
    out = kb.with_definitions(kb.with_types(ids, types), p.select(F.col("p_brand").alias("CUI"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("DEF")))
    return out.select("entity_id", F.array_join("entity_type_names", "|").alias("entity_type_names"), F.array_join("tree_numbers", "|").alias("tree_numbers"), "description")


@query(
    f"""WITH {graphs.EDGES_SQL} SELECT DISTINCT tail AS head, 'supply' AS relation, head AS tail FROM edges WHERE relation = 'returned' UNION SELECT head, 'place', tail FROM edges WHERE relation = 'located_in'"""
)
def relation_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators import graph

    pairs = (("returned", "supply#inverse"), ("located_in", "place"), ("part_of", "place#negative"))
    mapping = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("relation"), F.lit(b).alias("label")) for a, b in pairs))))
    return kb.mapped_relations(graph.build_edges(graphs.triples(spark, sf_dir)), mapping, ignored=("supplies",))


@query("SELECT 'S' || l_suppkey AS head, l_returnflag AS relation, 'P' || l_partkey AS tail, l_linestatus AS source FROM lineitem WHERE l_returnflag <> 'N'")
def relation_table_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("CUI1"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("RELA"), F.concat(F.lit("S"), "l_suppkey").alias("CUI2"), F.col("l_linestatus").alias("SAB")
    )
    return kb.relation_triples(l)


@query("SELECT 'O' || l_orderkey AS doc_key, string_agg(DISTINCT e, '|' ORDER BY e) AS entity_ids, count(DISTINCT (s, l_returnflag, p))::INT AS n_relations FROM (SELECT l_orderkey, l_returnflag, 'S' || l_suppkey AS s, 'P' || l_partkey AS p, unnest(['S' || l_suppkey, 'P' || l_partkey]) AS e FROM lineitem) GROUP BY 1")
def documents_from_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("doc_key"), F.concat(F.lit("S"), "l_suppkey").alias("head"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("P"), "l_partkey").alias("tail"))
    out = kb.documents_of_triples(t)
    return out.select("doc_key", F.array_join("entity_ids", "|").alias("entity_ids"), F.size("relations").alias("n_relations"))


@query("SELECT p_type AS type, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def identifier_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kb.identifier_map(table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("brand")), "type", "brand")
    return out.select("type", F.array_join("brands", "|").alias("brands"))


@query("SELECT conv_id, turn, split_part(text, chr(10), 1) AS title FROM conversations")
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_key"), F.split("text", "\n").alias("sentences"))
    return kb.passages_of_documents(docs).select("doc_key.conv_id", "doc_key.turn", "title")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text) AND d.lang <> 'en')")
def questions_with_known_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.queries import evaluation

    contexts = evaluation.gold_contexts_of(spark, sf_dir).withColumnRenamed("doc_id", "context_id")
    allowed = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("context_id"))
    return filters.all_contexts_known(table(spark, sf_dir, "benchmark").select("item_id"), contexts, allowed, key="item_id")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'gold' ELSE 'distant' END AS kind FROM labels")
def context_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", filters.annotation_kind(F.col("quality") * 1000).alias("kind"))


@query("SELECT p_partkey, 4 AS n, 'E' || (CASE WHEN p_partkey % 3 = 0 THEN 'x' WHEN p_partkey % 3 = 1 THEN 'x' ELSE 'b' END) AS last FROM part")
def padded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of one to two candidates, the gold one put first, filled up to four."""
    c = lambda x: F.struct(F.lit(x).alias("entity_id"), F.lit(1.0).alias("score"))
    k = F.col("p_partkey") % 3
    lists = F.when(k == 0, F.array(c("x"))).when(k == 1, F.array(c("x"), c("a"))).otherwise(F.array(c("b")))
    gold = F.struct(F.when(k == 2, "b").otherwise("a").alias("entity_id"), F.lit(1.0).alias("score"))
    full = linking.padded(linking.gold_first(lists, gold, 3), 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(full).alias("n"), F.concat(F.lit("E"), F.element_at(full, -1)["entity_id"]).alias("last"))
