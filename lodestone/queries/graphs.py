"""Graph construction, neighbourhoods, communities and reports over triples drawn from the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import community, filters, graph, kb, metrics, questions, reports
from lodestone.queries.base import query, table


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples known beforehand: where suppliers and nations lie."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    a = s.select(F.concat(F.lit("S"), "s_suppkey").alias("head"), F.lit("located_in").alias("relation"), F.concat(F.lit("N"), "s_nationkey").alias("tail"), F.col("s_suppkey").cast("bigint").alias("pos"))
    b = n.select(
        F.concat(F.lit("N"), "n_nationkey").alias("head"), F.lit("part_of").alias("relation"), F.concat(F.lit("R"), "n_regionkey").alias("tail"), (F.col("n_nationkey") + 10_000_000).cast("bigint").alias("pos")
    )
    return a.union(b)


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of documents: each order says which supplier supplies which part."""
    return sold_of(table(spark, sf_dir, "lineitem"))


def sold_of(items: DataFrame) -> DataFrame:
    return items.select(
        F.concat(F.lit("S"), "l_suppkey").alias("head"),
        F.when(F.col("l_returnflag") == "R", "returned").otherwise("supplies").alias("relation"),
        F.concat(F.lit("P"), "l_partkey").alias("tail"),
        F.concat(F.lit("O"), "l_orderkey").alias("doc_key"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("pos"),
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity pages of parts, regions and every supplier whose key is not divisible by 5."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.lit(None).cast("string").alias("entity_type"), F.array("p_brand", "p_type").alias("entity_type_names"), F.concat(F.lit("size "), "p_size").alias("description"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0")
    s = s.select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), F.lit("Supplier").alias("entity_type"), F.array().cast("array<string>").alias("entity_type_names"), F.lit("").alias("description"))
    return p.union(s)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ordered_triples(sold(spark, sf_dir), existing(spark, sf_dir))


TRIPLES_SQL = """
ex AS (
  SELECT 'S' || s_suppkey AS head, 'located_in' AS relation, 'N' || s_nationkey AS tail, 'ExistingKG' AS doc_key, 0 AS part, s_suppkey::BIGINT AS pos FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'part_of', 'R' || n_regionkey, 'ExistingKG', 0, n_nationkey + 10000000 FROM nation
), t AS (
  SELECT * FROM ex UNION ALL
  SELECT 'S' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'supplies' END, 'P' || l_partkey, 'O' || l_orderkey, 1, l_orderkey * 10 + l_linenumber FROM lineitem
)"""
EDGES_SQL = TRIPLES_SQL + """, edges AS (
  SELECT head, relation, tail, string_agg(DISTINCT doc_key, '|' ORDER BY doc_key) AS doc_key_list FROM t GROUP BY head, relation, tail
)"""
NODES_SQL = EDGES_SQL + """, ids AS (
  SELECT id, string_agg(DISTINCT doc_key, '|' ORDER BY doc_key) AS doc_key_list FROM (SELECT head AS id, doc_key FROM t UNION ALL SELECT tail, doc_key FROM t) GROUP BY id
), nodes AS (
  SELECT id AS entity_id,
    CASE WHEN p_partkey IS NOT NULL THEN p_brand || ' | ' || p_type WHEN s_suppkey IS NOT NULL THEN 'Supplier' ELSE 'UNKNOWN' END AS entity_type,
    coalesce(p_name, s_name, id) AS name,
    CASE WHEN p_partkey IS NOT NULL THEN 'size ' || p_size WHEN s_suppkey IS NOT NULL THEN '' ELSE 'NO DESCRIPTION.' END AS description, doc_key_list
  FROM ids LEFT JOIN part ON id = 'P' || p_partkey LEFT JOIN supplier ON id = 'S' || s_suppkey AND s_suppkey % 5 <> 0
)"""


@query(f"WITH {NODES_SQL} SELECT * FROM nodes")
def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_nodes(triples(spark, sf_dir), dictionary(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT * FROM edges")
def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(triples(spark, sf_dir))


@query(f"WITH {NODES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def kg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    return graph.counts(t)


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT least(head, tail) AS a, greatest(head, tail) AS b FROM t")
def kg_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(triples(spark, sf_dir))


@query(f"WITH {TRIPLES_SQL} SELECT head, tail, string_agg(DISTINCT relation, '|' ORDER BY relation) AS relations FROM t GROUP BY head, tail")
def pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kb.relations_of_pairs(triples(spark, sf_dir))
    return out.withColumn("relations", F.array_join("relations", "|"))


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT head, relation, tail FROM (SELECT * FROM t UNION ALL SELECT * FROM t WHERE part = 1)")
def triples_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir).select("head", "relation", "tail", "ingest")
    return metrics.without_repeats(t.unionByName(t.where("ingest.part = 1")), ["head", "relation", "tail"]).drop("ingest")


@query(f"WITH {TRIPLES_SQL} SELECT head, tail, arg_max(relation, part * 1000000000000 + pos) AS relation FROM t GROUP BY head, tail")
def kg_simple_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.simple_directed(triples(spark, sf_dir))


NEIGHBOURS_SQL = EDGES_SQL + """, nb AS (
  SELECT head AS node, relation, tail AS neighbour FROM edges WHERE head <> tail UNION ALL SELECT tail, relation || '#inverse', head FROM edges WHERE head <> tail
)"""


@query(f"WITH {NEIGHBOURS_SQL} SELECT node, relation, count(*) AS n, min(neighbour) AS first, max(neighbour) AS last FROM nb GROUP BY node, relation")
def kg_neighbours_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.neighbours(graph.build_edges(triples(spark, sf_dir)))
    return n.groupBy("node", "relation").agg(F.count(F.lit(1)).alias("n"), F.min("neighbour").alias("first"), F.max("neighbour").alias("last"))


@query(
    """WITH e AS (SELECT 'S' || s_suppkey AS a, 'N' || s_nationkey AS b FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
    n AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT DISTINCT x.a AS node, y.b AS neighbour FROM n x JOIN n y ON x.b = y.a WHERE x.a <> y.b"""
)
def kg_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_hop(existing(spark, sf_dir))


@query(f"WITH {EDGES_SQL}, d AS (SELECT node, count(*) AS degree FROM (SELECT head AS node FROM edges UNION ALL SELECT tail FROM edges) GROUP BY node) SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 100")
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.primary_nodes(graph.build_edges(triples(spark, sf_dir)), 100)


MEMBERS_SQL = NEIGHBOURS_SQL + """, mem AS (
  SELECT DISTINCT 'Community(' || node || ')' AS community_id, neighbour AS node FROM nb UNION SELECT 'Community(' || node || ')', node FROM nb
)"""


@query(f"WITH {MEMBERS_SQL} SELECT community_id, count(*)::INT AS size, string_agg(node, '|' ORDER BY node) AS nodes FROM mem GROUP BY community_id")
def community_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = community._records(community.neighbourhood_members(graph.build_edges(triples(spark, sf_dir))))
    return records.select("community_id", F.size("nodes").alias("size"), F.array_join("nodes", "|").alias("nodes"))


@query(f"WITH {EDGES_SQL} SELECT 'Community(' || head || ',' || relation || ',' || tail || ')' AS community_id, least(head, tail) || '|' || greatest(head, tail) AS nodes FROM edges")
def community_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = community._records(community.triple_members(graph.build_edges(triples(spark, sf_dir))))
    return records.select("community_id", F.array_join("nodes", "|").alias("nodes"))


@query(f"WITH {MEMBERS_SQL}, z AS (SELECT community_id, count(*) AS n FROM mem GROUP BY 1) SELECT count(*) AS communities, min(n)::INT AS min_size, max(n)::INT AS max_size, round(avg(n), 6) AS mean_size, 0 AS min_level, 0 AS max_level FROM z")
def community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = community.statistics(community._records(community.neighbourhood_members(graph.build_edges(triples(spark, sf_dir)))))
    return out.withColumn("mean_size", F.round("mean_size", 6))


@query(
    """WITH r AS (SELECT 'ROOT' AS community_id, NULL AS parent UNION ALL SELECT 'R' || r_regionkey, 'ROOT' FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
    UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)
    SELECT r.community_id, coalesce(string_agg(k.community_id, '|' ORDER BY k.community_id), '') AS children FROM r LEFT JOIN r k ON k.parent = r.community_id GROUP BY 1"""
)
def community_tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    level = lambda df, mark, key, parent: df.select(F.concat(F.lit(mark), key).alias("community_id"), parent.alias("parent_community_id"))
    records = level(r, "R", "r_regionkey", F.lit("ROOT")).union(level(n, "N", "n_nationkey", F.concat(F.lit("R"), "n_regionkey"))).union(level(s, "S", "s_suppkey", F.concat(F.lit("N"), "s_nationkey")))
    root = spark.range(1).select(F.lit("ROOT").alias("community_id"), F.lit(None).cast("string").alias("parent_community_id"))
    out = community.children(root.union(records))
    return out.select("community_id", F.array_join("child_community_ids", "|").alias("children"))


#: Regions, nations and suppliers: each nation's community is itself, its region and its suppliers.
REPORT_SQL = """
WITH ed AS (SELECT 'S' || s_suppkey AS head, 'located_in' AS relation, 'N' || s_nationkey AS tail FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'part_of', 'R' || n_regionkey FROM nation),
nm AS (SELECT id, id AS name, 'UNKNOWN' AS ty, 'NO DESCRIPTION.' AS de FROM (SELECT head AS id FROM ed UNION SELECT tail FROM ed)),
mem AS (SELECT DISTINCT c, n FROM (SELECT head AS c, tail AS n FROM ed UNION SELECT tail, head FROM ed UNION SELECT head, head FROM ed UNION SELECT tail, tail FROM ed)),
ins AS (SELECT m.c, ed.* FROM ed JOIN mem m ON m.n = head JOIN mem k ON k.n = tail AND k.c = m.c),
dg AS (SELECT m.c, m.n, count(i.head) AS d FROM mem m LEFT JOIN ins i ON i.c = m.c AND (i.head = m.n OR i.tail = m.n) GROUP BY 1, 2),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC, n) AS r FROM dg) WHERE r <= 100),
bn AS (SELECT c, string_agg('- ' || name || ' | ' || ty || ' | ' || de, chr(10) ORDER BY n) AS nodes, string_agg(name, ', ' ORDER BY d DESC, n) FILTER (r <= 3) AS top FROM kp JOIN nm ON n = id GROUP BY c),
be AS (SELECT i.c, string_agg('- ' || head || ' | ' || relation || ' | ' || tail, chr(10) ORDER BY head, tail, relation) AS rel
  FROM ins i JOIN kp a ON a.c = i.c AND a.n = head JOIN kp b ON b.c = i.c AND b.n = tail GROUP BY i.c),
rep AS (SELECT 'Community(' || c || ')' AS community_id, 'The primary nodes in this community are: ' || top AS title,
  'Nodes:' || chr(10) || nodes || coalesce(chr(10) || chr(10) || 'Relationships:' || chr(10) || rel, '') AS text FROM bn LEFT JOIN be USING (c))
"""


def place_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template reports of the neighbourhoods in the graph of places."""
    t = graph.ordered_triples(existing(spark, sf_dir).withColumn("doc_key", F.lit("d")))
    edges = graph.build_edges(t)
    return reports.template_reports(community.neighbourhood_members(edges), graph.build_nodes(t), edges)


@query(REPORT_SQL + "SELECT * FROM rep")
def template_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_reports(spark, sf_dir)


@query()
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(triples(spark, sf_dir))


@query()
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(triples(spark, sf_dir))


@query()
def hierarchical_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of at most ten nodes at the leaves, of the graph of all triples."""
    out = community.hierarchical_records(triples(spark, sf_dir), 10)
    return out.select("community_id", "level", "parent_community_id", F.array_join("nodes", "|").alias("nodes"), F.array_join("child_community_ids", "|").alias("children"))


@query()
def reports_of_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-up reports with a stand-in generator that answers with a JSON report of the prompt's size."""
    t = graph.ordered_triples(existing(spark, sf_dir).withColumn("doc_key", F.lit("d")))
    edges = graph.build_edges(t)
    made = lambda p: F.to_json(F.struct(F.concat(F.lit("Report of "), F.length(p).cast("string")).alias("title"), F.substring(p, 1, 200).alias("summary")))
    return reports.reports_bottom_up(community.hierarchical_records(edges, 10), graph.build_nodes(t), edges, made).select("community_id", "level", "title", "text")


@query(
    """WITH e AS (SELECT 'S' || s_suppkey AS h, 'N' || s_nationkey AS t FROM supplier), n AS (SELECT t AS node, h AS nb FROM e),
    q AS (SELECT node, count(*) AS n, string_agg(nb, '|' ORDER BY nb) AS answers FROM n GROUP BY node HAVING count(*) >= 2)
    SELECT node, 'located_in#inverse' AS relation, 'Who is located in ' || node || '?' AS question, n AS n_answers, answers FROM q"""
)
def questions_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = existing(spark, sf_dir).where("relation = 'located_in'")
    out = questions.neighbourhood(edges, {"located_in#inverse": "Who is located in {target}?"})
    return out.select("node", "relation", "question", F.size("answers").cast("bigint").alias("n_answers"), F.array_join("answers", "|").alias("answers"))


@query(
    """WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS h, 'P' || l_partkey AS t FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45), k AS (SELECT h, count(*) AS n FROM e GROUP BY h),
    p AS (SELECT a.h AS a, b.h AS b, count(*) AS common, string_agg(a.t, '|' ORDER BY a.t) AS answers FROM e a JOIN e b ON a.t = b.t AND a.h < b.h GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT a AS node_a, b AS node_b, 'returned' AS relation, common, answers FROM p JOIN k x ON x.h = a JOIN k y ON y.h = b WHERE x.n > common AND y.n > common
    UNION ALL
    SELECT a, b, 'returned#inverse', common, answers FROM (SELECT a.t AS a, b.t AS b, count(*) AS common, string_agg(a.h, '|' ORDER BY a.h) AS answers FROM e a JOIN e b ON a.h = b.h AND a.t < b.t GROUP BY 1, 2 HAVING count(*) >= 2)
    JOIN (SELECT t, count(*) AS n FROM e GROUP BY t) x ON x.t = a JOIN (SELECT t, count(*) AS n FROM e GROUP BY t) y ON y.t = b WHERE x.n > common AND y.n > common"""
)
def questions_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returned parts of large quantity only, as in the SQL; ``questions_intersection_whole`` has all triples."""
    edges = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.concat(F.lit("S"), "l_suppkey").alias("head"), F.lit("returned").alias("relation"), F.concat(F.lit("P"), "l_partkey").alias("tail")).distinct()
    out = questions.intersection(edges)
    return out.select("node_a", "node_b", "relation", F.size("answers").cast("bigint").alias("common"), F.array_join("answers", "|").alias("answers"))


@query()
def questions_intersection_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection questions on all triples: every returned and supplied part, suppliers and places."""
    out = questions.intersection(triples(spark, sf_dir).select("head", "relation", "tail"))
    return out.select("node_a", "node_b", "relation", F.size("answers").cast("bigint").alias("common"), F.array_join("answers", "|").alias("answers"))


@query(
    """WITH n AS (SELECT 'S' || s_suppkey AS node, 'located_in' AS r, 'N' || s_nationkey AS nb FROM supplier UNION ALL SELECT 'N' || s_nationkey, 'located_in#inverse', 'S' || s_suppkey FROM supplier
    UNION ALL SELECT 'N' || n_nationkey, 'part_of', 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || n_regionkey, 'part_of#inverse', 'N' || n_nationkey FROM nation)
    SELECT x.node, x.r AS relation1, y.r AS relation2, count(DISTINCT y.nb) AS n_answers FROM n x JOIN n y ON x.nb = y.node
    WHERE replace(x.r, '#inverse', '') <> replace(y.r, '#inverse', '') GROUP BY 1, 2, 3 HAVING count(DISTINCT y.nb) >= 2"""
)
def questions_twohop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = questions.two_hop(existing(spark, sf_dir))
    return out.select("node", "relation1", "relation2", F.size("answers").cast("bigint").alias("n_answers"))


@query(
    f"""WITH {EDGES_SQL} SELECT head, relation, tail FROM edges JOIN part p ON tail = 'P' || p.p_partkey JOIN supplier s ON head = 'S' || s.s_suppkey
    WHERE (contains(p_brand || '.' || p_size, '3.1')) AND contains('3.1' || s_nationkey, '3.1')"""
)
def tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.array(F.concat("p_brand", F.lit("."), "p_size")).alias("tree_numbers"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.array(F.concat(F.lit("3.1"), "s_nationkey")).alias("tree_numbers"))
    return filters.triples_under(graph.build_edges(triples(spark, sf_dir)).select("head", "relation", "tail"), p.union(s), ["3.1"])


@query(f"WITH {EDGES_SQL} SELECT relation, count(*) AS n FROM edges WHERE relation IN ('returned', 'part_of') GROUP BY relation")
def relation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.relations_in(graph.build_edges(triples(spark, sf_dir)), ["returned", "part_of"])
    return kept.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
