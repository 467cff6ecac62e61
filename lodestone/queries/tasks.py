"""Tasks with their model-free methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import extraction as X
from lodestone.operators import facades, metrics, retrieval, vector_store
from lodestone.queries import evaluation, graphs
from lodestone.queries.base import query, table
from lodestone.queries.indexes import fresh_path

RANKED_SQL = """SELECT 'N' || s_nationkey AS doc_key, (s_suppkey % 3)::INT AS m_idx, 'S' || s_suppkey AS entity_id, s_acctbal::DOUBLE AS score,
  row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_acctbal::DOUBLE DESC, 'S' || s_suppkey)::INT AS rank FROM supplier"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    plain = s.select(F.concat(F.lit("N"), "s_nationkey").alias("doc_key"), (F.col("s_suppkey") % 3).cast("int").alias("m_idx"), F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.col("s_acctbal").cast("double").alias("score"))
    return facades.by_score(plain, F.col("score"))


@query(f"SELECT doc_key, m_idx, entity_id FROM ({RANKED_SQL}) WHERE rank = 1")
def identity_reranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facades.first_candidates(facades.reranking(_candidates(spark, sf_dir), "identity"))


@query(f"SELECT doc_key, m_idx, entity_id, -score AS score, row_number() OVER (PARTITION BY doc_key, m_idx ORDER BY -score DESC, entity_id)::INT AS rank FROM ({RANKED_SQL})")
def score_reranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facades.reranking(_candidates(spark, sf_dir), "score", score=-F.col("score"))


DICTIONARY = ("the", "and", "der", "que", "les")


@query(
    r"""WITH w AS (SELECT doc_id, unnest(w) AS name, unnest(range(len(w))) AS i FROM (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents))
SELECT 'D' || doc_id AS doc_key, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS m_idx, i::INT AS start, (i + 1)::INT AS "end", name, 'WORD' AS entity_type
FROM w WHERE name IN ('the', 'and', 'der', 'que', 'les')"""
)
def dictionary_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), "doc_id").alias("doc_key"), "text")
    names = spark.createDataFrame([(n, "WORD") for n in DICTIONARY], "name string, entity_type string")
    return facades.ner(docs, "dictionary", dictionary=names)


@query(
    f"""WITH {graphs.TRIPLES_SQL}, e AS (SELECT DISTINCT doc_key, head AS x FROM t WHERE part = 1 UNION SELECT doc_key, tail FROM t WHERE part = 1)
    SELECT DISTINCT a.doc_key, f.head, f.relation, f.tail FROM e a JOIN (SELECT DISTINCT head, relation, tail FROM t) f ON f.head = a.x JOIN e b ON b.doc_key = a.doc_key AND b.x = f.tail"""
)
def documents_to_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a text that names its suppliers and parts: names found, linked, and related by what is known of them."""
    known = graphs.triples(spark, sf_dir)
    held = graphs.sold(spark, sf_dir).groupBy("doc_key").agg(F.concat_ws(", ", F.collect_list(F.concat(F.lit("supplier "), F.substring("head", 2, 20), F.lit(" sent part "), F.substring("tail", 2, 20), F.lit(" .")))).alias("text"))
    # Punctuation stands apart from words.
    docs = held.select("doc_key", F.replace(F.replace("text", F.lit(","), F.lit(" ")), F.lit("."), F.lit(" ")).alias("text"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier "), "s_suppkey").alias("name"), F.lit("Supplier").alias("entity_type"), F.concat(F.lit("S"), "s_suppkey").alias("entity_id"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part "), "p_partkey").alias("name"), F.lit("Part").alias("entity_type"), F.concat(F.lit("P"), "p_partkey").alias("entity_id"))
    names = s.unionByName(p)
    return facades.extract_triples(
        docs,
        lambda d: facades.ner(d, "dictionary", dictionary=names),
        lambda m: facades.entity_search(m, "names", dictionary=names, k=1),
        lambda c: facades.reranking(c, "identity"),
        lambda d: facades.relations(d, "known", facts=known),
    )


@query()
def dense_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names linked by vectors: encoded once into a store, indexed, searched; the best entity of each mention."""
    p = table(spark, sf_dir, "part")
    encoder = vector_store.by_column(lambda c: retrieval.hashed_encoder(T.words(c)))
    store = vector_store.VectorStore(spark, fresh_path(spark, "vector-store"), "hashed-64")
    entities = p.select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))
    index = vector_store.refreshed_index(store, entities, "entity_id", "text", encoder, fresh_path(spark, "vector-index"))
    mentions = p.select((F.col("p_partkey") % 10).alias("doc_key"), F.col("p_partkey").alias("m_idx"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return vector_store.dense_candidates(mentions, index, store, encoder, 1).select("doc_key", "m_idx", "entity_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH c AS ({RANKED_SQL}), g AS (SELECT DISTINCT doc_key, m_idx FROM c), go AS (SELECT doc_key, m_idx, CASE WHEN m_idx = 2 THEN 'S0' ELSE (SELECT max(entity_id) FROM c x WHERE x.doc_key = g.doc_key AND x.m_idx = g.m_idx) END AS gold FROM g),
    w AS (SELECT go.doc_key, go.m_idx, entity_id, row_number() OVER (PARTITION BY go.doc_key, go.m_idx ORDER BY rank) AS i FROM go JOIN c USING (doc_key, m_idx) WHERE entity_id <> gold),
    l AS (SELECT doc_key, m_idx, string_agg(entity_id, '|' ORDER BY i) AS shown FROM w WHERE i <= 2 GROUP BY ALL)
    SELECT doc_key, m_idx, concat_ws('|', shown, CASE WHEN m_idx <> 2 THEN gold END) AS options, CASE WHEN m_idx = 2 THEN 'NA' ELSE gold END AS answer FROM go LEFT JOIN l USING (doc_key, m_idx)"""
)
def linking_demonstrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demonstrations of linking: every third mention's entity is not among its candidates."""
    c = _candidates(spark, sf_dir)
    gold = c.groupBy("doc_key", "m_idx").agg(F.max("entity_id").alias("entity_id")).withColumn("entity_id", F.when(F.col("m_idx") == 2, "S0").otherwise(F.col("entity_id")))
    return X.linking_demonstrations(c, gold).withColumn("options", F.array_join("options", "|"))


@query(evaluation._prf_sql(evaluation.GOLD_SQL, "FROM pred", "FROM gold", "doc_id, b, e, ty"))
def cached_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of ``ner_exact_f1`` from an evaluator that keeps its gold mentions; the second step's count."""
    gold = evaluation.gold_mentions(spark, sf_dir)
    judge = facades.Evaluator(gold, metrics.span_scores, fresh_path(spark, "evaluation"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt"), F.upper("text").alias("generated_text"))
    judge.evaluate(gold.limit(0), "1", asked)
    return evaluation._rounded(judge.evaluate(evaluation.predicted_mentions(judge.gold), "2", asked))
