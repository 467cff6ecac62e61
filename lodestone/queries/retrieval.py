"""BM25, string and vector search, hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import edit_search, linking, retrieval as R
from lodestone.queries.base import query, table

TERMS_SQL = "list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')"

BM25_SQL = f"""
WITH p AS (SELECT doc_id, source, {TERMS_SQL} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM p),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM p) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
sc AS (
  SELECT item_id, doc_id, sum(qtf * greatest(0, ln(n - df + 0.5) - ln(df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL
)
"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", T.words(F.lower("text")).alias("terms"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text", T.words(F.lower("text")).alias("terms"))


@query(
    BM25_SQL
    + """SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 10"""
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.bm25_search(passages(spark, sf_dir), questions(spark, sf_dir), "doc_id", "item_id", 10)
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    BM25_SQL
    + """SELECT item_id, doc_id, source, round(score, 6) AS score, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
      SELECT sc.*, source, row_number() OVER (PARTITION BY item_id, source ORDER BY round(score, 9) DESC, sc.doc_id) AS g FROM sc JOIN p USING (doc_id)) WHERE g = 1)
    WHERE rank <= 5"""
)
def bm25_entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.bm25_search(passages(spark, sf_dir), questions(spark, sf_dir), "doc_id", "item_id", 5, group="source", fill=False)
    return out.select("item_id", "doc_id", "source", F.round("score", 6).alias("score"), "rank")


@query(BM25_SQL + "SELECT term, df, round(greatest(0, ln(n - df + 0.5) - ln(df + 0.5)), 6) AS idf FROM df, st")
def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    tf = R.term_frequencies(p, "doc_id", F.col("terms"))
    out = R.document_frequencies(tf, p.count())
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    """SELECT s_suppkey, p_partkey, round(1.0 / (levenshtein(s, p) + 1), 6) AS score, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(1.0 / (levenshtein(s, p) + 1), 9) DESC, p_partkey) AS rank FROM (
        SELECT s_suppkey, lower(s_name) AS s, p_partkey, lower(p_name) AS p FROM supplier, part)) WHERE rank <= 3"""
)
def levenshtein_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("p"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower("s_name").alias("s"))
    out = edit_search.string_search(parts, asked, "p_partkey", "s_suppkey", "p", "s", 3)
    return out.select("s_suppkey", "p_partkey", F.round("score", 6).alias("score"), "rank")


VECTOR_SQL = """
SELECT vec_id AS query_id, other AS vec_id, round(score, 6) AS score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, other) AS rank FROM (
    SELECT q.vec_id, e.vec_id AS other, {score} AS score
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e)
) WHERE rank <= 10
"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus of vectors, and as queries every one whose id is divisible by 50."""
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return corpus, corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query(VECTOR_SQL.format(score="list_inner_product(q.v, e.v)"))
def vector_ip_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = vectors(spark, sf_dir)
    return R.vector_search(corpus, asked, "vec_id", "query_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query(VECTOR_SQL.format(score="1 / (1 + list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"))
def vector_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = vectors(spark, sf_dir)
    return R.vector_search(corpus, asked, "vec_id", "query_id", "embedding", 10, metric="l2").withColumn("score", F.round("score", 6))


@query()
def vector_lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = vectors(spark, sf_dir)
    return R.lsh_search(corpus, asked, "vec_id", "query_id", "embedding", 10)


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0),
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    s AS (SELECT query_id, e.vec_id, e.label, q.label AS gold, round(list_inner_product(q.v, e.v), 9) AS score FROM q, e),
    g AS (SELECT query_id, max(score) AS best FROM s WHERE label = gold AND vec_id <> query_id GROUP BY query_id),
    k AS (SELECT s.query_id, s.vec_id, s.label, CASE WHEN s.score >= coalesce(best, -1) THEN 1 ELSE 2 END AS kind, s.score FROM s LEFT JOIN g USING (query_id) WHERE s.label <> gold),
    d AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY kind, score DESC, vec_id) AS f FROM k)
    SELECT query_id, label::INT AS entity_id, kind::INT AS kind, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, score DESC, label) AS rank FROM d WHERE f = 1) WHERE rank <= 5"""
)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = vectors(spark, sf_dir)
    s = R.best_entities(corpus.withColumnRenamed("label", "entity_id"), asked.withColumnRenamed("label", "gold_id"), "vec_id", "query_id", "embedding", "entity_id", "gold_id", 5)
    return linking.hard_negatives(s, "query_id", 5)
