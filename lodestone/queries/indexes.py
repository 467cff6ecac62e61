"""Saved indexes: vectors in inverted lists, terms in blocks; built, searched and added to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.late_index import LateIndex
from lodestone.operators.text_index import TextIndex
from lodestone.operators.vector_index import VectorIndex
from lodestone.plans.staging import shared_dir
from lodestone.queries.base import query
from lodestone.queries.retrieval import BM25_SQL, passages, questions, vectors
from lodestone.streaming import operators as S


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A folder of its own among the shared ones."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors by a saved index, for every query vector."""
    corpus, asked = vectors(spark, sf_dir)
    index = VectorIndex.build(corpus, "vec_id", "embedding", fresh_path(spark, "vector-index"))
    return index.search(asked, "query_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query(
    BM25_SQL
    + """SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 10"""
)
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``bm25_topk``, from an index made in two segments."""
    docs = passages(spark, sf_dir)
    index = TextIndex.build(docs.where("doc_id % 3 <> 0"), "doc_id", fresh_path(spark, "text-index"))
    index.append(docs.where("doc_id % 3 = 0"), "doc_id")
    return index.search(questions(spark, sf_dir), "item_id", 10).withColumn("score", F.round("score", 6))


@query(
    BM25_SQL
    + """SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 10"""
)
def query_stream_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``bm25_topk``, for questions that arrive as a stream."""
    index = TextIndex.build(passages(spark, sf_dir), "doc_id", fresh_path(spark, "text-index"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").schema
    arriving = spark.readStream.schema(items).parquet(f"{sf_dir}/benchmark.parque[t]").select("item_id", T.words(F.lower("text")).alias("terms"))
    where = fresh_path(spark, "streams")
    S.query_stream(arriving, index, "item_id", 10, f"{where}/rows", f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/rows").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def late_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``late_interaction_topk`` by a saved index: each embedding as four token vectors of sixteen places."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    corpus = vectors(spark, sf_dir)[0].select("vec_id", parts.alias("tokens"))
    index = LateIndex.build(corpus, "vec_id", "tokens", fresh_path(spark, "late-index"))
    out = index.search(corpus.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), "query_id", "tokens", 10)
    return out.select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")
