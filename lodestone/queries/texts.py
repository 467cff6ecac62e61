"""Chunking, conversion, filters and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, filters
from lodestone.queries.base import query, table

SENTENCES_SQL = """
  SELECT doc_id, text, source, list_filter(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda x: trim(x) <> '') AS ss FROM documents
""".replace("\\n", "\n")

CHUNKS_SQL = f"""
WITH RECURSIVE d AS ({SENTENCES_SQL}), s AS (
  SELECT doc_id, i, ss[i] AS s, len(string_split(ss[i], ' ')) AS n FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM d)
), r AS (
  SELECT doc_id, i, s, n AS held, 0 AS c FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, s.s, CASE WHEN r.held >= 100 THEN s.n ELSE r.held + s.n END, CASE WHEN r.held >= 100 THEN r.c + 1 ELSE r.c END
  FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1
), chunks AS (
  SELECT doc_id, c::INT AS chunk_index, string_agg(s, ' ' ORDER BY i) AS text FROM r GROUP BY doc_id, c
)
"""


@query(CHUNKS_SQL + "SELECT doc_id, chunk_index, text, len(string_split(text, ' '))::INT AS n_words FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.chunk_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    return out.select("doc_id", "chunk_index", "text", T.spaced_length(F.col("text")).alias("n_words"))


@query(
    CHUNKS_SQL
    + """SELECT (SELECT count(*) FROM documents) AS passages, (SELECT round(avg(len(string_split(text, ' '))), 6) FROM documents) AS mean_words,
    count(*) AS chunks, round(avg(len(string_split(text, ' '))), 6) AS mean_chunk_words FROM chunks"""
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = chunking.chunk_statistics(docs, chunking.chunk_passages(docs, 100))
    return out.select("passages", F.round("mean_words", 6).alias("mean_words"), "chunks", F.round("mean_chunk_words", 6).alias("mean_chunk_words"))


@query(f"SELECT doc_id, len(ss)::INT AS n_sentences, coalesce(list_sum(list_transform(ss, lambda x: len(string_split(x, ' ')))), 0)::BIGINT AS n_words FROM ({SENTENCES_SQL})")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("ss"))
    total = F.aggregate("ss", F.lit(0).cast("bigint"), lambda a, s: a + T.spaced_length(s))
    return docs.select("doc_id", F.size("ss").alias("n_sentences"), total.alias("n_words"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN trim(CASE WHEN doc_id % 5 = 1 THEN ' ' ELSE text END) = '' THEN source
    ELSE source || ' : ' || text END AS passage FROM documents"""
)
def passage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    text = F.when(F.col("doc_id") % 5 == 1, F.lit(" ")).otherwise(F.col("text"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(T.passage_text(title, text, " : ")).alias("passage"))


@query(
    f"""SELECT 'Passage#' || (row_number() OVER (ORDER BY doc_id) - 1) AS doc_key, len(list_prepend(source, ss))::INT AS n_sentences,
    array_to_string(list_transform(list_prepend(source, ss), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), '|') AS sentences FROM ({SENTENCES_SQL})"""
)
def passages_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunking.passage_keys(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    out = chunking.documents_from_passages(docs, F.col("doc_key"), title_col="source")
    return out.select("doc_key", F.size("sentences").alias("n_sentences"), F.array_join("sentences", "|").alias("sentences"))


@query(
    f"""SELECT doc_id, array_to_string(list_transform(ss, lambda x: array_to_string(regexp_extract_all(x, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]'), ' ')), '|') AS tokenized FROM ({SENTENCES_SQL})"""
)
def tokenized_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    unicode_token = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
    return docs.select("doc_id", F.array_join(T.tokenized_sentences(F.col("text"), unicode_token), "|").alias("tokenized"))


@query(
    """SELECT doc_id FROM documents WHERE NOT (trim(CASE WHEN doc_id % 7 = 2 THEN '#REDIRECT ' || text ELSE text END) = ''
    OR starts_with(lower(CASE WHEN doc_id % 7 = 2 THEN '#REDIRECT ' || text ELSE text END), '#redirect')
    OR len(string_split(CASE WHEN doc_id % 7 = 2 THEN '#REDIRECT ' || text ELSE text END, ' ')) <= 10)"""
)
def redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 2, F.concat(F.lit("#REDIRECT "), "text")).otherwise(F.col("text")))
    return filters.articles(docs).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND trim(text) <> ''")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.nonblank(filters.language(table(spark, sf_dir, "documents"), "lang", ["en"]), "text").select("doc_id", "lang")


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def collapse_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.collapse_spaces(F.col("text")).alias("text"))


@query(
    """SELECT doc_id, sum(CASE WHEN trim(l) <> '' THEN 1 ELSE 0 END)::BIGINT AS n_paragraphs
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id"""
)
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(T.paragraphs(F.col("text")), lambda p: F.trim(F.translate(p, "\n", " ")) != "")).cast("bigint").alias("n_paragraphs"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = T.json_part(F.concat(F.lit("Report: "), "props", F.lit(" end.")), "k int, missing string")
    return table(spark, sf_dir, "events").select("event_id", part["k"].alias("k"), F.coalesce(part["missing"], F.lit("none")).alias("missing"))


@query(
    """SELECT s.source, s.lang, count(*) AS docs, sum(n)::BIGINT AS words, max(n)::INT AS longest, min(n)::INT AS shortest, round(avg(n), 6) AS mean_words
    FROM (SELECT source, lang, len(string_split(text, ' ')) AS n FROM documents) s GROUP BY ROLLUP (s.source, s.lang)"""
)
def corpus_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", T.spaced_length(F.col("text")).alias("n"))
    return docs.rollup("source", "lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.round(F.avg("n"), 6).alias("mean_words")
    )
