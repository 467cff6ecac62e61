"""What models read and write, as tables: segments, decoded scores, samples, label sets, official scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import kb, metrics, segments
from lodestone.queries import evaluation
from lodestone.queries.base import query, table
from lodestone.sources import readers


@query(
    r"""WITH RECURSIVE s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY si) AS i, n FROM (SELECT doc_id, si, len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) AS n
      FROM (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS si FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?
]+[.!?]*'), lambda x: trim(x) <> '') AS ss FROM documents))) WHERE n > 0),
    r AS (SELECT doc_id, i, n, 0 AS seg, 0 AS fst, CASE WHEN n > 60 THEN (n - 1) // 60 ELSE 0 END AS more FROM s WHERE i = 1
      UNION ALL
      SELECT z.doc_id, z.i, z.n, CASE WHEN fits THEN z.seg ELSE z.seg + 1 END, CASE WHEN fits THEN z.used ELSE 0 END,
        CASE WHEN (CASE WHEN fits THEN z.used ELSE 0 END) + z.n > 60 THEN ((CASE WHEN fits THEN z.used ELSE 0 END) + z.n - 1) // 60 ELSE 0 END
      FROM (SELECT s.doc_id, s.i, s.n, r.seg + r.more AS seg, r.fst + r.n - r.more * 60 AS used, (r.fst + r.n - r.more * 60 + s.n <= 60 OR r.fst + r.n - r.more * 60 = 0) AS fits FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1) z)
    SELECT doc_id AS doc_key, (max(seg + more) + 1)::INT AS segments, count(*) AS sentences FROM r GROUP BY 1"""
)
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "s"))
    tokens = s.select("doc_key", "sent_idx", F.posexplode(T.words(F.col("s"))).alias("i", "w")).select("doc_key", "sent_idx", (F.col("sent_idx") * 1_000_000 + F.col("i")).alias("idx"))
    out = segments.token_segments(tokens, 60).groupBy("doc_key").agg((F.max("segment") + 1).alias("segments"))
    return out.join(tokens.groupBy("doc_key").agg(F.countDistinct("sent_idx").alias("sentences")), "doc_key")


@query()
def decode_span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluation.gold_mentions(spark, sf_dir)
    m = F.col("m_idx")
    logits = F.array(*(((m * k) % 17).cast("double") for k in (3, 5, 7)))
    return segments.decode_span_scores(g.select("doc_key", "begin", "end", logits.alias("logits"), (m % 9 != 0).alias("valid")), ["NONE", "A", "B"])


@query(
    """WITH q AS (SELECT doc_id AS k, CASE WHEN quality = 0 THEN 'Yes' ELSE 'No' END AS answer FROM labels), n AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY md5('11|' || k), k) AS r FROM q)
    SELECT k, answer FROM n WHERE answer = 'Yes' OR r <= 2 * (SELECT count(*) FROM q WHERE answer = 'Yes')"""
)
def negative_question_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.when(F.col("quality") == 0, "Yes").otherwise("No").alias("answer"))
    return segments.balanced(q, 2, "k")


@query("SELECT 'NONE' AS word, 0 AS id UNION ALL SELECT p_type, row_number() OVER (ORDER BY p_type)::INT FROM (SELECT DISTINCT p_type FROM part)")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.vocabulary(table(spark, sf_dir, "part"), "p_type", "NONE")


@query("SELECT p_type AS question_type, count(DISTINCT p_brand)::INT AS relations, min('What of ' || p_brand || '?') AS first FROM part GROUP BY 1")
def question_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("question_type"), F.col("p_brand").alias("relation"), F.concat(F.lit("What of "), "p_brand", F.lit("?")).alias("template")).distinct()
    out = segments.templates_by_kind(rows)
    return out.select("question_type", F.size("templates").alias("relations"), F.array_min(F.map_values("templates")).alias("first"))


@query(f"WITH {evaluation.GOLD_SQL} SELECT doc_id % 3 AS split, count(DISTINCT ent) AS entities, count(*) AS mentions FROM gold GROUP BY 1")
def entities_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.entities_per_split(evaluation.gold_mentions(spark, sf_dir), F.col("doc_key") % 3)


@query(
    """WITH m AS (SELECT l_orderkey AS d, count(*) AS mentions, count(DISTINCT l_partkey) AS entities FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey AS d, count(*) AS relations FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    e AS (SELECT 'mentions' AS kind, mentions AS n FROM m UNION ALL SELECT 'entities', entities FROM m UNION ALL SELECT 'relations', coalesce(relations, 0) FROM m LEFT JOIN r USING (d))
    SELECT kind, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, max(n) AS most, min(n) AS least FROM e GROUP BY 1"""
)
def annotation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("doc_key", F.col("l_orderkey"))
    return segments.document_statistics(l.withColumn("entity_id", F.col("l_partkey")), l.where("l_returnflag = 'R'")).withColumn("mean", F.round("mean", 6))


@query(
    f"""WITH {evaluation.REL_SQL}, {evaluation.FACTS_SQL}, ct AS (SELECT d, h, r, t FROM p JOIN g USING (d, h, r, t)),
    kn AS (SELECT DISTINCT ct.* FROM ct JOIN nm a ON a.d = ct.d AND a.en = h JOIN nm b ON b.d = ct.d AND b.en = t JOIN tf ON hn = a.name AND tf.r = ct.r AND tn = b.name),
    k AS (SELECT (SELECT count(*) FROM p) AS pred, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM ct) AS correct, (SELECT count(*) FROM kn) AS correct_known),
    z AS (SELECT *, correct / pred AS pr, correct / gold AS re, (correct - correct_known) / (pred - correct_known + 1e-5::DOUBLE) AS ip FROM k)
    SELECT pred, gold, correct, correct_known, round(100 * pr, 6) AS precision, round(100 * re, 6) AS recall, round(200 * pr * re / (pr + re), 6) AS f1, round(100 * ip, 6) AS ign_precision,
      round(200 * ip * re / (ip + re), 6) AS ign_f1, round(100.0 * 2 * correct / (pred + gold), 6) AS evidence_f1 FROM z"""
)
def official_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each triple's evidence is its document, so evidence agrees where the triple does."""
    pred, gold = (d.withColumn("evidences", F.array(F.lit(0))) for d in (evaluation.predicted_relations(spark, sf_dir), evaluation.gold_relations(spark, sf_dir)))
    names = evaluation.names(spark, sf_dir)
    facts = metrics.named_facts(gold.where("doc_key % 3 = 0"), names)
    out = metrics.official_scores(pred, gold, names, facts)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("SELECT DISTINCT text FROM documents")
def unique_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.array(F.struct("text")).alias("contexts"))
    return kb.unique_passages(d, ("text",))
