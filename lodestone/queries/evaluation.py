"""Metrics over mentions, links and relations made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import metrics as M, multi_search
from lodestone.queries import retrieval
from lodestone.queries.base import query, table

#: Mentions: words of ten characters or more; predictions differ from them in a fixed pattern.
GOLD_SQL = r"""
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM (
  SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)),
gold AS (SELECT doc_id, i AS m_idx, i AS b, least(i + length(w) % 3, n - 1) AS e, 'T' || length(w) % 4 AS ty, 'E' || (length(w) * 7 + i) % 50 AS ent, lower(w) AS name FROM w WHERE length(w) >= 10),
pred AS (SELECT doc_id, m_idx, b, e + CASE WHEN m_idx % 5 = 1 THEN 1 ELSE 0 END AS e, CASE WHEN m_idx % 11 = 2 THEN 'T0' ELSE ty END AS ty,
  CASE WHEN m_idx % 13 = 4 THEN 'NO-PRED' WHEN m_idx % 3 = 0 THEN 'E0' ELSE ent END AS ent FROM gold WHERE m_idx % 7 <> 3)
"""


def gold_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("ws"))
    at = words.select(F.col("doc_id").alias("doc_key"), F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w")).where(F.length("w") >= 10)
    n = F.length("w")
    return at.select(
        "doc_key",
        F.col("i").alias("m_idx"),
        F.col("i").alias("begin"),
        F.least(F.col("i") + n % 3, F.col("n") - 1).alias("end"),
        F.concat(F.lit("T"), n % 4).alias("entity_type"),
        F.concat(F.lit("E"), (n * 7 + F.col("i")) % 50).alias("entity_id"),
        F.lower("w").alias("name"),
    )


def predicted_mentions(gold: DataFrame) -> DataFrame:
    m = F.col("m_idx")
    return gold.where(m % 7 != 3).select(
        "doc_key",
        "m_idx",
        "begin",
        (F.col("end") + (m % 5 == 1).cast("int")).alias("end"),
        F.when(m % 11 == 2, "T0").otherwise(F.col("entity_type")).alias("entity_type"),
        F.when(m % 13 == 4, "NO-PRED").when(m % 3 == 0, "E0").otherwise(F.col("entity_id")).alias("entity_id"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _prf_sql(cte: str, p: str, g: str, cols: str) -> str:
    return f"""WITH {cte}, p AS (SELECT DISTINCT {cols} FROM ({p})), g AS (SELECT DISTINCT {cols} FROM ({g})), c AS (SELECT * FROM p INTERSECT SELECT * FROM g),
    k AS (SELECT (SELECT count(*) FROM p) AS pred, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM c) AS correct)
    SELECT pred, gold, correct, round(100 * correct / pred, 6) AS precision, round(100 * correct / gold, 6) AS recall, round(200.0 * correct / (pred + gold), 6) AS f1 FROM k"""


@query(_prf_sql(GOLD_SQL, "FROM pred", "FROM gold", "doc_id, b, e, ty"))
def ner_exact_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_mentions(spark, sf_dir)
    return _rounded(M.span_scores(predicted_mentions(gold), gold))


@query(_prf_sql(GOLD_SQL, "FROM pred", "FROM gold", "doc_id, b, e"))
def ner_span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_mentions(spark, sf_dir)
    return _rounded(M.span_only_scores(predicted_mentions(gold), gold))


@query(
    f"""WITH {GOLD_SQL}, p AS (SELECT DISTINCT doc_id, b, e, ty FROM pred), g AS (SELECT DISTINCT doc_id, b, e, ty FROM gold),
    k AS (SELECT (SELECT count(*) FROM p) AS pred, (SELECT count(*) FROM g) AS gold,
      (SELECT count(*) FROM p SEMI JOIN g ON p.doc_id = g.doc_id AND p.ty = g.ty AND p.b <= g.e AND g.b <= p.e) AS correct_pred,
      (SELECT count(*) FROM g SEMI JOIN p ON p.doc_id = g.doc_id AND p.ty = g.ty AND p.b <= g.e AND g.b <= p.e) AS correct_gold),
    r AS (SELECT *, correct_pred / pred AS pr, correct_gold / gold AS re FROM k)
    SELECT pred, gold, correct_pred, correct_gold, round(100 * pr, 6) AS precision, round(100 * re, 6) AS recall, round(200 * pr * re / (pr + re), 6) AS f1 FROM r"""
)
def ner_overlap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_mentions(spark, sf_dir)
    return _rounded(M.overlap_scores(predicted_mentions(gold), gold))


@query(
    f"""WITH {GOLD_SQL}, j AS (SELECT g.ent = p.ent AS ok, g.m_idx % 2 = 0 AS cand FROM gold g LEFT JOIN pred p USING (doc_id, m_idx) WHERE g.ent <> 'E7'),
    k AS (SELECT count(*) AS mentions, count(*) FILTER (ok) AS correct, count(*) FILTER (cand) AS mentions_in_cand, count(*) FILTER (ok AND cand) AS correct_in_cand FROM j)
    SELECT *, round(100 * correct / mentions, 6) AS accuracy, round(100 * correct_in_cand / mentions_in_cand, 6) AS normalized_accuracy FROM k"""
)
def ed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_mentions(spark, sf_dir)
    flagged = gold.withColumn("in_kb", F.col("entity_id") != "E7").withColumn("in_cand", F.col("m_idx") % 2 == 0)
    return _rounded(M.linking_accuracy(predicted_mentions(gold), flagged))


@query(_prf_sql(GOLD_SQL, "FROM pred WHERE ent <> 'NO-PRED'", "FROM gold", "doc_id, b, e, ent"))
def ed_mention_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_mentions(spark, sf_dir)
    return _rounded(M.linking_scores(predicted_mentions(gold), gold))


@query(_prf_sql(GOLD_SQL, "FROM pred WHERE ty <> 'T3'", "FROM gold WHERE ty <> 'T3' AND NOT starts_with(ent, 'E4')", "doc_id, ent"))
def ed_entity_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_mentions(spark, sf_dir)
    return _rounded(M.entity_scores(predicted_mentions(gold), gold, ignored_types=("T3",), ignored_prefixes=("E4",)))


@query(
    retrieval.VECTOR_SQL.join(["WITH v AS (", "),"]).format(score="list_inner_product(q.v, e.v)")
    + """ h AS (SELECT query_id, e.label::INT AS label, rank FROM v JOIN embeddings e USING (vec_id)),
    f AS (SELECT q.vec_id, min(rank) AS r FROM embeddings q LEFT JOIN h ON h.query_id = q.vec_id AND h.label = q.label WHERE q.vec_id % 50 = 0 GROUP BY 1)
    SELECT k::INT AS k, round(100 * avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM f, (SELECT unnest([1, 2, 4, 5, 8, 10]) AS k) GROUP BY k"""
)
def candidate_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators import retrieval as R

    corpus, asked = retrieval.vectors(spark, sf_dir)
    found = R.vector_search(corpus, asked, "vec_id", "query_id", "embedding", 10).join(corpus.select("vec_id", F.col("label").alias("entity_id")), "vec_id")
    gold = asked.select("query_id", F.col("label").alias("entity_id"))
    return _rounded(M.candidate_recall(found, gold, ["query_id"], (1, 2, 4, 5, 8, 10)))


# Relations: suppliers and parts of an order; predictions differ in a fixed pattern.
REL_SQL = """
g AS (SELECT DISTINCT l_orderkey AS d, 'S' || l_suppkey AS h, 'r' || l_linenumber % 3 AS r, 'P' || l_partkey AS t FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS d, 'S' || l_suppkey AS h, 'r' || CASE WHEN l_partkey % 5 = 1 THEN 0 ELSE l_linenumber % 3 END AS r, 'P' || l_partkey AS t FROM lineitem WHERE l_suppkey % 4 <> 3),
oc AS (SELECT l_orderkey AS d, 'S' || l_suppkey AS en, l_linenumber AS s FROM lineitem UNION ALL SELECT l_orderkey, 'P' || l_partkey, l_linenumber + l_partkey % 2 FROM lineitem),
ii AS (SELECT a.d, a.en AS h, b.en AS t, max(CASE WHEN a.s = b.s THEN 1 ELSE 0 END) AS intra FROM oc a JOIN oc b ON a.d = b.d AND a.en <> b.en GROUP BY 1, 2, 3)
"""


def gold_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("doc_key"), F.concat(F.lit("S"), "l_suppkey").alias("head"), F.concat(F.lit("r"), F.col("l_linenumber") % 3).alias("relation"), F.concat(F.lit("P"), "l_partkey").alias("tail"))


def predicted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 <> 3")
    r = F.when(F.col("l_partkey") % 5 == 1, 0).otherwise(F.col("l_linenumber") % 3)
    return l.select(F.col("l_orderkey").alias("doc_key"), F.concat(F.lit("S"), "l_suppkey").alias("head"), F.concat(F.lit("r"), r).alias("relation"), F.concat(F.lit("P"), "l_partkey").alias("tail"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    s = l.select(F.col("l_orderkey").alias("doc_key"), F.concat(F.lit("S"), "l_suppkey").alias("entity"), F.col("l_linenumber").cast("bigint").alias("sent_idx"))
    return s.union(l.select("l_orderkey", F.concat(F.lit("P"), "l_partkey"), (F.col("l_linenumber") + F.col("l_partkey") % 2).cast("bigint")))


REL_PRF = "SELECT pred, gold, correct, round(100 * correct / pred, 6) AS precision, round(100 * correct / gold, 6) AS recall, round(200.0 * correct / (pred + gold), 6) AS f1 FROM k"


@query(f"WITH {REL_SQL}, k AS (SELECT (SELECT count(*) FROM p) AS pred, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM p JOIN g USING (d, h, r, t)) AS correct) {REL_PRF}")
def docre_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.relation_scores(predicted_relations(spark, sf_dir), gold_relations(spark, sf_dir)))


@query(
    f"""WITH {REL_SQL}, pi AS (SELECT p.* FROM p JOIN ii USING (d, h, t) WHERE intra = 1), gi AS (SELECT g.* FROM g JOIN ii USING (d, h, t) WHERE intra = 1),
    k AS (SELECT (SELECT count(*) FROM pi) AS pred, (SELECT count(*) FROM gi) AS gold, (SELECT count(*) FROM pi JOIN gi USING (d, h, r, t)) AS correct) {REL_PRF}"""
)
def docre_intra_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.relation_scores_by(predicted_relations(spark, sf_dir), gold_relations(spark, sf_dir), occurrences(spark, sf_dir), "intra"))


@query(
    f"""WITH {REL_SQL}, pi AS (SELECT p.* FROM p JOIN ii USING (d, h, t) WHERE intra = 0), gi AS (SELECT g.* FROM g JOIN ii USING (d, h, t) WHERE intra = 0),
    k AS (SELECT (SELECT count(*) FROM pi) AS pred, (SELECT count(*) FROM gi) AS gold, (SELECT count(*) FROM pi JOIN gi USING (d, h, r, t)) AS correct) {REL_PRF}"""
)
def docre_inter_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.relation_scores_by(predicted_relations(spark, sf_dir), gold_relations(spark, sf_dir), occurrences(spark, sf_dir), "inter"))


@query(f"WITH {REL_SQL} SELECT d AS doc_key, h AS head, t AS tail, CASE WHEN intra = 1 THEN 'intra' ELSE 'inter' END AS kind FROM ii")
def intra_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.intra_inter(occurrences(spark, sf_dir))


FACTS_SQL = """
nm AS (SELECT d, en, substr(en, 1, length(en) - 1) AS name FROM oc UNION SELECT d, en, en FROM oc),
tf AS (SELECT DISTINCT a.name AS hn, g.r, b.name AS tn FROM g JOIN nm a ON a.d = g.d AND a.en = g.h JOIN nm b ON b.d = g.d AND b.en = g.t WHERE g.d % 3 = 0)
"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two names for each entity of an order: its id, and that without the last digit."""
    e = occurrences(spark, sf_dir).select("doc_key", "entity").distinct()
    return e.select("doc_key", "entity", F.explode(F.array("entity", F.expr("substring(entity, 1, length(entity) - 1)"))).alias("name"))


@query(f"WITH {REL_SQL}, {FACTS_SQL.replace(' WHERE g.d % 3 = 0', '')} SELECT hn AS head_name, r AS relation, tn AS tail_name FROM tf")
def train_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.named_facts(gold_relations(spark, sf_dir), names(spark, sf_dir))


@query(
    f"""WITH {REL_SQL}, {FACTS_SQL}, ct AS (SELECT d, h, r, t FROM p JOIN g USING (d, h, r, t)),
    kn AS (SELECT DISTINCT ct.* FROM ct JOIN nm a ON a.d = ct.d AND a.en = h JOIN nm b ON b.d = ct.d AND b.en = t JOIN tf ON hn = a.name AND tf.r = ct.r AND tn = b.name),
    k AS (SELECT (SELECT count(*) FROM p) AS pred, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM ct) AS correct, (SELECT count(*) FROM kn) AS correct_known),
    z AS (SELECT *, CASE WHEN pred = correct_known THEN 0 ELSE (correct - correct_known) / (pred - correct_known) END AS pr, correct / gold AS re FROM k)
    SELECT pred, gold, correct, correct_known, round(100 * pr, 6) AS precision, round(100 * re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 200 * pr * re / (pr + re) END, 6) AS f1 FROM z"""
)
def docre_ign_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, n = gold_relations(spark, sf_dir), names(spark, sf_dir)
    facts = M.named_facts(gold.where("doc_key % 3 = 0"), n)
    return _rounded(M.unseen_relation_scores(predicted_relations(spark, sf_dir), gold, n, facts))


@query(
    f"""WITH {REL_SQL}, kp AS (SELECT DISTINCT h, t FROM g WHERE d % 4 = 1), q AS (SELECT DISTINCT t AS head, h AS tail FROM p)
    SELECT head, tail, EXISTS (SELECT 1 FROM kp WHERE (h = head AND t = tail) OR (h = tail AND t = head)) AS seen FROM q"""
)
def seen_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = predicted_relations(spark, sf_dir).select(F.col("tail").alias("head"), F.col("head").alias("tail")).distinct()
    return M.seen_pairs(pairs, gold_relations(spark, sf_dir).where("doc_key % 4 = 1"))


# Retrieval: the twenty best BM25 passages of each benchmark item against the documents that hold it.
FOUND_SQL = retrieval.BM25_SQL + """, fd AS (
  SELECT item_id, doc_id, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 20
), gl AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ht AS (SELECT fd.*, CASE WHEN gl.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM fd LEFT JOIN gl USING (item_id, doc_id))
"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators import retrieval as R

    return R.bm25_search(retrieval.passages(spark, sf_dir), retrieval.questions(spark, sf_dir), "doc_id", "item_id", 20).select("item_id", "doc_id", "rank")


def gold_contexts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return multi_search.containing(docs, items, "doc_id", "text", "item_id", "q")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_contexts_of(spark, sf_dir)


@query(
    FOUND_SQL
    + """SELECT k::INT AS k, round(100 * sum(rel) / count(*), 6) AS precision, round(100 * sum(rel) / (SELECT count(*) FROM gl), 6) AS recall
    FROM ht, (SELECT unnest([1, 2, 4, 5, 8, 10, 16, 20, 30, 32, 50, 64, 100, 128]) AS k) WHERE rank <= k GROUP BY k"""
)
def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.precision_recall_at_k(found(spark, sf_dir), gold_contexts_of(spark, sf_dir), "item_id", "doc_id"))


@query(
    FOUND_SQL
    + """, tx AS (SELECT doc_id, md5(text) AS x FROM documents), gx AS (SELECT DISTINCT item_id, x FROM gl JOIN tx USING (doc_id)),
    fx AS (SELECT item_id, x, min(rank) AS rank FROM fd JOIN tx USING (doc_id) GROUP BY ALL), hx AS (SELECT fx.*, CASE WHEN gx.x IS NULL THEN 0 ELSE 1 END AS rel FROM fx LEFT JOIN gx USING (item_id, x))
    SELECT k::INT AS k, round(100 * sum(rel) / count(*), 6) AS precision, round(100 * sum(rel) / (SELECT count(*) FROM gx), 6) AS recall
    FROM hx, (SELECT unnest([1, 2, 4, 5, 8, 10, 16, 20, 30, 32, 50, 64, 100, 128]) AS k) WHERE rank <= k GROUP BY k"""
)
def precision_recall_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``precision_recall_at_k`` where passages of equal text are one."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    as_text = lambda rows: M.identified(rows, docs, "doc_id", F.md5("text"))
    return _rounded(M.precision_recall_at_k(as_text(found(spark, sf_dir)), as_text(gold_contexts_of(spark, sf_dir)), "item_id", "identity"))


@query(
    FOUND_SQL
    + """, ks AS (SELECT unnest([1, 2, 4, 5, 8, 10, 16, 20, 30, 32, 50, 64, 100, 128]) AS k),
    dc AS (SELECT item_id, k, sum(1 / log2(rank + 1)) AS dcg FROM ht, ks WHERE rel = 1 AND rank <= k GROUP BY ALL),
    id AS (SELECT item_id, k, list_sum(list_transform(range(1, least(n, k) + 1), lambda r: 1 / log2(r + 1))) AS ideal FROM (SELECT item_id, count(*) AS n FROM gl GROUP BY 1), ks)
    SELECT k::INT AS k, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg FROM (SELECT item_id, k FROM benchmark, ks) LEFT JOIN id USING (item_id, k) LEFT JOIN dc USING (item_id, k) GROUP BY k"""
)
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.ndcg_at_k(found(spark, sf_dir), gold_contexts_of(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "doc_id"))


@query(FOUND_SQL + "SELECT item_id, round(coalesce(1 / (SELECT min(rank) FROM ht WHERE rel = 1 AND ht.item_id = b.item_id), 0), 6) AS rr FROM benchmark b")
def reciprocal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.reciprocal_ranks(found(spark, sf_dir), gold_contexts_of(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "doc_id"))


@query(FOUND_SQL + "SELECT round(100 * avg(rr), 6) AS mrr FROM (SELECT coalesce(1 / min(rank) FILTER (rel = 1), 0) AS rr FROM benchmark LEFT JOIN ht USING (item_id) GROUP BY item_id)")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = M.reciprocal_ranks(found(spark, sf_dir), gold_contexts_of(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "doc_id")
    return rr.agg(F.round(F.avg("rr") * 100, 6).alias("mrr"))


@query(
    FOUND_SQL
    + """, cu AS (SELECT *, sum(rel) OVER (PARTITION BY item_id ORDER BY rank) AS h FROM ht), ap AS (SELECT item_id, sum(h / rank) AS s FROM cu WHERE rel = 1 GROUP BY 1)
    SELECT round(100 * avg(coalesce(s / n, 0)), 6) AS map FROM benchmark LEFT JOIN ap USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS n FROM gl GROUP BY 1) USING (item_id)"""
)
def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    ap = M.average_precisions(found(spark, sf_dir), gold_contexts_of(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "doc_id")
    return ap.agg(F.round(F.avg("ap") * 100, 6).alias("map"))


# Question answering: the assistant's turn answers the user's before it.
QA_SQL = r"""
tn AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
o AS (SELECT conv_id * 1000 + turn AS q, CASE WHEN conv_id % 3 = 0 THEN 'Final: ' || split_part(text, ' ', 1) ELSE text END AS out, text FROM tn),
a AS (SELECT q, 0 AS li, split_part(text, ' ', 1) AS ans FROM o UNION ALL SELECT q, 0, 'nothing of the kind' FROM o UNION ALL SELECT q, 1, split_part(text, ' ', 2) FROM o UNION ALL SELECT q, 2, 'absent' || q FROM o)
"""


def outputs_and_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_key"), "conv_id", "text")
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    outputs = t.select("question_key", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Final: "), word(1))).otherwise(F.col("text")).alias("output_answer"))
    item = lambda i, a: F.struct(F.lit(i).alias("list_index"), a.alias("answer"))
    each = F.array(item(0, word(1)), item(0, F.lit("nothing of the kind")), item(1, word(2)), item(2, F.concat(F.lit("absent"), "question_key")))
    return outputs, t.select("question_key", F.inline(each))


OK_SQL = "contains(lower(out), lower(ans)) OR contains(lower(ans), lower(out))"


@query(f"WITH {QA_SQL}, k AS (SELECT count(DISTINCT q) AS questions, count(DISTINCT q) FILTER ({OK_SQL}) AS correct FROM o JOIN a USING (q)) SELECT questions, correct, round(100 * correct / questions, 6) AS accuracy FROM k")
def qa_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.answer_accuracy(*outputs_and_answers(spark, sf_dir)))


@query(f"WITH {QA_SQL}, k AS (SELECT count(DISTINCT q) AS questions, count(DISTINCT q) FILTER (lower(out) = lower(ans)) AS correct FROM o JOIN a USING (q)) SELECT questions, correct, round(100 * correct / questions, 6) AS accuracy FROM k")
def qa_exact_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.answer_accuracy(*outputs_and_answers(spark, sf_dir), exact=True))


@query(f"WITH {QA_SQL}, m AS (SELECT q, li, max(CASE WHEN {OK_SQL} THEN 1 ELSE 0 END) AS ok FROM o JOIN a USING (q) GROUP BY 1, 2) SELECT count(*) AS items, sum(ok)::BIGINT AS correct, round(100 * sum(ok) / count(*), 6) AS recall FROM m")
def qa_list_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.answer_recall(*outputs_and_answers(spark, sf_dir)))


@query(
    """WITH r AS (SELECT value / 100 AS s, event_id % 3 AS m FROM events)
    SELECT count(*) AS questions, round(avg(CASE m WHEN 0 THEN round(s, 4) WHEN 1 THEN round(s, 4) / 100 ELSE 0 END), 6) AS mean_score FROM r"""
)
def qa_graded_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.round(F.col("value") / 100, 4).cast("decimal(20,4)").cast("string")
    kind = F.col("event_id") % 3
    r = table(spark, sf_dir, "events").select(F.when(kind == 0, F.concat(F.lit("Score: "), s)).when(kind == 1, F.concat(F.lit("Score: "), s, F.lit("%"))).otherwise(F.lit("no score")).alias("response"))
    return _rounded(M.graded(r))


@query("SELECT item_id, string_agg(doc_id || ':' || rank, '|' ORDER BY rank) AS contexts FROM (" + FOUND_SQL + "SELECT item_id, doc_id, rank FROM fd) GROUP BY item_id")
def question_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators import retrieval as R

    ranked = found(spark, sf_dir).withColumn("score", F.lit(0.0))
    full = R.contexts(ranked, "item_id", "doc_id", table(spark, sf_dir, "documents"), "text")
    return full.select("item_id", F.array_join(F.transform("contexts", lambda c: F.concat_ws(":", c["doc_id"].cast("string"), c["rank"].cast("string"))), "|").alias("contexts"))
