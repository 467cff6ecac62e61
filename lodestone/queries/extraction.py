"""Prompts, parsed answers, linking, spans and relations over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import parsing, text as T
from lodestone.operators import extraction as X
from lodestone.operators import linking, metrics
from lodestone.plans.staging import stage
from lodestone.queries import evaluation
from lodestone.queries.base import query, table


@query(
    f"""WITH {evaluation.GOLD_SQL}, en AS (SELECT doc_id, ent, arg_min(ty, m_idx) AS ty, min(m_idx) AS f, string_agg(m_idx::VARCHAR, '|' ORDER BY m_idx) AS idx, string_agg(name, '|' ORDER BY m_idx) AS names FROM gold GROUP BY 1, 2)
    SELECT doc_id AS doc_key, (row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1)::INT AS e_idx, ent AS entity_id, ty AS entity_type, idx AS mention_indices, names AS mention_names FROM en"""
)
def entity_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linking.aggregate_mentions(evaluation.gold_mentions(spark, sf_dir))
    return out.withColumn("mention_indices", F.array_join(F.col("mention_indices").cast("array<string>"), "|")).withColumn("mention_names", F.array_join("mention_names", "|"))


@query(f"WITH {evaluation.GOLD_SQL} SELECT doc_id AS doc_key, m_idx::INT AS m_idx, lower(name) AS entity_id, 5 AS n_candidates FROM gold")
def dummy_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linking.name_as_id(evaluation.gold_mentions(spark, sf_dir), 5)
    return out.select("doc_key", "m_idx", "entity_id", F.size("candidates").alias("n_candidates"))


def part_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pages = p.select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.array("p_brand").alias("synonyms"), F.col("p_type").alias("description"), "p_partkey")
    keys = pages.select("entity_id", "p_partkey")
    out = linking.dictionary_passages(pages).join(keys, "entity_id")
    return out.withColumn("passage_id", F.col("p_partkey") * 2 + F.col("name_idx"))


def part_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("doc_key"), F.col("p_partkey").alias("m_idx"), F.concat_ws(" ", "p_type", "p_brand").alias("name"))


@query(
    r"""WITH pa AS (SELECT 'P' || p_partkey AS ent, p_partkey * 2 AS pid, p_name AS title, p_type AS de FROM part UNION ALL SELECT 'P' || p_partkey, p_partkey * 2 + 1, p_brand, p_type FROM part),
    p AS (SELECT ent, pid, list_filter(string_split_regex(lower(title || ' ' || de), '\s+'), lambda x: x <> '') AS w FROM pa), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM p),
    tf AS (SELECT ent, pid, len, term, count(*) AS tf FROM (SELECT ent, pid, len(w) AS len, unnest(w) AS term FROM p) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    nm AS (SELECT DISTINCT lower(p_type || ' ' || p_brand) AS name FROM part), q AS (SELECT name, term, count(*) AS qtf FROM (SELECT name, unnest(string_split(name, ' ')) AS term FROM nm) GROUP BY ALL),
    sc AS (SELECT name, ent, pid, sum(qtf * greatest(0, ln(n - df + 0.5) - ln(df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY name, ent ORDER BY round(score, 9) DESC, pid) AS g FROM sc),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, pid) AS rank FROM b WHERE g = 1)
    SELECT p_partkey % 10 AS doc_key, p_partkey AS m_idx, rank::INT AS rank, ent AS entity_id, round(score, 6) AS score FROM part JOIN r ON name = lower(p_type || ' ' || p_brand) WHERE rank <= 4"""
)
def lexical_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linking.lexical_candidates(part_mentions(spark, sf_dir), part_dictionary(spark, sf_dir), T.words, 4, k1=1.2, b=0.75)
    return out.withColumn("score", F.round("score", 6))


@query(
    """WITH nm AS (SELECT DISTINCT lower(p_type || ' ' || p_brand) AS name FROM part), pa AS (SELECT 'P' || p_partkey AS ent, p_partkey * 2 AS pid, lower(p_name) AS t FROM part UNION ALL SELECT 'P' || p_partkey, p_partkey * 2 + 1, lower(p_brand) FROM part),
    s AS (SELECT name, ent, pid, 1.0 / (levenshtein(name, t) + 1) AS score FROM nm, pa), b AS (SELECT *, row_number() OVER (PARTITION BY name, ent ORDER BY round(score, 9) DESC, pid) AS g FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, pid) AS rank FROM b WHERE g = 1)
    SELECT p_partkey % 10 AS doc_key, p_partkey AS m_idx, ent AS entity_id FROM part JOIN r ON name = lower(p_type || ' ' || p_brand) WHERE rank = 1"""
)
def string_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = part_mentions(spark, sf_dir)
    found = linking.lexical_candidates(m, part_dictionary(spark, sf_dir), T.words, 2, method="levenshtein")
    return linking.top_candidate(m.withColumn("entity_id", F.lit(None).cast("string")), found).select("doc_key", "m_idx", "entity_id")


#: Answers of a generator, made from the first and the longest words of each document.
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), T.sentences(F.col("text")).alias("sentences"))
    ws = F.flatten(F.transform("sentences", T.words))
    longest = F.element_at(F.array_sort(F.transform(ws, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    text = F.concat_ws("\n", F.concat(F.lit("- "), F.get(ws, F.lit(0)), F.lit(" | Thing")), F.concat(F.lit("* "), longest, F.lit(" | place")), F.lit(""), F.lit("nothing"), F.concat(F.lit("- "), F.get(ws, F.lit(0)), F.lit(" "), F.replace(F.get(ws, F.lit(1)), F.lit("|"), F.lit("")), F.lit(" | Pair")))
    return d.where(F.size(ws) > 1).withColumn("generated_text", text)


@query(
    r"""WITH s AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS si FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?
]+[.!?]*'), lambda x: trim(x) <> '') AS ss FROM documents)),
    w AS (SELECT doc_id, si, w, row_number() OVER (PARTITION BY doc_id ORDER BY si, j) - 1 AS i FROM (SELECT doc_id, si, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM (SELECT *, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS ws FROM s))),
    f AS (SELECT doc_id, arg_min(w, i) FILTER (i = 0) AS w0, arg_min(w, i) FILTER (i = 1) AS w1, first(w ORDER BY length(w) DESC, w) AS lw FROM w GROUP BY doc_id HAVING count(*) > 1),
    q AS (SELECT doc_id, lower(w0) AS n, 'Thing' AS t FROM f UNION SELECT doc_id, lower(lw), 'LOC' FROM f UNION SELECT doc_id, lower(w0 || replace(w1, '|', '')), 'Pair' FROM f),
    v AS (SELECT doc_id, i, w AS w1, lead(w, 1) OVER z AS w2, lead(w, 2) OVER z AS w3, lead(w, 3) OVER z AS w4 FROM w WINDOW z AS (PARTITION BY doc_id, si ORDER BY i)),
    r AS (SELECT doc_id, i AS b, i AS e, w1 AS name, lower(w1) AS n FROM v UNION ALL SELECT doc_id, i, i + 1, w1 || ' ' || w2, lower(w1 || w2) FROM v WHERE w2 IS NOT NULL
      UNION ALL SELECT doc_id, i, i + 2, w1 || ' ' || w2 || ' ' || w3, lower(w1 || w2 || w3) FROM v WHERE w3 IS NOT NULL
      UNION ALL SELECT doc_id, i, i + 3, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, lower(w1 || w2 || w3 || w4) FROM v WHERE w4 IS NOT NULL)
    SELECT DISTINCT r.doc_id AS doc_key, b::INT AS "begin", e::INT AS "end", name, t AS entity_type FROM r JOIN q ON r.doc_id = q.doc_id AND r.n = q.n"""
)
def llm_line_parse_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mentions_from_answers(answers(spark, sf_dir), {"Place": "LOC"})


@query(
    """WITH o AS (SELECT l_orderkey AS d, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1),
    l AS (SELECT l_orderkey AS d, l_linenumber - 1 AS a, l_linenumber % 4 AS b, CASE WHEN l_returnflag = 'R' THEN 'RET' ELSE lower(l_returnflag) END AS r FROM lineitem)
    SELECT DISTINCT d AS doc_key, a::INT AS arg1, r AS relation, b::INT AS arg2 FROM l JOIN o USING (d) WHERE n > 1 AND a < n AND b < n AND a <> b"""
)
def llm_line_parse_re(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_returnflag") == "R", "Returned").otherwise(F.lower("l_returnflag"))
    line = F.concat(F.lit("- Entity"), F.col("l_linenumber") - 1, F.lit(" | "), name, F.lit(" | Entity"), F.col("l_linenumber") % 4)
    docs = l.groupBy(F.col("l_orderkey").alias("doc_key")).agg(F.countDistinct("l_partkey").alias("n_entities"), F.array_join(F.array_append(F.collect_list(line), F.lit("odd line | only")), "\n").alias("generated_text"))
    return X.relations_from_answers(docs, {"returned": "RET"})


@query(
    """WITH m AS (SELECT l_orderkey AS d, l_linenumber AS i, 'part ' || l_partkey AS name, l_partkey % 7 AS c FROM lineitem), k AS (SELECT d, count(*) AS n FROM m GROUP BY d)
    SELECT d AS doc_key, i AS m_idx, CASE WHEN c IN (SELECT c FROM m x WHERE x.d = m.d AND x.c <> 3) AND (d % 2 = 0 OR i > 1 OR n = 0 OR EXISTS (SELECT 1 FROM m y WHERE y.d = m.d AND y.i > 1 AND y.name = m.name)) THEN 'C' || c ELSE 'NO-PRED' END AS entity_id FROM m JOIN k USING (d)"""
)
def llm_line_parse_ed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other order's answer lacks its first line, so that it is aligned by name."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_key"), F.col("l_linenumber").alias("m_idx"), F.concat(F.lit("part "), "l_partkey").alias("name"), F.concat(F.lit("C"), F.col("l_partkey") % 7).alias("c"))
    rows = F.array_sort(F.collect_list(F.struct("m_idx", "name", "c")))
    docs = l.groupBy("doc_key").agg(rows.alias("r"))
    used = F.when(F.col("doc_key") % 2 == 0, F.col("r")).otherwise(F.filter("r", lambda x: x["m_idx"] > 1))
    docs = docs.select(
        "doc_key",
        F.transform("r", lambda x: F.struct(x["m_idx"].alias("m_idx"), x["name"].alias("name"))).alias("mentions"),
        F.array_remove(F.transform("r", lambda x: x["c"]), "C3").alias("candidate_ids"),
        F.array_join(F.transform(used, lambda x: F.concat(F.lit("- "), F.replace(x["name"], F.lit("part "), F.lit("PART")), F.lit(" | "), x["c"])), "\n").alias("generated_text"),
    )
    return X.links_from_answers(docs)


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(round(value, 2), 6) WHEN 1 THEN round(round(value, 2) / 100, 6) WHEN 2 THEN 0.0 ELSE 7.0 END AS score FROM events"""
)
def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round("value", 2).cast("decimal(20,2)").cast("string")
    kind = F.col("event_id") % 4
    said = F.when(kind == 0, F.concat(F.lit("Score: "), v)).when(kind == 1, F.concat(F.lit("Score:"), v, F.lit("%"))).when(kind == 2, "Score: n/a").otherwise("the Score:   7")
    return table(spark, sf_dir, "events").select("event_id", F.round(parsing.score(said), 6).alias("score"))


@query(
    """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN trim(split_part(text, chr(10), 1)) ELSE text END AS answer,
    CASE WHEN conv_id % 2 = 0 THEN 'because' ELSE '' END AS rationale, CASE WHEN conv_id % 2 = 0 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS score FROM conversations"""
)
def qa_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    said = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Answer: none\nRationale: because\nScore: 85%\nAnswer: "), first)).otherwise(F.col("text"))
    got = parsing.answer_parts(said)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", got["answer"].alias("answer"), got["rationale"].alias("rationale"), got["score"].alias("score"))


@query(
    """WITH r AS (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN [] WHEN item_id % 3 = 1 THEN ['only ' || item_id] ELSE ['one', 'two ' || item_id] END AS c FROM benchmark)
    SELECT item_id, CASE len(c) WHEN 0 THEN '' WHEN 1 THEN c[1] || chr(10) || chr(10) ELSE '[1] ' || c[1] || ' ' || chr(10) || chr(10) || '[2] ' || c[2] || chr(10) || chr(10) END || 'Question: ' || text || chr(10) || 'Options:' || chr(10) || '- yes' || chr(10) || '- no' AS prompt FROM r"""
)
def qa_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id") % 3
    contexts = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.concat(F.lit("only "), "item_id"))).otherwise(F.array(F.lit("one"), F.concat(F.lit("two "), "item_id"), F.lit("three")))
    return table(spark, sf_dir, "benchmark").select("item_id", X.question_prompt(F.col("text"), contexts, 2, F.array(F.lit("yes"), F.lit("no"))).alias("prompt"))


@query(
    """SELECT item_id, 'Entity Types:' || chr(10) || '- Person: a human' || chr(10) || '- Place: a location' || chr(10) || chr(10) || '[1] alpha ' || chr(10) || chr(10) || '[2] beta' || chr(10) || chr(10) ||
    'Text: ' || text || chr(10) || 'Answer:' AS prompt FROM benchmark"""
)
def ner_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.mention_prompt(F.array("text"), [("Person", "a human"), ("Place", "a location")], contexts=F.array(F.lit("alpha"), F.lit("beta"))).alias("prompt"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, v, list_reverse_sort(v)[3] AS f FROM e),
    y AS (SELECT vec_id, list_transform(v, lambda z: CASE WHEN z > v[1] AND z >= f THEN 1 ELSE 0 END) AS l FROM x)
    SELECT vec_id, array_to_string(list_prepend(CASE WHEN list_sum(l) = 0 THEN 1 ELSE 0 END, l[2:]), '') AS labels FROM y"""
)
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.array_join(X.adaptive_labels(F.col("v"), 3).cast("array<string>"), "").alias("labels"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)),
    t AS (SELECT doc_id, i, CASE length(w) % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'B' ELSE 'I' END AS h, CASE length(w) % 5 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'A' WHEN 3 THEN 'B' ELSE 'A' END AS k FROM w),
    s AS (SELECT *, CASE WHEN h = 'B' OR (h = 'I' AND (lag(h) OVER z IS NULL OR lag(h) OVER z = 'O' OR lag(k) OVER z <> k)) THEN 1 ELSE 0 END AS st FROM t WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s)
    SELECT doc_id AS doc_key, min(i)::INT AS "begin", max(i)::INT AS "end", min(k) AS entity_type FROM g WHERE h <> 'O' GROUP BY doc_id, g"""
)
def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.posexplode(T.words(F.col("text"))).alias("idx", "w"))
    tag = F.element_at(F.array(*(F.lit(t) for t in ("O", "B-A", "I-A", "I-B", "I-A"))), F.length("w") % 5 + 1)
    return X.bio_spans(w.select("doc_key", "idx", tag.alias("tag")))


@query()
def span_greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.gold_mentions(spark, sf_dir).withColumn("score", (F.col("m_idx") * 37 % 101).cast("double"))
    spans = m.groupBy("doc_key").agg(F.collect_list(F.struct("begin", "end", "entity_type", "score")).alias("s"))
    return spans.select("doc_key", F.inline(X.select_spans(F.col("s"))))


@query(
    """WITH e AS (SELECT l_orderkey AS d, l_partkey AS i, 'P' || l_partkey AS name, min(l_returnflag) AS ty FROM lineitem GROUP BY 1, 2), t(r, te) AS (VALUES ('r1', 'Is @ part of #?'), ('r2', 'Does @ use #?'))
    SELECT a.d AS doc_key, a.i AS arg1, r AS relation, b.i AS arg2, replace(replace(te, '@', a.name), '#', b.name) AS question, CASE WHEN r = 'r' || (a.i % 2 + 1) AND b.i > a.i THEN 'Yes' ELSE 'No' END AS answer
    FROM e a JOIN e b ON a.d = b.d AND a.i <> b.i, t WHERE a.ty = 'R' AND b.ty <> 'R' AND (a.i + b.i) % 5 <> 0"""
)
def pair_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    e = l.groupBy(F.col("l_orderkey").alias("doc_key"), F.col("l_partkey").alias("e_idx")).agg(F.min("l_returnflag").alias("entity_type")).withColumn("name", F.concat(F.lit("P"), "e_idx"))
    e = stage(e, "pair-entities")
    pairs = e.select("doc_key", F.col("e_idx").alias("arg1")).join(e.select("doc_key", F.col("e_idx").alias("arg2")), "doc_key").where("arg2 > arg1")
    templates = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(t).alias("template")) for r, t in (("r1", "Is @@@HEAD### part of @@@TAIL###?"), ("r2", "Does @@@HEAD### use @@@TAIL###?"))))))
    gold = pairs.select("doc_key", "arg1", F.concat(F.lit("r"), F.col("arg1") % 2 + 1).alias("relation"), "arg2")
    return X.pair_questions(e, templates, gold, [("R", "A"), ("R", "N")], pairs.where("(arg1 + arg2) % 5 = 0"))


@query(
    """WITH e AS (SELECT l_orderkey AS d, l_partkey AS i, min(l_returnflag) AS ty FROM lineitem GROUP BY 1, 2), t(r) AS (VALUES ('r1'), ('r2'))
    SELECT DISTINCT a.d AS doc_key, a.i AS arg1, r AS relation, b.i AS arg2
    FROM e a JOIN e b ON a.d = b.d AND a.i <> b.i, t WHERE a.ty = 'R' AND b.ty <> 'R' AND (a.i + b.i) % 5 <> 0 AND r = 'r' || (a.i % 2 + 1) AND b.i > a.i"""
)
def triples_from_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples that the yes-answers of ``pair_questions`` say, the answers in a generator's words."""
    said = pair_questions(spark, sf_dir).withColumn("answer", F.when(F.col("answer") == "Yes", " **yes**, it is.").otherwise("No: yes would be wrong"))
    return X.triples_from_answers(said)


@query(
    f"""WITH {evaluation.REL_SQL}, f AS (SELECT DISTINCT h, r, t FROM g)
    SELECT DISTINCT a.d AS doc_key, f.h AS head, f.r AS relation, f.t AS tail FROM oc a JOIN f ON a.en = f.h JOIN oc b ON b.d = a.d AND b.s = a.s AND b.en = f.t"""
)
def distant_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = evaluation.gold_relations(spark, sf_dir).select("head", "relation", "tail")
    return X.distant_triples(evaluation.occurrences(spark, sf_dir), facts)


@query("SELECT l_orderkey AS doc_key, l_suppkey % 3 AS arg1, l_returnflag AS relation, l_partkey % 3 AS arg2, min(l_linenumber)::INT AS pos FROM lineitem GROUP BY ALL")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_key"), (F.col("l_suppkey") % 3).alias("arg1"), F.col("l_returnflag").alias("relation"), (F.col("l_partkey") % 3).alias("arg2"), F.col("l_linenumber").alias("pos"))
    return X.first_triples(l, "pos")


@query(f"WITH {evaluation.GOLD_SQL} SELECT row_number() OVER (ORDER BY n DESC, doc_id)::INT AS rank, doc_id AS demo_key, n::DOUBLE AS score FROM (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1) ORDER BY n DESC, doc_id LIMIT 5")
def demonstrations_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = evaluation.gold_mentions(spark, sf_dir).groupBy("doc_key").agg(F.count(F.lit(1)).alias("n")).withColumn("pos", F.col("doc_key"))
    return X.demonstrations(pool, F.col("n"), 5)


@query("SELECT row_number() OVER (ORDER BY md5('5' || doc_id))::INT AS rank, doc_id AS demo_key, 1.0::DOUBLE AS score FROM documents ORDER BY md5('5' || doc_id) LIMIT 5")
def demonstrations_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.col("doc_id").alias("pos"))
    return X.demonstrations(pool, F.lit(1), 5, "random")


@query("SELECT DISTINCT 'P' || l_partkey AS entity_id, l_partkey % 3 <> 0 AS found FROM lineitem")
def found_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("entity_id"))
    pages = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"))
    return linking.found_and_missing(used, pages)


@query(
    f"""WITH {evaluation.GOLD_SQL} SELECT doc_id AS doc_key, m_idx::INT AS m_idx, ((row_number() OVER (PARTITION BY doc_id ORDER BY md5('3' || doc_id || m_idx), m_idx) - 1) // 16)::INT AS part FROM gold"""
)
def split_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.split_mentions(evaluation.gold_mentions(spark, sf_dir), 16).select("doc_key", "m_idx", "part")


@query(
    """SELECT label::INT AS label, pos::INT AS pos, round(ln(sum(exp(x))), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY label, pos"""
)
def entity_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return linking.pooled(e, ["label"], "v").select("label", F.posexplode("v").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(
    f"""WITH {evaluation.GOLD_SQL} SELECT doc_id AS doc_key, m_idx::INT AS m_idx, ent <> 'E7' AS in_kb, m_idx % 2 = 0 AS in_cand FROM gold"""
)
def knowledge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = evaluation.gold_mentions(spark, sf_dir)
    pages = gold.where("entity_id <> 'E7'").select("entity_id")
    seen = gold.where("m_idx % 2 = 0").select("doc_key", "m_idx", "entity_id")
    return linking.knowledge_flags(gold, pages, seen).select("doc_key", "m_idx", "in_kb", "in_cand")


@query(f"WITH {evaluation.GOLD_SQL} SELECT doc_id AS doc_key, count(*) AS mentions FROM gold WHERE ent <> 'E7' GROUP BY 1")
def linked_mentions_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators import filters

    gold = evaluation.gold_mentions(spark, sf_dir)
    return filters.drop_unlinked_mentions(gold, gold.where("entity_id <> 'E7'").select("entity_id").distinct()).groupBy("doc_key").agg(F.count(F.lit(1)).alias("mentions"))


@query(f"WITH {evaluation.REL_SQL} SELECT d::VARCHAR AS title, h AS h_idx, t AS t_idx, r FROM p")
def official_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluation.predicted_relations(spark, sf_dir).select(F.col("doc_key").cast("string").alias("doc_key"), F.col("head").alias("arg1"), "relation", F.col("tail").alias("arg2"))
    return metrics.official_rows(p)
