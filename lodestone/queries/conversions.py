"""Conversions of corpora and knowledge bases: mentions in text, sentences, dictionaries, prompts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, extraction, facades, filters, graph, kb, linking, questions, reports, retrieval, segments
from lodestone.queries import graphs, tasks
from lodestone.queries.base import query, table
from lodestone.queries.texts import SENTENCES_SQL

# Turns of conversations as short texts, a key each.
TURNS_SQL = r"""
tn AS (SELECT conv_id * 1000 + turn AS key, text, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM conversations),
tw AS (SELECT key, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM tn),
tm AS (SELECT key, i AS b, least(i + length(w) % 3, n - 1) AS e, 'T' || length(w) % 4 AS ty FROM tw WHERE length(w) >= 6)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, text, ws (its words)."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text", T.words(F.col("text")).alias("ws"))


@query(
    f"""WITH {TURNS_SQL}, op AS (SELECT key, b, repeat('{{', count(*)) AS o FROM tm GROUP BY 1, 2), cl AS (SELECT key, e, string_agg(':' || ty || '}}', '' ORDER BY e - b, b, ty) AS c FROM tm GROUP BY 1, 2)
    SELECT tw.key, string_agg(coalesce(o, '') || w || coalesce(c, ''), ' ' ORDER BY i) AS marked FROM tw LEFT JOIN op ON op.key = tw.key AND b = i LEFT JOIN cl ON cl.key = tw.key AND e = i GROUP BY 1"""
)
def mention_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("ws")
    one = lambda w, i: F.struct(
        i.alias("begin"), F.least(i + F.length(w) % 3, n - 1).alias("end"), F.concat(F.lit("T"), F.length(w) % 4).alias("entity_type"), (F.length(w) >= 6).alias("ok")
    )
    found = turns(spark, sf_dir).withColumn("m", F.filter(F.transform("ws", one), lambda m: m["ok"])).where("size(ws) > 0")
    return found.select("key", chunking.mark_mentions(F.col("ws"), F.col("m")).alias("marked"))


# Sentences of documents and mentions placed on their words.
PLACED_SQL = f"""
ds AS ({SENTENCES_SQL}), se AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS sent_idx FROM ds),
sw AS (SELECT *, list_filter(string_split_regex(sentence, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM se),
so AS (SELECT *, len(ws) AS n_tokens, coalesce(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_token FROM sw),
tk AS (SELECT doc_id, sent_idx, first_token + k AS token, w FROM (SELECT doc_id, sent_idx, first_token, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM so)),
mn AS (SELECT doc_id, token AS b, token + length(w) % 5 AS e FROM tk WHERE length(w) >= 10)
"""


def placed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))
    return chunking.sentence_offsets(docs)


def placed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_key, sent_idx, token (its place in the document), w."""
    each = placed_sentences(spark, sf_dir).select("doc_key", "sent_idx", "first_token", F.posexplode(T.words(F.col("sentence"))).alias("_k", "w"))
    return each.select("doc_key", "sent_idx", (F.col("first_token") + F.col("_k")).alias("token"), "w")


def placed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ten characters or more with up to four words after them."""
    return placed_tokens(spark, sf_dir).where("length(w) >= 10").select("doc_key", F.col("token").alias("begin"), (F.col("token") + F.length("w") % 5).alias("end"))


@query(f"WITH {PLACED_SQL} SELECT doc_id AS doc_key, sent_idx, n_tokens, first_token FROM so")
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_sentences(spark, sf_dir).select("doc_key", F.col("sent_idx").cast("bigint").alias("sent_idx"), "n_tokens", "first_token")


@query(
    f"""WITH {PLACED_SQL}, me AS (SELECT doc_id, b, max(e) OVER (PARTITION BY doc_id ORDER BY b) AS reach FROM mn), lo AS (SELECT so.*, me.reach FROM so ASOF LEFT JOIN me ON so.doc_id = me.doc_id AND so.first_token > me.b),
    gr AS (SELECT *, sum(CASE WHEN sent_idx > 0 AND (reach IS NULL OR reach < first_token) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS g FROM lo)
    SELECT doc_id AS doc_key, g::BIGINT AS sent_idx, string_agg(sentence, ' ' ORDER BY gr.sent_idx) AS sentence FROM gr GROUP BY 1, 2"""
)
def merged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = placed_sentences(spark, sf_dir).select("doc_key", "sent_idx", "sentence")
    return chunking.merge_crossed_sentences(sentences, placed_mentions(spark, sf_dir)).select("doc_key", "sent_idx", "sentence")


@query(f"WITH {PLACED_SQL}, sp AS (SELECT doc_id, token AS b, token + length(w) % 14 AS e FROM tk) SELECT sp.doc_id AS doc_key, b AS begin, e AS \"end\" FROM sp JOIN tk x ON x.doc_id = sp.doc_id AND x.token = b JOIN tk y ON y.doc_id = sp.doc_id AND y.token = e WHERE e - b <= 10 AND x.sent_idx = y.sent_idx")
def spans_within_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is one row, its tokens' lengths and sentences are arrays."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.transform(T.sentences(F.col("text")), lambda s: F.transform(T.words(s), F.length)).alias("n"))
    d = d.select("doc_key", F.flatten("n").alias("lengths"), F.flatten(F.transform("n", lambda s, i: F.array_repeat(i, F.size(s)))).alias("sentence_of"))
    spans = F.transform("lengths", lambda n, i: F.struct(i.cast("bigint").alias("begin"), (i + n % 14).cast("bigint").alias("end")))
    return d.select("doc_key", F.inline(filters.within_sentences(spans, F.col("sentence_of"))))


@query(
    rf"""WITH {TURNS_SQL}, ch AS (SELECT key, list_transform(string_split(text, ''), lambda c, i: CASE WHEN i > 1 AND i - 1 IN (key % 7, key % 7 + 3, 9, 15) THEN ' ' || c ELSE c END) AS cs FROM tn)
    SELECT key, regexp_replace(array_to_string(cs, ''), '([()\[\]])', ' \1 ', 'g') AS spaced FROM ch"""
)
def spaced_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("key") % 7).cast("int")
    spans = F.array(F.struct(at.alias("begin"), (at + 3).alias("end")), F.struct(F.lit(9).alias("begin"), F.lit(15).alias("end")))
    return turns(spark, sf_dir).select("key", chunking.space_mentions(F.col("text"), spans).alias("spaced"))


@query(
    f"""WITH {TURNS_SQL}, en AS (SELECT key, list_transform(range(1, len(ws) + 1), lambda i: list_sum(list_transform(ws[1:i], lambda w: length(w)))) AS ends, (key % 11) AS b, (key % 11 + 5) AS e FROM tn)
    SELECT key, len(list_filter(ends, lambda x: x <= b))::INT AS first_word, len(list_filter(ends, lambda x: x <= e - 1))::INT AS last_word FROM en"""
)
def aligned_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("key") % 11).cast("int")
    span = chunking.align_characters(F.col("ws"), at, at + 5)
    return turns(spark, sf_dir).select("key", span.alias("s")).select("key", F.col("s.begin").alias("first_word"), F.col("s.end").alias("last_word"))


@query(
    f"""WITH {TURNS_SQL}, bl AS (SELECT key, i, CASE WHEN i % 4 = 2 THEN ' ' ELSE w END AS t FROM tw)
    SELECT key AS doc_key, i::INT AS old_idx, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS new_idx, t AS token FROM bl WHERE trim(t) <> ''"""
)
def blank_tokens_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = turns(spark, sf_dir).select(F.col("key").alias("doc_key"), F.posexplode("ws").alias("idx", "w"))
    return chunking.drop_blank_tokens(each.select("doc_key", "idx", F.when(F.col("idx") % 4 == 2, " ").otherwise(F.col("w")).alias("token")))


@query("SELECT doc_id, 'Passage#' || (row_number() OVER (ORDER BY doc_id) - 1) AS doc_key FROM documents")
def passage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.passage_keys(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "doc_key")


@query("SELECT doc_id, md5(lower(nfc_normalize(text))) AS digest FROM documents")
def composed_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(segments.composed_lower(F.col("text"))).alias("digest"))


@query("SELECT p_partkey, p_name || '|' || p_brand || '''s' AS items FROM part")
def quoted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List literals with both kinds of quotes and an escaped one."""
    p = table(spark, sf_dir, "part")
    literal = F.concat(F.lit('["'), "p_name", F.lit("\", '"), "p_brand", F.lit("\\'s']"))
    return p.select("p_partkey", F.array_join(kb.python_list(literal), "|").alias("items"))


# Questions, splits and documents.


@query(
    """SELECT p_partkey AS question_key, unnest(CASE WHEN p_partkey % 4 = 3 THEN [p_name] ELSE [p_name, p_brand, p_type] END) AS answer,
    CASE p_partkey % 4 WHEN 0 THEN 'yesno' WHEN 1 THEN 'factoid' WHEN 2 THEN 'list' ELSE 'summary' END AS answer_type,
    unnest(CASE WHEN p_partkey % 4 = 3 THEN [0] WHEN p_partkey % 4 = 1 THEN [0, 0, 0] ELSE [0, 0, 1] END)::INT AS list_index FROM part"""
)
def typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(x) for x in ("yesno", "factoid", "list", "summary"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    exact = F.array(F.array("p_name", "p_brand"), F.array("p_type"))
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_key"), F.inline(filters.answers_of_type(kind, exact, F.col("p_name"))))
    return found.select("question_key", "answer", "answer_type", "list_index")


@query("SELECT l_orderkey AS doc_key, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def documents_with_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    docs = lines.groupBy(F.col("l_orderkey").alias("doc_key")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct("l_suppkey", "l_partkey"))).alias("relations"))
    return filters.with_relations(docs).select("doc_key", F.size("relations").cast("bigint").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def split_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return filters.in_split(docs, table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query(
    """SELECT 'S' || l_suppkey AS head, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'supplies' END AS relation, 'P' || l_partkey AS tail, 'O' || l_orderkey AS doc_key,
    (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) - 1)::INT AS pos FROM lineitem"""
)
def triples_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: two entities a line, related by position."""
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")))
    docs = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("O"), "l_orderkey").alias("doc_key")).agg(held.alias("ls"))
    one = lambda mark, x: F.struct(F.concat(F.lit(mark), x).alias("entity_id"))
    entities = F.flatten(F.transform("ls", lambda x: F.array(one("S", x["l_suppkey"]), one("P", x["l_partkey"]))))
    relations = F.transform("ls", lambda x, i: F.struct((i * 2).alias("arg1"), F.when(x["l_returnflag"] == "R", "returned").otherwise("supplies").alias("relation"), (i * 2 + 1).alias("arg2")))
    return graph.triples_of_documents(docs.select("doc_key", entities.alias("entities"), relations.alias("relations")))


@query(f"WITH {graphs.TRIPLES_SQL} SELECT head, relation, tail, doc_key, part, pos FROM t")
def ingestion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.triples(spark, sf_dir).select("head", "relation", "tail", "doc_key", "ingest.part", "ingest.pos")


# Knowledge bases.


@query(
    """WITH s AS (SELECT DISTINCT p_type AS r, CASE WHEN p_size % 3 = 0 THEN lower(p_brand) ELSE p_brand END AS a, 'Size' || p_size % 10 AS b FROM part),
    n AS (SELECT DISTINCT p_type AS r FROM part UNION SELECT 'unrelated')
    SELECT n.r AS relation, string_agg(a || '>' || b, '|' ORDER BY a, b) AS pairs FROM n LEFT JOIN s ON s.r = n.r AND regexp_matches(a, '^[A-Z]') GROUP BY 1"""
)
def relation_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    structure = p.select(F.when(F.col("p_size") % 3 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("arg1"), F.col("p_type").alias("relation"), F.concat(F.lit("Size"), F.col("p_size") % 10).alias("arg2"))
    names = p.select(F.col("p_type").alias("relation")).union(spark.range(1).select(F.lit("unrelated"))).distinct()
    out = kb.relation_signatures(names, structure)
    return out.select("relation", F.array_join(F.transform("pairs", lambda x: F.concat(x["arg1"], F.lit(">"), x["arg2"])), "|").alias("pairs"))


CATEGORY_SQL = "CASE chr(65 + (p_partkey % 26)::INT) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kb.TREE_CATEGORIES.items()) + " END"


@query(
    f"""SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL ELSE {CATEGORY_SQL} END AS category,
    concat_ws(' ', nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_name END), ''), nullif(trim(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END), '')) AS description FROM part"""
)
def heading_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category by the first tree number and the joined description; some have no number, notes or scope."""
    p = table(spark, sf_dir, "part")
    number = F.concat(F.char(65 + F.col("p_partkey") % 26), F.lit("01."), F.col("p_size"))
    numbers = F.when(F.col("p_size") == 1, F.array().cast("array<string>")).otherwise(F.array(number, F.lit("A01")))
    note = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_name"))
    scope = F.when(F.col("p_size") % 5 != 0, F.col("p_type"))
    return p.select("p_partkey", kb.tree_category(numbers).alias("category"), kb.described(note, scope).alias("description"))


@query("SELECT replace(p_name, ' ', '_') AS entity_id, p_name AS canonical_name, p_type AS description FROM part")
def article_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.article_dictionary(table(spark, sf_dir, "part"), "p_name", "p_type").select("entity_id", "canonical_name", "description")


@query("SELECT replace(p_brand || ' ' || p_type, ' ', '_') AS entity_id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("title"), F.col("p_name").alias("text"))
    return kb.duplicates(kb.article_dictionary(titled), "entity_id")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN p_name || '|' || p_brand || '|' || p_type ELSE p_name || '|' || p_type END AS names FROM part")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = F.when(F.col("p_size") % 2 == 1, F.array("p_brand", "p_name"))
    names = questions.entity_names(F.col("p_name"), synonyms, F.array("p_type", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, "|").alias("names"))


@query("SELECT p_partkey FROM part ORDER BY md5('5|' || p_partkey), p_partkey LIMIT 100")
def question_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.sampled(table(spark, sf_dir, "part").select("p_partkey"), 100, "5", "p_partkey")


# Prompts, rerankers, reports and answers.

ENTITIES_SQL = "SELECT 'N' || s_nationkey AS doc_key, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array("s_name", F.concat(F.lit("S"), "s_suppkey"), "s_name")
    one = F.struct("s_suppkey", names.alias("mention_names"), F.upper("s_name").alias("canonical_name"))
    return table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("N"), "s_nationkey").alias("doc_key")).agg(F.array_sort(F.collect_list(one)).alias("e"))


@query(
    f"""SELECT doc_key, string_agg('- Entity' || i || ': ' || s_name || ', S' || s_suppkey, chr(10) ORDER BY i) AS all_names, string_agg('- Entity' || i || ': ' || s_name, chr(10) ORDER BY i) AS first_names,
    string_agg('- Entity' || i || ': ' || upper(s_name), chr(10) ORDER BY i) AS canonical_names FROM ({ENTITIES_SQL}) GROUP BY 1"""
)
def entity_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {"all": "all_names", "first": "first_names", "canonical": "canonical_names"}
    return _entities(spark, sf_dir).select("doc_key", *(extraction.entity_listing(F.col("e"), h).alias(c) for h, c in how.items()))


@query(f"SELECT doc_key, '- ' || doc_key || coalesce(string_agg(chr(10) || '  * S' || s_suppkey || ' | ' || s_name, '' ORDER BY i) FILTER (i < 3), '') AS lines FROM ({ENTITIES_SQL}) GROUP BY 1")
def linking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three candidates of each mention, as a prompt shows them."""
    candidates = F.transform("e", lambda x: F.struct(F.concat(F.lit("S"), x["s_suppkey"]).alias("entity_id"), F.get(x["mention_names"], F.lit(0)).alias("canonical_name")))
    mention = F.array(F.struct(F.col("doc_key").alias("name"), candidates.alias("candidates")))
    return _entities(spark, sf_dir).select("doc_key", extraction.linking_lines(mention, 3).alias("lines"))


@query(f"SELECT doc_key, m_idx, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, m_idx ORDER BY -floor(score / 1000) DESC, rank) AS r FROM ({tasks.RANKED_SQL})) WHERE r = 1")
def rescored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scorer that sees thousands only, so that the first one's order decides ties."""
    return linking.rescored(tasks._candidates(spark, sf_dir), -F.floor(F.col("score") / 1000))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'No Title' WHEN 3 THEN 'No Title' ELSE 'T' || event_id END AS title,
    CASE event_id % 4 WHEN 0 THEN event_type || chr(10) || chr(10) || '[Finding 1] a: b' || chr(10) || chr(10) || '[Finding 2] c: d' WHEN 1 THEN event_type WHEN 2 THEN 'no report of ' || event_type ELSE '{"summary": "' || event_type || '"}' END AS text FROM events"""
)
def parsed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with findings, among other words, not as JSON, and without a title."""
    kind, e = F.col("event_id") % 4, F.col("event_type")
    titled = F.concat(F.lit('{"title": "T'), "event_id", F.lit('", "summary": "'), e)
    full = F.concat(titled, F.lit('", "findings": [{"summary": "a", "explanation": "b"}, {"summary": "c", "explanation": "d"}]}'))
    said = F.when(kind == 0, full).when(kind == 1, F.concat(F.lit("Here: "), titled, F.lit('"} end'))).when(kind == 2, F.concat(F.lit("no report of "), e)).otherwise(F.concat(F.lit('{"summary": "'), e, F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", reports.parse_report(said).alias("r")).select("event_id", "r.title", "r.text")


ASKED = "Answer in brief.\n{contexts}\nQ: {question}"


@query(
    f"""WITH {TURNS_SQL}, q AS (SELECT key, 'Answer in brief.' || chr(10) || text || chr(10) || 'Q: turn ' || key AS prompt FROM tn WHERE trim(text) <> '')
    SELECT key AS question_key, prompt, 'read ' || length(prompt) AS answer FROM q"""
)
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question answering with a stand-in generator that tells how long the prompt is."""
    t = turns(spark, sf_dir).where("trim(text) <> ''")
    asked = t.select(F.col("key").alias("question_key"), F.concat(F.lit("turn "), "key").alias("question"))
    contexts = t.select(F.col("key").alias("question_key"), F.lit(1).alias("rank"), "text")
    said = lambda p: F.concat(F.lit("read "), F.length(p))
    return facades.answers(asked, ASKED, said, contexts=contexts).select("question_key", "prompt", "answer")


# Late interaction: an embedding as four token vectors of sixteen places.
_TOKEN_SCORES = " + ".join(f"greatest({', '.join(f'list_inner_product(q.v[{16 * i + 1}:{16 * i + 16}], e.v[{16 * j + 1}:{16 * j + 16}])' for j in range(4))})" for i in range(4))


@query(
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, {_TOKEN_SCORES} AS score FROM e q JOIN e ON q.vec_id % 50 = 0)
    SELECT query_id, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def late_interaction_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all rows for each query of the stated set (ids divisible by 50)."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", parts.alias("tokens"))
    asked = corpus.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.late_search(corpus, asked, "vec_id", "query_id", "tokens", 10, 16).select("query_id", "vec_id", "rank")
