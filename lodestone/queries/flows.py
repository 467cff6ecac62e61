"""Longer flows: the flagship from triples to ranked chunks, extraction end to end, streams and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, graph, retrieval
from lodestone.plans.staging import shared_dir
from lodestone.queries import graphs, texts
from lodestone.queries.base import query, table
from lodestone.streaming import graph_upsert as U, operators as S

REPORT_CHUNKS_SQL = graphs.REPORT_SQL.replace("WITH ed AS", "WITH RECURSIVE ed AS") + """, d AS (
  SELECT community_id, list_filter(regexp_extract_all(text, '[^.!?
]+[.!?]*'), lambda x: trim(x) <> '') AS ss FROM rep
), s AS (SELECT community_id, i, ss[i] AS s, len(string_split(ss[i], ' ')) AS n FROM (SELECT community_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM d)), r AS (
  SELECT community_id, i, s, n AS held, 0 AS c FROM s WHERE i = 1
  UNION ALL
  SELECT s.community_id, s.i, s.s, CASE WHEN r.held >= 40 THEN s.n ELSE r.held + s.n END, CASE WHEN r.held >= 40 THEN r.c + 1 ELSE r.c END FROM r JOIN s ON s.community_id = r.community_id AND s.i = r.i + 1
), ch AS (SELECT community_id, c::INT AS chunk_index, string_agg(s, ' ' ORDER BY i) AS text FROM r GROUP BY community_id, c)
"""


@query(REPORT_CHUNKS_SQL + "SELECT community_id, chunk_index, text FROM ch")
def report_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_passages(graphs.place_reports(spark, sf_dir), 40).select("community_id", "chunk_index", "text")


@query(
    REPORT_CHUNKS_SQL
    + r""", p AS (SELECT community_id || '#' || chunk_index AS chunk, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM ch), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM p),
    tf AS (SELECT chunk, len, term, count(*) AS tf FROM (SELECT chunk, len(w) AS len, unnest(w) AS term FROM p) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT 'N' || n_nationkey AS q, unnest(['n' || n_nationkey, 'part_of', 'r' || n_regionkey]) AS term FROM nation),
    sc AS (SELECT q, chunk, sum(greatest(0, ln(n - df + 0.5) - ln(df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)
    SELECT q AS question, chunk, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, chunk) AS rank FROM sc) WHERE rank <= 3"""
)
def graph_to_ranked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples to graph, communities, reports, chunks, and the three best chunks for a question on each nation."""
    chunks = chunking.chunk_passages(graphs.place_reports(spark, sf_dir), 40)
    corpus = chunks.select(F.concat("community_id", F.lit("#"), "chunk_index").alias("chunk"), T.words(F.lower("text")).alias("terms"))
    n = table(spark, sf_dir, "nation")
    asked = n.select(F.concat(F.lit("N"), "n_nationkey").alias("question"), F.array(F.concat(F.lit("n"), "n_nationkey"), F.lit("part_of"), F.concat(F.lit("r"), "n_regionkey")).alias("terms"))
    out = retrieval.bm25_search(corpus, asked, "chunk", "question", 3, fill=False)
    return out.withColumn("score", F.round("score", 6))


def _run(df: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """A stream run to its end over what is there, as a table of its last state: files in the shared folder."""
    where = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    out = f"{where}/rows"  # an empty table where the stream has no rows
    spark.createDataFrame([], df.schema).write.parquet(out)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{where}/stream")
        writer.start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{where}/stream")
    # The whole state comes with every batch; a batch that is run again writes the same.
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")


HOURLY_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


def _hours(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


@query(HOURLY_SQL)
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(S.windowed_counts(table(spark, sf_dir, "events"), late=None))


@query(HOURLY_SQL)
def events_tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(_run(S.windowed_counts(_stream(spark, sf_dir, "events")), spark, "complete"))


@query(
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM
    (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2"""
)
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(S.windowed_counts(table(spark, sf_dir, "events"), size="2 hours", slide="1 hour", late=None))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, g"""
)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.sessions(table(spark, sf_dir, "events"), late=None)
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT 'U' || user_id AS head, event_type AS relation, 'K' || json_extract_string(props, '$.k') AS tail, count(*) AS n FROM events GROUP BY ALL")
def edges_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events")
    t = e.select(F.concat(F.lit("U"), "user_id").alias("head"), F.col("event_type").alias("relation"), F.concat(F.lit("K"), F.get_json_object("props", "$.k")).alias("tail"))
    return _run(S.edge_stream(t), spark, "complete")


def _upserted(spark: SparkSession, sf_dir: str, what: str) -> str:
    """The nodes or the edges of all triples where suppliers and nations are known beforehand and orders arrive as a stream."""
    where = f"{shared_dir(spark)}/graphs/{uuid.uuid4().hex}"
    arriving = graph.ordered_triples(graphs.sold_of(_stream(spark, sf_dir, "lineitem")))
    known = graphs.existing(spark, sf_dir)
    known = graph.ordered_triples(known.withColumn("doc_key", F.lit(None).cast("string")).limit(0), known)
    for q in U.start_upserts(arriving, where, known, what=(what,)):
        q.awaitTermination()
    return where


@query(f"WITH {graphs.NODES_SQL} SELECT * FROM nodes")
def kg_nodes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of ``kg_nodes``, upserted from a stream."""
    return U.nodes_now(spark, _upserted(spark, sf_dir, "nodes"), graphs.dictionary(spark, sf_dir))


@query(f"WITH {graphs.EDGES_SQL} SELECT * FROM edges")
def kg_edges_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of ``kg_edges``, upserted from a stream."""
    return U.edges_now(spark, _upserted(spark, sf_dir, "edges"))


@query(texts.CHUNKS_SQL + "SELECT count(*) AS chunks, sum(len(string_split(text, ' ')))::BIGINT AS words FROM chunks")
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(S.chunk_stream(_stream(spark, sf_dir, "documents").select("doc_id", "text"), 100), spark, "append")
    return out.agg(F.count(F.lit(1)).alias("chunks"), F.sum(T.spaced_length(F.col("text")).cast("bigint")).alias("words"))
