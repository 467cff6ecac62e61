"""The subpackage's queries and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import classifier, decontaminate, importance, jaccard, licenses, mixing, pages, rules, sharding, spelling, suffixes, tokens, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a stream mixed by the square roots of the sources' sizes."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), power=0.5, block_rows=32)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), length=100).drop("spans")


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = classifier.score(docs, classifier.fit(docs, _table(spark, sf_dir, "labels")), threshold=0.3)
    return out.select("doc_id", classifier.held_out().alias("held_out"), "score", "predicted")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_size(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rules_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_token_counts": op2_token_counts,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_extract_html": op5_extract_html,
        "op6_scan_licenses": op6_scan_licenses,
        "op7_quality_rules": op7_quality_rules,
        "op8_decontaminate": op8_decontaminate,
        "op9_shard": op9_shard,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_url_filter": op12_url_filter,
        "op13_importance_resample": op13_importance_resample,
    }


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 3)
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), n AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d) d
  LEFT JOIN n USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), h AS (
  SELECT source, count(*) AS k, count(*) FILTER (base_failed) AS b FROM f GROUP BY source
), p AS (
  SELECT avg(b / k) AS m, var_pop(b / k) AS v FROM h
), q AS (
  SELECT m, least(10000.0, CASE WHEN v > 0 AND m > 0 AND m < 1 AND m * (1 - m) / v > 1.5 THEN m * (1 - m) / v - 1 ELSE 10.0 END) AS w FROM p
), z AS (
  SELECT source, (b + m * w) / (k + w) > 0.5 AS bad FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bad AS kept
FROM f JOIN z ON f.source IS NOT DISTINCT FROM z.source
"""


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), b AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT x AS node, x AS seen FROM b UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen
), c AS (
  SELECT node, min(seen) AS component FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

OP4_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS s FROM d)
), k AS (
  SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, s) > 1
), g AS (
  SELECT doc_id, s, CASE WHEN s - lag(s) OVER z <= 100 THEN 0 ELSE 1 END AS fresh FROM k WINDOW z AS (PARTITION BY doc_id ORDER BY s)
), i AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g) GROUP BY doc_id, run
), p AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER z, 0) AS e FROM i WINDOW z AS (PARTITION BY doc_id ORDER BY a)
), t AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, lower(sha256(unhex(coalesce(kept, h)))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


#: crc32 of the UTF-8 bytes of {s}, given the table k.tab of the 256 byte values.
_CRC_TABLE = "SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab"
_CRC = "xor(list_reduce([4294967295] || list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, k.tab[(xor(a, b) & 255) + 1])), 4294967295)"

OP11_SQL = f"""
WITH RECURSIVE k AS MATERIALIZED ({_CRC_TABLE}), r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents
), p AS (
  SELECT id, translate(x, '{spelling.UPPER}', '{spelling.LOWER}') AS x, count(*) AS n FROM r WHERE length(x) >= 6 GROUP BY ALL
), h AS (
  SELECT x, n, {_CRC.format(s="id || ':' || x")} AS h FROM p, k
), w AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN substr(x, 1, (h % length(x))::INT) || substr(x, (h % length(x))::INT + 2) ELSE x END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), v AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), e AS MATERIALIZED (
  SELECT a.word, b.word AS near FROM v a JOIN v b ON a.i = b.i AND a.a = b.a AND a.z = b.z AND a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON v.a || v.z = w.word
  UNION SELECT w.word, v.word FROM v JOIN w ON v.a || v.z = w.word
), m AS (
  SELECT e.word, e.near, w.n AS m FROM e JOIN w ON w.word = e.near
), b AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, m FROM m QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, near) = 1
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.near END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM w LEFT JOIN b USING (word)
), c AS (
  SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f z ON z.word = c.root AND z.form IS NULL
"""


def _op12_sql(rounds: int = 20) -> str:
    """Rules, seeds and the rounds of propagation, one table a round."""
    link = url_filter.HYPERLINK.replace("'", "''")
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    lower = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
    steps = ["m0 AS MATERIALIZED (SELECT host, kind, floor(seed * (1 - 0.85::DOUBLE))::BIGINT AS own, floor(seed * (1 - 0.85::DOUBLE))::BIGINT AS mass FROM given)"]
    for i in range(rounds):
        sent = f"SELECT w.kind, w.dst AS host, sum(floor(m.mass * w.share)::BIGINT) AS got FROM m{i} m JOIN ways w ON w.kind = m.kind AND w.host = m.host GROUP BY 1, 2"
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT m.host, m.kind, m.own, (m.own + coalesce(s.got, 0))::BIGINT AS mass FROM m{i} m LEFT JOIN ({sent}) s ON s.kind = m.kind AND s.host = m.host)")
    return f"""
WITH rules(rule_host, rule_path, says) AS (VALUES {rules}), u AS MATERIALIZED (
  SELECT row_number() OVER () AS k, page_id, coalesce(html, '') AS html,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), {lower}) AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fits AS (
  SELECT k, rule_host || rule_path AS rule, says FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, says DESC) = 1
), told AS MATERIALIZED (
  SELECT u.k, page_id, host, path, rule, says FROM u LEFT JOIN fits USING (k)
), seeds AS MATERIALIZED (
  SELECT host, floor(count(*) FILTER (says = 'allow') * 1e9 / count(*))::BIGINT AS trust, floor(count(*) FILTER (says = 'block') * 1e9 / count(*))::BIGINT AS distrust
  FROM told WHERE host <> '' GROUP BY host
), found AS MATERIALIZED (
  SELECT src, translate(dst, {lower}) AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM u) WHERE src <> '' AND src <> translate(dst, {lower})
), named AS MATERIALIZED (
  SELECT host FROM seeds UNION SELECT dst FROM found
), above AS (
  SELECT a.host, b.host AS domain FROM named a JOIN named b ON ends_with(a.host, '.' || b.host)
  QUALIFY row_number() OVER (PARTITION BY a.host ORDER BY length(b.host) DESC) = 1
), links AS MATERIALIZED (
  SELECT src, dst FROM found UNION ALL SELECT host, domain FROM above UNION ALL SELECT domain, host FROM above
), both_ways AS (
  SELECT 'trust' AS kind, src AS host, dst FROM links UNION ALL SELECT 'distrust', dst, src FROM links
), ways AS MATERIALIZED (
  SELECT kind, host, dst, 0.85::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY kind, host) AS share FROM both_ways GROUP BY kind, host, dst
), given AS (
  SELECT host, kind, coalesce(CASE kind WHEN 'trust' THEN trust ELSE distrust END, 0) AS seed FROM named LEFT JOIN seeds USING (host), (VALUES ('trust'), ('distrust')) AS t(kind)
), {", ".join(steps)}, masses AS (
  SELECT host, sum(mass) FILTER (kind = 'trust') AS trust, sum(mass) FILTER (kind = 'distrust') AS distrust FROM m{rounds} GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN distrust > trust AND distrust >= 75000000 THEN 'block' ELSE 'allow' END) AS verdict
FROM told LEFT JOIN masses USING (host)
"""


OP13_SQL = rf"""
WITH k AS MATERIALIZED ({_CRC_TABLE}), d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark
), f AS MATERIALIZED (
  SELECT row, unnest(w) AS x FROM d
), c AS MATERIALIZED (
  SELECT x, {_CRC.format(s="x")} % 10000 AS bucket FROM (SELECT x FROM f UNION SELECT x FROM b), k
), s AS (
  SELECT bucket, count(*) AS s FROM f JOIN c USING (x) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN c USING (x) GROUP BY bucket
), g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), m AS (
  SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN c USING (x) JOIN g USING (bucket) GROUP BY row
), z AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN m USING (row)
), r AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS n FROM z WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= (SELECT count(*) FROM r) * 10 // 100 THEN n END AS rank FROM z LEFT JOIN r USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jaccard_join": OP3_SQL,
        "op4_suffix_dedup": OP4_SQL,
        "op7_quality_rules": OP7_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_url_filter": _op12_sql(),
        "op13_importance_resample": OP13_SQL,
    }
