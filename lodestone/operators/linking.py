"""Mentions, entities and candidates: aggregation, dictionary linking, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import edit_search, retrieval

NO_PREDICTION = "NO-PRED"


def aggregate_mentions(mentions: DataFrame, key: str = "doc_key") -> DataFrame:
    """Entities of each document: key, e_idx, entity_id, entity_type, mention_indices, mention_names.

    Entities stand in the order of their first mention, whose type they take.
    ``mentions``: key, m_idx, name, entity_type, entity_id.
    """
    members = F.array_sort(F.collect_list(F.struct("m_idx", "name")))
    grouped = mentions.groupBy(key, "entity_id").agg(F.min_by("entity_type", "m_idx").alias("entity_type"), F.min("m_idx").alias("_first"), members.alias("_m"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1
    return grouped.select(
        key, place.alias("e_idx"), "entity_id", "entity_type", F.transform("_m", lambda m: m["m_idx"]).alias("mention_indices"), F.transform("_m", lambda m: m["name"]).alias("mention_names")
    )


def name_as_id(mentions: DataFrame, k: int = 10) -> DataFrame:
    """The stand-in linker: entity_id is the lower-cased name, with ``k`` equal candidates of score 1."""
    out = mentions.withColumn("entity_id", F.lower("name"))
    return out.withColumn("candidates", F.array_repeat(F.struct("entity_id", F.lit(1.0).alias("score")), k))


def padded(candidates: Column, k: int) -> Column:
    """A candidate list filled up to ``k`` by repeating its last; an empty list stays empty."""
    more = F.array_repeat(F.try_element_at(candidates, F.lit(-1)), F.greatest(F.lit(0), F.lit(k) - F.size(candidates)))
    return F.when(F.size(candidates) > 0, F.concat(candidates, more)).otherwise(candidates)


def dictionary_passages(dictionary: DataFrame) -> DataFrame:
    """One passage per name: entity_id, title (canonical name or synonym), text (description or empty)."""
    names = F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    return dictionary.select("entity_id", F.posexplode(names).alias("name_idx", "title"), F.coalesce("description", F.lit("")).alias("text"))


def lexical_candidates(mentions: DataFrame, passages: DataFrame, terms, k: int, key: str = "doc_key", method: str = "bm25", **params) -> DataFrame:
    """Ranked candidate entities of each mention: key, m_idx, rank, entity_id, score.

    ``passages`` from ``dictionary_passages`` with a unique passage_id;
    ``terms``: Column -> array Column. Equal names are searched once. The best
    passage of an entity counts.
    """
    names = mentions.select(F.lower("name").alias("_name")).distinct()
    if method == "bm25":
        corpus = passages.select("passage_id", "entity_id", terms(F.lower(F.concat_ws(" ", "title", "text"))).alias("terms"))
        found = retrieval.bm25_search(corpus, names.select("_name", terms(F.col("_name")).alias("terms")), "passage_id", "_name", k, group="entity_id", fill=False, **params)
    else:
        titles = passages.select("entity_id", "passage_id", F.lower("title").alias("_t")).where("_t IS NOT NULL")
        held = titles.groupBy("_t").agg(F.countDistinct("entity_id").alias("_held"))
        # With at most ``most`` texts an entity, the k * most nearest belong to k entities at least.
        most = titles.groupBy("entity_id").agg(F.countDistinct("_t").alias("n")).agg(F.max("n")).first()[0] or 1
        near = edit_search.nearest_texts(held, names.select(F.col("_name").alias("_q")).where("_q IS NOT NULL"), k * most)
        scored = near.join(titles, "_t").select(F.col("_q").alias("_name"), "passage_id", "entity_id", (F.lit(1.0) / (F.col("_d") + 1)).alias("score"))
        found = retrieval.ranked(scored, "_name", "passage_id", k, group=F.col("entity_id"))
    return mentions.select(key, "m_idx", F.lower("name").alias("_name")).join(found, "_name").select(key, "m_idx", "rank", "entity_id", "score")


def top_candidate(mentions: DataFrame, candidates: DataFrame, key: str = "doc_key") -> DataFrame:
    """Mentions with entity_id set to their first candidate (null without any)."""
    best = candidates.where("rank = 1").select(key, "m_idx", "entity_id")
    return mentions.drop("entity_id").join(best, [key, "m_idx"], "left")


def rescored(candidates: DataFrame, score: Column, key: str = "doc_key") -> DataFrame:
    """The best candidate of each mention by a new score (ties: better old rank)."""
    return candidates.groupBy(key, "m_idx").agg(F.max_by("entity_id", F.struct(score, -F.col("rank"))).alias("entity_id"))


def hard_negatives(scored: DataFrame, query: str, n: int) -> DataFrame:
    """The first ``n`` negative entities of each query: query, entity_id, kind, rank.

    ``scored``: query, gold_id, vec_id, entity_id, score. Kind 1 (hard)
    scores at least as high as the best gold row, kind 2 lower; without a gold
    row the bar is -1. Ordered by kind, then score; an entity counts once.
    """
    bar = scored.where("entity_id = gold_id").groupBy(query).agg(F.max("score").alias("_bar"))
    kinds = scored.where("entity_id <> gold_id").join(bar, query, "left").withColumn("kind", F.when(F.col("score") >= F.coalesce("_bar", F.lit(-1.0)), 1).otherwise(2))
    first = F.row_number().over(Window.partitionBy(query, "entity_id").orderBy("kind", F.desc("score"), "vec_id"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy("kind", F.desc("score"), "entity_id"))
    return kinds.withColumn("_f", first).where("_f = 1").withColumn("rank", rank).where(F.col("rank") <= n).select(query, "entity_id", "kind", "rank")


def fill_negatives(chosen: DataFrame, pool: DataFrame, query: str, n: int, seed: str = "7") -> DataFrame:
    """Lists shorter than ``n`` filled with other entities of ``pool`` (query, entity_id) in a seeded order; kind 3."""
    rest = pool.join(chosen, [query, "entity_id"], "left_anti").withColumn("kind", F.lit(3))
    rest = rest.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.md5(F.concat(F.lit(seed), F.col(query).cast("string"), F.col("entity_id").cast("string"))))))
    both = chosen.select(query, "entity_id", "kind", "rank").union(rest.select(query, "entity_id", "kind", "rank"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("kind") == 3, "rank"))
    return both.withColumn("rank", place).where(F.col("rank") <= n)


def gold_first(candidates: Column, gold: Column, k: int) -> Column:
    """A candidate list with the gold entity at its head: moved there, or put in place of the last of ``k``."""
    others = F.filter(candidates, lambda c: c["entity_id"] != gold["entity_id"])
    return F.slice(F.concat(F.array(gold), others), 1, k)


def knowledge_flags(mentions: DataFrame, dictionary: DataFrame, candidates: DataFrame | None = None, key: str = "doc_key") -> DataFrame:
    """Mentions with in_kb (entity in the dictionary) and in_cand (gold among the candidates)."""
    known = dictionary.select("entity_id").distinct().withColumn("in_kb", F.lit(True))
    out = mentions.join(known, "entity_id", "left").withColumn("in_kb", F.coalesce("in_kb", F.lit(False)))
    if candidates is not None:
        seen = candidates.select(key, "m_idx", "entity_id").distinct().withColumn("in_cand", F.lit(True))
        out = out.join(seen, [key, "m_idx", "entity_id"], "left").withColumn("in_cand", F.coalesce("in_cand", F.lit(False)))
    return out


def found_and_missing(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct entity ids with whether the dictionary has them."""
    ids = entities.select("entity_id").distinct()
    return ids.join(dictionary.select("entity_id", F.lit(True).alias("_f")).distinct(), "entity_id", "left").select("entity_id", F.coalesce("_f", F.lit(False)).alias("found"))


def split_mentions(mentions: DataFrame, most: int, key: str = "doc_key", seed: str = "3") -> DataFrame:
    """Mentions dealt, in a seeded order, into parts of at most ``most`` a document: adds part."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"), F.col("m_idx").cast("string"))), "m_idx")) - 1
    return mentions.withColumn("part", F.floor(place / most).cast("int"))


def pooled(vectors: DataFrame, key: list[str], vector: str, how: str = "logsumexp") -> DataFrame:
    """One vector per key, element by element: sum, mean, max or logsumexp."""
    at = vectors.select(*key, F.posexplode(vector).alias("_pos", "_x"))
    top = F.max("_x")
    value = {"sum": F.sum("_x"), "mean": F.avg("_x"), "max": top}.get(how)
    if how == "logsumexp":
        peak = at.groupBy(*key, "_pos").agg(F.max("_x").alias("_m"))
        at = at.join(peak, [*key, "_pos"])
        value = F.first("_m") + F.ln(F.sum(F.exp(F.col("_x") - F.col("_m"))))
    each = at.groupBy(*key, "_pos").agg(value.alias("_v"))
    return each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda x: x["_v"]).alias(vector))
