"""Inputs and outputs of models as tables: segments, decoded span scores, sampled negatives."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.operators.extraction import select_spans


def pack_segments(lengths: Column, most: int) -> Column:
    """The segment number of each sentence: sentences packed while they fit into ``most`` tokens.

    A sentence longer than ``most`` starts a segment and takes as many as it
    needs. Gives an array of struct(segment, first), one per sentence, where
    first is the sentence's first place in its segment.
    """
    start = F.struct(F.array().cast("array<struct<segment:int,first:int>>").alias("out"), F.lit(0).alias("seg"), F.lit(0).alias("n"))

    def add(a: Column, n: Column) -> Column:
        fits = (a["n"] + n <= most) | (a["n"] == 0)
        seg, first = F.when(fits, a["seg"]).otherwise(a["seg"] + 1), F.when(fits, a["n"]).otherwise(0)
        used = first + n
        more = F.when(used > most, F.floor((used - 1) / most).cast("int")).otherwise(0)
        return F.struct(F.array_append(a["out"], F.struct(seg.alias("segment"), first.alias("first"))).alias("out"), (seg + more).alias("seg"), (used - more * most).alias("n"))

    return F.aggregate(lengths, start, add, lambda a: a["out"])


def token_segments(tokens: DataFrame, most: int, key: str = "doc_key") -> DataFrame:
    """Tokens (key, sent_idx, idx) with their segment and place in it; places restart every ``most`` tokens."""
    sizes = tokens.groupBy(key, "sent_idx").agg(F.count(F.lit(1)).cast("int").alias("n"))
    lists = sizes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "n"))), lambda x: x["n"]).alias("ns"), F.array_sort(F.collect_list("sent_idx")).alias("ss"))
    placed = lists.select(key, F.inline(F.arrays_zip(F.col("ss").alias("sent_idx"), pack_segments(F.col("ns"), most).alias("p"))))
    nth = F.row_number().over(Window.partitionBy(key, "sent_idx").orderBy("idx")) - 1
    at = F.col("p.first") + F.col("_n")
    return tokens.withColumn("_n", nth).join(placed, [key, "sent_idx"]).select(key, "idx", (F.col("p.segment") + F.floor(at / most)).cast("int").alias("segment"), (at % most).cast("int").alias("place"))


def decode_span_scores(scores: DataFrame, types: list[str], max_words: int = 10, nested: bool = False, key: str = "doc_key") -> DataFrame:
    """Mentions (key, begin, end, entity_type) from a score per span and type.

    ``scores``: key, begin, end (words), logits (array; place 0 is no entity),
    valid (whether the span may be one). The best type counts; spans of no
    type, invalid or longer than ``max_words`` go; the rest are chosen
    greedily by score.
    """
    top = F.array_max("logits")
    label = F.array_position("logits", top) - 1
    spans = scores.where("valid").select(key, "begin", "end", label.alias("_l"), top.alias("score")).where((F.col("_l") > 0) & (F.col("end") - F.col("begin") <= max_words))
    named = spans.withColumn("entity_type", F.get(F.lit(types), F.col("_l").cast("int")))
    return named.groupBy(key).agg(F.collect_list(F.struct("begin", "end", "entity_type", "score")).alias("s")).select(key, F.inline(select_spans(F.col("s"), nested)))


def balanced(questions: DataFrame, per_positive: int, *keys: str, seed: str = "11") -> DataFrame:
    """All questions answered Yes, and for each of them ``per_positive`` of those answered No, in a seeded order; all for 0 or less."""
    if per_positive <= 0:
        return questions
    n = questions.where("answer = 'Yes'").count() * per_positive
    order = F.md5(F.concat_ws("|", F.lit(seed), *keys))
    return questions.where("answer = 'Yes'").union(questions.where("answer = 'No'").orderBy(order, *keys).limit(n))


def templates_by_kind(templates: DataFrame) -> DataFrame:
    """question type to a map of relation to template."""
    return templates.groupBy("question_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "template")))).alias("templates"))


@F.pandas_udf(StringType())
def composed_lower(s: pd.Series) -> pd.Series:
    """Unicode canonical composition, then lower case (for text beyond ASCII; ``lower`` does within)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).lower())


def document_statistics(mentions: DataFrame, relations: DataFrame, key: str = "doc_key") -> DataFrame:
    """Total, mean, greatest and least number of mentions, entities and relations a document: kind, total, mean, most, least."""
    per = mentions.groupBy(key).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("entity_id").alias("entities"))
    rel = relations.groupBy(key).agg(F.count(F.lit(1)).alias("relations"))
    full = per.join(rel, key, "full").select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("mentions", "entities", "relations")))
    each = full.select(F.inline(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in ("mentions", "entities", "relations")))))
    return each.groupBy("kind").agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"))


def entities_per_split(mentions: DataFrame, split: Column, about: float | None = None) -> DataFrame:
    """(split, entities, mentions): distinct entities and mentions of each split of a corpus; with ``about`` the entities within that relative error."""
    entities = F.approx_count_distinct("entity_id", about) if about else F.countDistinct("entity_id")
    return mentions.groupBy(split.alias("split")).agg(entities.alias("entities"), F.count(F.lit(1)).alias("mentions"))
