"""Row filters of corpora, triples and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def articles(df: DataFrame, text_col: str = "text", min_words: int = 10) -> DataFrame:
    """Articles proper: not blank, no redirect, more than ``min_words`` spaced words."""
    t = F.col(text_col)
    return df.where((F.trim(t) != "") & ~F.startswith(F.lower(t), F.lit("#redirect")) & (T.spaced_length(t) > min_words))


def language(df: DataFrame, lang_col: str, wanted: list[str]) -> DataFrame:
    return df.where(F.col(lang_col).isin(wanted))


def nonblank(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.trim(c) != "")
    return df


def relations_in(df: DataFrame, relations: list[str], col: str = "relation") -> DataFrame:
    return df.where(F.col(col).isin(relations))


def under_any(tree_numbers: Column, targets: list[str], prefix: bool = False) -> Column:
    """Whether some tree number contains (or, with ``prefix``, starts with) one of the targets."""
    test = F.startswith if prefix else F.contains
    wanted = F.array(*(F.lit(t) for t in targets))
    return F.exists(tree_numbers, lambda t: F.exists(wanted, lambda b: test(t, b)))


def triples_under(triples: DataFrame, trees: DataFrame, targets: list[str]) -> DataFrame:
    """Triples both of whose ends have a tree number at one of the targets. ``trees``: entity_id, tree_numbers."""
    good = trees.where(under_any(F.col("tree_numbers"), targets)).select("entity_id")
    ends = triples.join(good.withColumnRenamed("entity_id", "head"), "head", "left_semi")
    return ends.join(good.withColumnRenamed("entity_id", "tail"), "tail", "left_semi").select(*triples.columns)


def all_contexts_known(questions: DataFrame, contexts: DataFrame, allowed: DataFrame, key: str = "question_key", context: str = "context_id") -> DataFrame:
    """Questions none of whose contexts is missing from ``allowed`` (a column named like ``context``)."""
    missing = contexts.join(allowed.select(context), context, "left_anti").select(key)
    return questions.join(missing, key, "left_anti")


def annotation_kind(score: Column) -> Column:
    """Contexts of score 1000 are gold, others distant."""
    return F.when(score == 1000, F.lit("gold")).otherwise(F.lit("distant"))


def answers_of_type(kind: Column, exact: Column, ideal: Column) -> Column:
    """The answers of a question by its type: yes/no and factoid take the exact answer, list each item, summary the ideal one.

    ``exact``: array of arrays of synonyms; ``ideal``: string. Gives an array
    of struct(answer, answer_type, list_index).
    """
    flat = lambda t: F.flatten(F.transform(exact, lambda names, i: F.transform(names, lambda a: F.struct(a.alias("answer"), F.lit(t).alias("answer_type"), i.alias("list_index")))))
    one = F.array(F.struct(ideal.alias("answer"), F.lit("summary").alias("answer_type"), F.lit(0).alias("list_index")))
    return F.when(kind == "yesno", flat("yesno")).when(kind == "factoid", F.transform(flat("factoid"), lambda x: x.withField("list_index", F.lit(0)))).when(kind == "list", flat("list")).otherwise(one)


def spans_within(spans: DataFrame, sentence_of: DataFrame, max_words: int = 10, key: str = "doc_key") -> DataFrame:
    """Spans whose ends lie in one sentence and at most ``max_words`` apart. ``sentence_of``: key, token, sent_idx."""
    a = sentence_of.select(F.col(key), F.col("token").alias("begin"), F.col("sent_idx").alias("_sb"))
    b = sentence_of.select(F.col(key), F.col("token").alias("end"), F.col("sent_idx").alias("_se"))
    near = spans.where(F.col("end") - F.col("begin") <= max_words)
    return near.join(a, [key, "begin"]).join(b, [key, "end"]).where("_sb = _se").select(*spans.columns)


def within_sentences(spans: Column, sentence_of: Column, max_words: int = 10) -> Column:
    """``spans_within`` for a document's spans (array of struct begin, end) and the sentence of each of its tokens (array), which need no shuffle."""
    there = lambda i: F.get(sentence_of, i.cast("int"))
    return F.filter(spans, lambda s: (s["end"] - s["begin"] <= max_words) & (there(s["begin"]) == there(s["end"])))


def entity_pairs(entities: DataFrame, types: list[tuple[str, str]] | None = None, excluded: DataFrame | None = None, key: str = "doc_key", beside: str | None = None, pieces: int | None = None) -> DataFrame:
    """Ordered pairs of different entities of a document: key, arg1, arg2 and their types.

    ``types`` restricts the pair of types; ``excluded`` (key, arg1, arg2)
    takes out pairs in both directions. With ``beside`` the pairs carry that
    column of both entities (with 1 and 2); they are dealt to ``pieces``.
    """
    more = [beside] if beside else []
    a = entities.select(key, F.col("e_idx").alias("arg1"), F.col("entity_type").alias("type1"), *(F.col(c).alias(f"{c}1") for c in more))
    b = entities.select(key, F.col("e_idx").alias("arg2"), F.col("entity_type").alias("type2"), *(F.col(c).alias(f"{c}2") for c in more))
    pairs = a.join(b, key).where("arg1 <> arg2")
    if types is not None:
        allowed = [F.struct(F.lit(x), F.lit(y)) for x, y in types]
        pairs = pairs.where(F.struct("type1", "type2").isin(allowed)) if allowed else pairs.where(F.lit(False))
    pairs = dealt(pairs, key, pieces)
    if excluded is not None:
        ways = F.array(F.struct("arg1", "arg2"), F.struct(F.col("arg2").alias("arg1"), F.col("arg1").alias("arg2")))
        both = excluded.select(key, F.inline(ways))
        pairs = pairs.join(dealt(both, key, pieces), [key, "arg1", "arg2"], "left_anti")
    return pairs.select(key, "arg1", "arg2", "type1", "type2", *(f"{c}{i}" for c in more for i in (1, 2)))


def dealt(pairs: DataFrame, key: str, pieces: int | None) -> DataFrame:
    """Pairs (key, arg1, arg2, ...) shuffled to so many partitions, where a join or an aggregation by them finds them; as they are without a number."""
    return pairs.repartition(pieces, key, "arg1", "arg2") if pieces else pairs


def drop_unlinked_mentions(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions whose entity is in the dictionary; documents left without any are gone with them."""
    return mentions.join(dictionary.select("entity_id"), "entity_id", "left_semi")


def with_relations(df: DataFrame, col: str = "relations") -> DataFrame:
    return df.where(F.size(col) > 0)


def in_split(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a split given by its list of ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
