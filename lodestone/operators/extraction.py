"""Extraction from documents: prompts, parsed answers of a generator, spans, relations, scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import parsing, text as T
from lodestone.operators.filters import dealt, entity_pairs
from lodestone.plans.staging import stage


class Scorer(Protocol):
    """A model behind an operator: batches of rows in, the same rows with its outputs out."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def scored(df: DataFrame, scorer: Scorer, schema: str) -> DataFrame:
    """Run a scorer over all rows, partition by partition."""
    return df.mapInPandas(scorer, schema)


def generated(df: DataFrame, prompt: Column, generate: Callable[[Column], Column], out: str = "generated_text") -> DataFrame:
    """Adds the prompt and the text that ``generate`` (a Column function, plain or a pandas UDF) makes of it."""
    return df.withColumn("prompt", prompt).withColumn(out, generate(F.col("prompt")))


# Prompts


def bulleted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def type_list(types: list[tuple[str, str]]) -> str:
    """Names with definitions, a line each."""
    return "\n".join(f"- {name}: {definition}" for name, definition in types)


def demonstration(text: Column, lines: Column) -> Column:
    return F.concat(F.lit("Text: "), text, F.lit("\nAnswer:\n"), lines)


def assembled(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` places filled by Columns."""
    out: Column = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def mention_prompt(sentences: Column, types: list[tuple[str, str]], demonstrations: Column | None = None, contexts: Column | None = None) -> Column:
    """A prompt that asks for mentions: types, demonstrations, contexts, then the text."""
    parts = [F.lit("Entity Types:\n" + type_list(types))]
    if demonstrations is not None:
        parts.append(F.array_join(demonstrations, "\n\n"))
    if contexts is not None:
        parts.append(T.numbered(contexts))
    parts.append(F.concat(F.lit("Text: "), F.array_join(sentences, " "), F.lit("\nAnswer:")))
    return F.concat_ws("\n\n", *parts)


def entity_listing(entities: Column, how: str = "all") -> Column:
    """``- EntityN: names``: all distinct mention names, the first one, or the canonical name."""
    names = {"all": lambda e: F.array_join(F.array_distinct(e["mention_names"]), ", "), "first": lambda e: F.get(e["mention_names"], F.lit(0)), "canonical": lambda e: e["canonical_name"]}[how]
    return F.array_join(F.transform(entities, lambda e, i: F.concat(F.lit("- Entity"), i.cast("string"), F.lit(": "), names(e))), "\n")


def question_prompt(question: Column, contexts: Column | None = None, n_contexts: int = -1, options: Column | None = None) -> Column:
    """Contexts (the first ``n_contexts``, -1 for all), the question, and options where there are any."""
    asked = F.concat(F.lit("Question: "), question)
    if options is not None:
        asked = F.when(F.size(options) > 0, F.concat(asked, F.lit("\nOptions:\n"), bulleted(options))).otherwise(asked)
    if contexts is None:
        return asked
    used = contexts if n_contexts < 0 else F.slice(contexts, 1, n_contexts) if n_contexts else F.array().cast("array<string>")
    block = T.numbered(used)
    return F.when(block == "", asked).otherwise(F.concat(block, F.lit("\n\n"), asked))


def linking_lines(mentions: Column, most: int = 3) -> Column:
    """``- name`` with up to ``most`` candidates below it. ``mentions``: array of struct(name, candidates)."""
    one = lambda m: F.concat(F.lit("- "), m["name"], F.array_join(F.transform(F.slice(m["candidates"], 1, most), lambda c: F.concat(F.lit("\n  * "), c["entity_id"], F.lit(" | "), c["canonical_name"])), ""))
    return F.array_join(F.transform(mentions, one), "\n")


def batches_of(place: Column, size: int) -> Column:
    """The number of the fixed-size batch that a place falls in."""
    return F.floor(place / size).cast("int")


# Parsed answers


def canonical(value: Column, names: dict[str, str]) -> Column:
    """A pretty name (any case) as its canonical label; unknown ones stay as they are."""
    if not names:
        return value
    known = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k.lower(), v)))
    return F.coalesce(F.try_element_at(known, F.lower(value)), value)


def mentions_from_answers(documents: DataFrame, type_names: dict[str, str] | None = None, max_words: int = 10, key: str = "doc_key") -> DataFrame:
    """Mentions that a generator named: key, begin, end, name, entity_type; one row per span and type.

    ``documents``: key, sentences (array), generated_text with lines ``bullet
    name | type``. A name is found where the words of the text, white space
    aside, read as it does (any case); spans stay within a sentence and at
    most ``max_words`` beyond their first word. The name is taken from the text.
    """
    lower = lambda x: F.lower(x)
    docs = documents.select(
        key,
        F.flatten(F.transform("sentences", lambda s, i: F.transform(T.words(s), lambda w: F.struct(w.alias("w"), lower(w).alias("l"), i.alias("s"))))).alias("ws"),
        F.transform(F.filter(F.transform(parsing.lines(F.col("generated_text")), parsing.two_fields), lambda p: p.isNotNull()), lambda p: F.struct(F.regexp_replace(lower(p["name"]), r"\s+", "").alias("n"), p["value"].alias("t"))).alias("asked"),
    )
    asked = docs.select(key, "ws", F.explode(F.array_distinct("asked")).alias("a"))
    starts = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.startswith(F.col("a.n"), F.get("ws", i)["l"]))
    begun = asked.where("size(ws) > 0 AND a.n <> ''").select(key, "ws", "a", F.explode(starts).alias("begin"))
    begun = begun.select(key, "a", "begin", F.slice("ws", F.col("begin") + 1, F.lit(max_words + 1)).alias("run"))

    # The run grows word by word within its sentence until it reads as the name, which it can at one place only.
    def grow(a: Column, x: Column) -> Column:
        done = a["hit"] | (x["s"] != F.get("run", F.lit(0))["s"])
        text = F.concat(a["text"], x["l"])
        return F.when(done, a).otherwise(F.struct(text.alias("text"), (a["n"] + 1).alias("n"), (text == F.col("a.n")).alias("hit")))

    got = F.aggregate("run", F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("hit")), grow)
    found = begun.withColumn("_g", got).where("_g.hit")
    name = F.array_join(F.transform(F.slice("run", F.lit(1), F.col("_g.n")), lambda x: x["w"]), " ")
    kind = canonical(F.col("a.t"), type_names or {})
    return found.select(key, "begin", (F.col("begin") + F.col("_g.n") - 1).alias("end"), name.alias("name"), kind.alias("entity_type")).distinct()


def relations_from_answers(documents: DataFrame, relation_names: dict[str, str] | None = None, key: str = "doc_key") -> DataFrame:
    """Triples that a generator named: key, arg1, relation, arg2. Lines: ``bullet EntityI | relation | EntityJ``.

    ``documents``: key, n_entities, generated_text. Both ends must exist and
    differ; with fewer than two entities there is nothing to relate.
    """
    lines = documents.where("n_entities > 1").select(key, "n_entities", F.explode(F.transform(parsing.lines(F.col("generated_text")), parsing.three_fields)).alias("p")).where("p IS NOT NULL")
    index = lambda c: F.regexp_extract(c, r"^Entity(0|[1-9]\d*)$", 1).try_cast("int")
    out = lines.select(key, "n_entities", index(F.col("p.head")).alias("arg1"), canonical(F.col("p.relation"), relation_names or {}).alias("relation"), index(F.col("p.tail")).alias("arg2"))
    return out.where("arg1 < n_entities AND arg2 < n_entities AND arg1 <> arg2").select(key, "arg1", "relation", "arg2").distinct()


def links_from_answers(groups: DataFrame, key: str = "doc_key") -> DataFrame:
    """Linked mentions of each group: key, m_idx, entity_id (``NO-PRED`` where nothing valid was said).

    ``groups``: key, mentions (array of struct(m_idx, name)), candidate_ids
    (array: all candidates of the document), generated_text with lines
    ``bullet name | id``. With as many lines as mentions they are aligned by
    place; otherwise by name, white space aside, the last line counting.
    """
    said = F.filter(F.transform(parsing.lines(F.col("generated_text")), parsing.two_fields), lambda p: p.isNotNull())
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    g = groups.withColumn("said", said)
    valid = lambda p: F.array_contains("candidate_ids", p["value"])
    by_place = lambda m, i: F.when(valid(F.get("said", i)), F.get("said", i)["value"])
    by_name = lambda m: F.try_element_at(F.filter("said", lambda p: (plain(p["name"]) == plain(m["name"])) & valid(p)), F.lit(-1))["value"]
    one = lambda m, i: F.struct(m["m_idx"].alias("m_idx"), F.coalesce(F.when(F.size("said") == F.size("mentions"), by_place(m, i)).otherwise(by_name(m)), F.lit("NO-PRED")).alias("entity_id"))
    return g.select(key, F.inline(F.transform("mentions", one)))


# Decoders


def bio_spans(tokens: DataFrame, key: str = "doc_key") -> DataFrame:
    """Spans (key, begin, end, entity_type) of BIO tags (either scheme). ``tokens``: key, idx, tag."""
    w = Window.partitionBy(key).orderBy("idx")
    head, kind = F.substring("tag", 1, 1), F.substring("tag", 3, 100)
    t = tokens.select(key, "idx", head.alias("_h"), kind.alias("_k"))
    before_h, before_k = F.lag("_h").over(w), F.lag("_k").over(w)
    start = (F.col("_h") == "B") | ((F.col("_h") == "I") & (before_h.isNull() | (before_h == "O") | (before_k != F.col("_k"))))
    t = t.withColumn("_s", F.when(start, 1).otherwise(0)).withColumn("_g", F.sum("_s").over(w)).where("_h <> 'O'")
    return t.groupBy(key, "_g").agg(F.min("idx").alias("begin"), F.max("idx").alias("end"), F.first("_k").alias("entity_type")).drop("_g")


def select_spans(spans: Column, nested: bool = False) -> Column:
    """Spans chosen greedily by score, sorted by place. ``spans``: array of struct(begin, end, entity_type, score).

    Flat: no overlap with a chosen span; nested: none that crosses one. Equal
    scores: the earlier span first.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct((-s["score"]).alias("neg"), s["begin"].alias("begin"), s["end"].alias("end"), s["entity_type"].alias("entity_type"))))

    def clash(a: Column, s: Column) -> Column:
        if nested:
            return ((s["begin"] < a["begin"]) & (a["begin"] <= s["end"]) & (s["end"] < a["end"])) | ((a["begin"] < s["begin"]) & (s["begin"] <= a["end"]) & (a["end"] < s["end"]))
        return (a["begin"] <= s["end"]) & (s["begin"] <= a["end"])

    empty = F.filter(order, lambda s: F.lit(False))
    chosen = F.aggregate(order, empty, lambda out, s: F.when(F.exists(out, lambda a: clash(a, s)), out).otherwise(F.array_append(out, s)))
    return F.array_sort(F.transform(chosen, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["entity_type"].alias("entity_type"))))


def adaptive_labels(logits: Column, top_k: int = -1) -> Column:
    """0/1 labels: those above the threshold logit (the first), among the ``top_k`` largest if given; the first alone if none."""
    floor_ = F.get(F.sort_array(logits, asc=False), F.lit(top_k - 1)) if top_k > 0 else None
    over = lambda x: (x > F.get(logits, F.lit(0))) & (x >= floor_ if floor_ is not None else F.lit(True))
    none = ~F.exists(logits, over)
    return F.transform(logits, lambda x, i: F.when(i == 0, none.cast("int")).otherwise(over(x).cast("int")))


# Relations by rule

#: Entities whose pairs one task takes, about (fixed value): what a task holds does not grow with the input.
ENTITIES_A_TASK = 100_000


def pair_questions(entities: DataFrame, templates: DataFrame, gold: DataFrame | None = None, types=None, excluded: DataFrame | None = None, key: str = "doc_key") -> DataFrame:
    """A yes/no question for every ordered pair of entities and every relation with a template.

    ``entities``: key, e_idx, name, entity_type; ``templates``: relation,
    template with ``@@@HEAD###`` and ``@@@TAIL###``. With ``gold`` (key, arg1,
    relation, arg2) an answer Yes or No is added.
    """
    entities = stage(entities, "entities")
    pieces = 1 + entities.count() // ENTITIES_A_TASK
    out = entity_pairs(entities, types, excluded, key, "name", pieces)
    if gold is not None:
        known = dealt(gold.select(key, "arg1", "relation", "arg2"), key, pieces).groupBy(key, "arg1", "arg2").agg(F.collect_set("relation").alias("_known"))
        out = out.join(known, [key, "arg1", "arg2"], "left")
    out = out.crossJoin(F.broadcast(templates.select("relation", "template")))  # one row per relation of the schema
    text = F.replace(F.replace(F.col("template"), F.lit("@@@HEAD###"), F.col("name1")), F.lit("@@@TAIL###"), F.col("name2"))
    said = [F.when(F.array_contains("_known", F.col("relation")), "Yes").otherwise("No").alias("answer")] if gold is not None else []
    return out.select(key, "arg1", "relation", "arg2", text.alias("question"), *said)


def triples_from_answers(questions: DataFrame, answer: str = "answer", key: str = "doc_key") -> DataFrame:
    """(key, arg1, relation, arg2) of the pair questions whose answer says yes: its first word, whatever the case and the marks around it."""
    first = F.regexp_extract(F.col(answer), r"^[^A-Za-z]*([A-Za-z]+)", 1)
    return questions.where(F.lower(first) == "yes").select(key, "arg1", "relation", "arg2").distinct()


def linking_demonstrations(candidates: DataFrame, gold: DataFrame, distractors: int = 2, key: str = "doc_key") -> DataFrame:
    """(key, m_idx, options, answer): for each gold mention (key, m_idx, entity_id) its first candidates that are wrong, and the right one last.

    ``candidates``: key, m_idx, entity_id, rank. A right entity that is not
    among the candidates is not shown, and the answer is ``NA``.
    """
    right = gold.select(key, "m_idx", F.col("entity_id").alias("_gold"))
    met = right.join(candidates.select(key, "m_idx", "entity_id", "rank"), [key, "m_idx"], "left")
    is_gold = F.col("entity_id").eqNullSafe(F.col("_gold"))
    wrong = F.when(~is_gold & F.col("entity_id").isNotNull(), F.struct("rank", "entity_id"))
    lists = met.groupBy(key, "m_idx", "_gold").agg(F.array_sort(F.collect_list(wrong)).alias("_w"), F.coalesce(F.max(is_gold & F.col("entity_id").isNotNull()), F.lit(False)).alias("_found"))
    shown = F.transform(F.slice("_w", 1, distractors), lambda x: x["entity_id"])
    own = F.when(F.col("_found"), F.array("_gold")).otherwise(F.array().cast("array<string>"))
    return lists.select(key, "m_idx", F.concat(shown, own).alias("options"), F.when(F.col("_found"), F.col("_gold")).otherwise("NA").alias("answer"))


def distant_triples(occurrences: DataFrame, facts: DataFrame, key: str = "doc_key") -> DataFrame:
    """Every known relation of two entities that share a sentence. ``occurrences``: key, entity, sent_idx; ``facts``: head, relation, tail."""
    o = occurrences.select(key, "entity", "sent_idx").distinct()
    a, b = o.withColumnRenamed("entity", "head"), o.withColumnRenamed("entity", "tail")
    # Pairs first: a sentence holds few entities, an entity may have many facts and sentences.
    pairs = a.join(b, [key, "sent_idx"]).where("head <> tail").select(key, "head", "tail").distinct()
    return pairs.join(facts.distinct(), ["head", "tail"]).select(key, "head", "relation", "tail").distinct()


def first_triples(triples: DataFrame, pos: str, key: str = "doc_key") -> DataFrame:
    """The first of equal (key, arg1, relation, arg2) in the order of ``pos``."""
    w = Window.partitionBy(key, "arg1", "relation", "arg2").orderBy(pos)
    return triples.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def demonstrations(pool: DataFrame, size: Column, k: int, method: str = "count", seed: str = "5", key: str = "doc_key") -> DataFrame:
    """``k`` documents of the pool as demonstrations: rank, demo_key, score. first, random (seeded) or by most annotations (``count``)."""
    order = {"first": [F.col("pos")], "random": [F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))], "count": [F.desc("score"), F.col("pos")]}[method]
    top = pool.select(F.col(key), F.col("pos"), size.cast("double").alias("score")).orderBy(*order).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col(key).alias("demo_key"), F.when(F.lit(method == "count"), F.col("score")).otherwise(F.lit(1.0)).alias("score"))  # k rows


def pipeline(documents: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Recognition, candidate search, linking and relation extraction one after another."""
    for step in steps:
        documents = documents.transform(step)
    return documents
