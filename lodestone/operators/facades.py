"""Tasks behind which models are exchanged, and the flow that joins them up.

A task names the columns it needs and gives; its methods are functions on
DataFrames, looked up by name, so a caller changes the model without touching
the flow. Methods that need no model are here; recognizers, encoders, rerankers
and generators are added with ``using``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import extraction, multi_search
from lodestone.plans.staging import stage

Method = Callable[..., DataFrame]


@dataclass(frozen=True)
class Task:
    """A step with exchangeable methods: ``task(df, "method", **settings)``."""

    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    methods: Mapping[str, Method] = field(default_factory=dict)

    def using(self, **methods: Method) -> Task:
        """The task with further methods."""
        return Task(self.name, self.needs, self.gives, {**self.methods, **methods})

    def __call__(self, df: DataFrame, method: str, **settings) -> DataFrame:
        if method not in self.methods:
            raise KeyError(f"{self.name} has no method {method}; it has {', '.join(sorted(self.methods)) or 'none'}")
        self._check(df, self.needs, "needs")
        out = self.methods[method](df, **settings)
        self._check(out, self.gives, f"by {method} must give")
        return out

    def _check(self, df: DataFrame, columns: tuple[str, ...], what: str) -> None:
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"{self.name} {what} {', '.join(missing)}")


def dictionary_mentions(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions of dictionary names (name, entity_type) of any number of words, in text order from 0; the leftmost and longest of names that overlap.

    A name of several types gives a mention for each.
    """
    found = multi_search.numbered_names(documents, dictionary.select("name", F.col("entity_type").alias("kind")))
    return found.select("doc_key", F.col("nth").alias("m_idx"), "start", "end", "name", F.col("kind").alias("entity_type"))


def named_candidates(mentions: DataFrame, dictionary: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` entities whose name equals the mention's, by entity id, all with score 1, and the mention's type where it has one."""
    # The rank is the name's, whoever mentions it.
    rank = F.row_number().over(Window.partitionBy("name").orderBy("entity_id"))
    first = dictionary.select("name", "entity_id").where("name IS NOT NULL").distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    kept = [c for c in ("doc_key", "m_idx", "entity_type") if c in mentions.columns]
    return mentions.select(*kept, "name").join(first, "name").select(*kept, "entity_id", F.lit(1.0).alias("score"), "rank")


def unchanged(candidates: DataFrame) -> DataFrame:
    """The identity reranker: the retriever's order stands."""
    return candidates


def by_score(candidates: DataFrame, score: Column) -> DataFrame:
    """Candidates ranked anew by a score, ties by entity id."""
    scored = candidates.withColumn("score", score.cast("double"))
    order = Window.partitionBy("doc_key", "m_idx").orderBy(F.desc("score"), "entity_id")
    return scored.withColumn("rank", F.row_number().over(order))


def first_candidates(candidates: DataFrame) -> DataFrame:
    """Each mention's entity: its candidate of rank 1."""
    return candidates.where("rank = 1").select("doc_key", "m_idx", "entity_id")


def known_relations(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """The known facts (head, relation, tail) between two entities of a document.

    An entity that has fewer facts than the document has entities meets its
    facts, which are held against the document's entities; others are paired
    with these entities first, so that a hub's facts are not brought to every
    document that names it.
    """
    facts = stage(facts.select("head", "relation", "tail").where("head <> tail").distinct(), "facts")
    ends = facts.select(F.inline(F.array(F.struct(F.col("head").alias("entity"), F.lit(1).alias("n"), F.lit(0).alias("t")), F.struct(F.col("tail").alias("entity"), F.lit(0).alias("n"), F.lit(1).alias("t")))))
    known = ends.groupBy("entity").agg(F.sum("n").alias("_facts"), (F.max("t") == 1).alias("_tail"))
    inside = stage(documents.select("doc_key", F.explode("entities.entity_id").alias("entity")).distinct().join(known, "entity"), "inside")
    tails = inside.where("_tail").select("doc_key", F.col("entity").alias("tail"))
    heads = inside.where("_facts > 0").select("doc_key", F.col("entity").alias("head"), "_facts").join(tails.groupBy("doc_key").agg(F.count(F.lit(1)).alias("_tails")), "doc_key")
    heads = stage(heads, "heads")
    by_fact = heads.where("_facts < _tails").select("doc_key", "head").join(facts, "head").where("head <> tail")
    by_fact = by_fact.join(tails, ["doc_key", "tail"], "left_semi").select("doc_key", "head", "relation", "tail")
    by_pair = heads.where("_facts >= _tails").select("doc_key", "head").join(tails, "doc_key").where("head <> tail")
    by_pair = by_pair.join(facts, ["head", "tail"]).select("doc_key", "head", "relation", "tail")
    return by_fact.unionByName(by_pair)


#: Mention recognition, candidate search, reranking, relation extraction and question answering.
ner = Task("mention recognition", ("doc_key", "text"), ("doc_key", "m_idx", "name", "entity_type"), {"dictionary": dictionary_mentions})
entity_search = Task("entity search", ("doc_key", "m_idx", "name"), ("doc_key", "m_idx", "entity_id", "score", "rank"), {"names": named_candidates})
reranking = Task("entity reranking", ("doc_key", "m_idx", "entity_id", "score", "rank"), ("doc_key", "m_idx", "entity_id", "score", "rank"), {"identity": unchanged, "score": by_score})
relations = Task("relation extraction", ("doc_key", "text", "entities"), ("doc_key", "head", "relation", "tail"), {"known": known_relations})


def extract_triples(
    documents: DataFrame,
    recognize: Callable[[DataFrame], DataFrame],
    search: Callable[[DataFrame], DataFrame],
    rerank: Callable[[DataFrame], DataFrame],
    relate: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Documents (doc_key, text) to triples: mentions, candidates, the best candidate of each mention, relations between a document's entities.

    ``relate`` gets a row a document: doc_key, text and entities (a sorted list
    of entity_id, entity_type and the numbers of its mentions); documents
    without linked mentions have an empty list. Candidates that carry the
    mentions' entity_type need not be joined to the mentions again.
    """
    mentions = recognize(documents)
    linked = rerank(search(mentions)).where("rank = 1")
    if "entity_type" not in linked.columns:
        mentions = stage(mentions, "mentions")  # read twice
        linked = mentions.join(first_candidates(rerank(search(mentions))), ["doc_key", "m_idx"])
    # Dealt by document, which serves both groupings and the join.
    linked = linked.select("doc_key", "entity_id", "entity_type", "m_idx").repartition("doc_key")
    entities = linked.groupBy("doc_key", "entity_id").agg(F.min("entity_type").alias("entity_type"), F.array_sort(F.collect_list("m_idx")).alias("mentions"))
    lists = entities.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("entity_id", "entity_type", "mentions"))).alias("entities"))
    held = documents.select("doc_key", "text").join(lists, "doc_key", "left")
    kind = lists.schema["entities"].dataType
    return relate(held.withColumn("entities", F.coalesce("entities", F.array().cast(kind))))


def answers(
    questions: DataFrame,
    template: str,
    generate: Callable[[Column], Column],
    parse: Callable[[Column], Column] = F.trim,
    contexts: DataFrame | None = None,
) -> DataFrame:
    """Questions (question_key, question) with prompt, generated_text and answer.

    The template has places ``{question}`` and ``{contexts}``; contexts
    (question_key, rank, text) fill the latter in rank order, a line each.
    """
    if contexts is not None:
        lines = contexts.groupBy("question_key").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_c"))
        questions = questions.join(lines, "question_key", "left")
        shown = F.array_join(F.transform(F.col("_c"), lambda c: c["text"]), "\n")
    else:
        shown = F.lit("")
    prompt = extraction.assembled(template, question=F.col("question"), contexts=shown)
    out = extraction.generated(questions, prompt, generate)
    return out.withColumn("answer", parse(F.col("generated_text"))).drop("_c")


class Evaluator:
    """Scores predictions against gold rows that are read once and kept, and keeps what was asked and answered.

    ``score``: (predictions, gold) to a DataFrame of scores. Below ``path`` the
    gold rows are a table and each step's prompts and answers are JSON lines,
    so that a later evaluator at the same path goes on with the same gold.
    """

    def __init__(self, gold: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], path: str):
        self.path, self.score = path.rstrip("/"), score
        gold.write.mode("ignore").parquet(f"{self.path}/gold")
        self.gold = gold.sparkSession.read.schema(gold.schema).parquet(f"{self.path}/gold")

    def evaluate(self, predictions: DataFrame, step: str, answers: DataFrame | None = None) -> DataFrame:
        """The scores of a step's predictions. ``answers`` (prompt, generated_text and any key) are written out; a step that is run again replaces its own."""
        if answers is not None:
            answers.write.mode("overwrite").json(f"{self.path}/answers/step={step}")
        return self.score(predictions, self.gold)
