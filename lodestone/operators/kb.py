"""Knowledge-base tables: dictionaries, relation mapping, question sets, corpora to passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concept_dictionary(names: DataFrame) -> DataFrame:
    """entity_id, canonical_name, synonyms (sorted, without it) from concept names.

    ``names``: CUI, STR, TS, ISPREF, STT. The preferred name has TS = P,
    ISPREF = Y, STT = PF; of several the first by text counts. Concepts
    without one are left out.
    """
    preferred = (F.col("TS") == "P") & (F.col("ISPREF") == "Y") & (F.col("STT") == "PF")
    grouped = names.groupBy(F.col("CUI").alias("entity_id")).agg(F.min(F.when(preferred, F.col("STR"))).alias("canonical_name"), F.collect_set("STR").alias("_all"))
    return grouped.where("canonical_name IS NOT NULL").select("entity_id", "canonical_name", F.array_sort(F.array_except("_all", F.array("canonical_name"))).alias("synonyms"))


def with_types(dictionary: DataFrame, types: DataFrame) -> DataFrame:
    """Adds entity_types, entity_type_names and sorted tree_numbers. ``types``: CUI, TUI, STY, STN; types of unknown concepts are ignored."""
    t = types.groupBy(F.col("CUI").alias("entity_id")).agg(F.array_sort(F.collect_set(F.struct("TUI", "STY"))).alias("_t"), F.array_sort(F.collect_set("STN")).alias("tree_numbers"))
    t = t.select("entity_id", F.transform("_t", lambda x: x["TUI"]).alias("entity_types"), F.transform("_t", lambda x: x["STY"]).alias("entity_type_names"), "tree_numbers")
    return dictionary.join(t, "entity_id", "left")


def with_definitions(dictionary: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds the description: a concept's definitions (CUI, pos, DEF) in file order, joined by `` | ``; empty without any."""
    d = definitions.groupBy(F.col("CUI").alias("entity_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "DEF"))), lambda x: x["DEF"]), " | ").alias("description"))
    return dictionary.join(d, "entity_id", "left").withColumn("description", F.coalesce("description", F.lit("")))


def relation_triples(relations: DataFrame) -> DataFrame:
    """Triples of a relation table (CUI1, RELA, CUI2, RL, SAB): the second concept is the head; rows without a label go."""
    kept = relations.where("RELA IS NOT NULL AND RELA <> ''")
    return kept.select(F.col("CUI2").alias("head"), F.col("RELA").alias("relation"), F.col("CUI1").alias("tail"), *(F.col(c).alias(a) for c, a in (("REL", "relation_class"), ("SAB", "source")) if c in relations.columns))


def relation_signatures(names: DataFrame, structure: DataFrame) -> DataFrame:
    """Each semantic relation with its sorted distinct pairs of types. ``structure``: arg1, relation, arg2; only capitalised type names."""
    capital = lambda c: F.regexp_like(c, F.lit("^[A-Z]"))
    pairs = structure.where(capital(F.col("arg1")) & capital(F.col("arg2"))).groupBy("relation").agg(F.array_sort(F.collect_set(F.struct("arg1", "arg2"))).alias("pairs"))
    return names.join(pairs, "relation", "left")


def relations_of_pairs(triples: DataFrame) -> DataFrame:
    """(head, tail, relations): each ordered pair with its sorted distinct relations."""
    return triples.groupBy("head", "tail").agg(F.array_sort(F.collect_set("relation")).alias("relations"))


def identifier_map(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """source id, sorted distinct target ids."""
    return pairs.groupBy(source).agg(F.array_sort(F.collect_set(target)).alias(target + "s"))


def mapped_relations(triples: DataFrame, mapping: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Triples with coarse labels, distinct. ``mapping``: relation, label.

    A label with ``#inverse`` swaps head and tail, one with ``#negative``
    drops the triple, as do ``ignored`` relations and empty labels. A relation
    that the mapping lacks is an error.
    """
    rows = triples.where(~F.col("relation").isin(*ignored)) if ignored else triples
    j = rows.join(mapping.withColumnRenamed("label", "_l"), "relation", "left")
    label = F.coalesce("_l", F.raise_error(F.concat(F.lit("no mapping for relation "), F.col("relation"))).cast("string"))
    j = j.withColumn("_l", label).where((F.col("_l") != "") & ~F.contains("_l", F.lit("#negative")))
    swap = F.contains("_l", F.lit("#inverse"))
    return j.select(
        F.when(swap, F.col("tail")).otherwise(F.col("head")).alias("head"), F.replace("_l", F.lit("#inverse"), F.lit("")).alias("relation"), F.when(swap, F.col("head")).otherwise(F.col("tail")).alias("tail")
    ).dropDuplicates()


#: First letters of tree numbers and the types they stand for (fixed values, spelled as in published dictionaries).
TREE_CATEGORIES = {
    "A": "Anatomy",
    "B": "Organism",
    "C": "Disease",
    "D": "Chemical",
    "E": "TechniqueAndEquipment",
    "F": "PhychiatryAndPsychology",
    "G": "PhenomemonAndProcess",
    "H": "Discripline",
    "I": "Social",
    "J": "Industry",
    "K": "Humanity",
    "L": "InformationScience",
    "M": "NamedGroup",
    "N": "HealthCare",
    "V": "Publication",
    "Z": "Geographical",
}


def tree_category(tree_numbers: Column) -> Column:
    """The category of the first tree number; null without one."""
    known = F.create_map(*(F.lit(x) for kv in TREE_CATEGORIES.items() for x in kv))
    return F.try_element_at(known, F.substring(F.try_element_at(tree_numbers, F.lit(1)), 1, 1))


def described(*parts: Column) -> Column:
    """Present parts of a description joined by spaces."""
    return F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def article_dictionary(articles: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Articles as entity pages, the title with underscores as id. Use ``duplicates`` to find ids that occur twice."""
    return articles.select(F.translate(F.col(title), " ", "_").alias("entity_id"), F.col(title).alias("canonical_name"), F.array().cast("array<string>").alias("synonyms"), F.col(text).alias("description"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def passages_of_documents(documents: DataFrame) -> DataFrame:
    """The first sentence as title, the rest as text. ``documents``: doc_key, sentences."""
    return documents.select("doc_key", F.try_element_at("sentences", F.lit(1)).alias("title"), F.array_join(F.slice("sentences", 2, F.greatest(F.size("sentences") - 1, F.lit(0))), " ").alias("text"))


def unique_passages(contexts: DataFrame, cols: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """Distinct passages over all questions. ``contexts``: an array of structs in ``contexts``."""
    one = contexts.select(F.explode("contexts").alias("c"))
    return one.select(*(F.col(f"c.{c}").alias(c) for c in cols)).dropDuplicates()


def documents_of_triples(triples: DataFrame, key: str = "doc_key") -> DataFrame:
    """Documents made from triples alone: key, entity_ids (sorted, distinct), relations (sorted, distinct, by position)."""
    ids = triples.select(key, F.explode(F.array("head", "tail")).alias("e")).groupBy(key).agg(F.array_sort(F.collect_set("e")).alias("entity_ids"))
    rel = triples.groupBy(key).agg(F.collect_set(F.struct("head", "relation", "tail")).alias("_r"))
    at = lambda x: (F.array_position("entity_ids", x) - 1).cast("int")
    rows = F.array_sort(F.transform("_r", lambda r: F.struct(at(r["head"]).alias("arg1"), r["relation"].alias("relation"), at(r["tail"]).alias("arg2"))))
    return ids.join(rel, key).select(key, "entity_ids", rows.alias("relations"))


def python_list(text: Column) -> Column:
    """The strings of a list literal with single or double quotes."""
    found = F.regexp_extract_all(text, F.lit(r"'([^'\\]*(?:\\.[^'\\]*)*)'|\"([^\"\\]*(?:\\.[^\"\\]*)*)\""), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
