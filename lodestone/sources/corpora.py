"""Readers of annotated corpora, each record parsed within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.kb import tree_category
from lodestone.operators.linking import aggregate_mentions
from lodestone.sources.parts import in_file_order


def read_pubtator(spark: SparkSession, path: str, type_names: dict[str, str] | None = None) -> DataFrame:
    """doc_key, title, text, mentions of records parted by blank lines: ``id|t|``, ``id|a|``, then six tab-separated fields.

    Spans are characters of title + space + text with inclusive end; the
    prefix ``UMLS:`` is cut from ids. A mention that the text does not read
    is an error.
    """
    rec = spark.read.option("lineSep", "\n\n").text(path).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("ls")).where(F.size("ls") > 0)
    line = lambda kind: F.try_element_at(F.filter("ls", lambda x: F.get(F.split(x, r"\|"), F.lit(1)) == kind), F.lit(1))
    rest = lambda c: F.array_join(F.slice(F.split(c, r"\|"), 3, 1_000_000), " ")
    rec = rec.select(F.get(F.split(line("t"), r"\|"), F.lit(0)).alias("doc_key"), rest(line("t")).alias("title"), rest(line("a")).alias("text"), F.filter(F.transform("ls", lambda x: F.split(x, "\t")), lambda p: F.size(p) == 6).alias("ms"))
    whole = F.concat_ws(" ", "title", "text")
    known = F.create_map(*(F.lit(x) for kv in type_names.items() for x in kv)) if type_names else None

    def mention(p: Column) -> Column:
        b, e = p[1].cast("int"), p[2].cast("int")
        wrong = F.raise_error(F.concat(F.lit("no such mention: "), p[3])).cast("string")
        name = F.when(F.substring(whole, b + 1, e - b) == p[3], p[3]).otherwise(wrong)
        kind = F.coalesce(F.try_element_at(known, p[4]), p[4]) if known is not None else p[4]
        return F.struct(F.array(b, e - 1).alias("span"), name.alias("name"), kind.alias("entity_type"), F.regexp_replace(p[5], "^UMLS:", "").alias("entity_id"))

    return rec.select("doc_key", "title", "text", F.transform("ms", mention).alias("mentions"))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, sent_idx, idx, token, tag) of a corpus with ``-DOCSTART-`` lines, blank lines between sentences and four fields a token.

    idx counts the document's tokens; keys are ``ID0`` on, in file order.
    """
    text = spark.read.option("lineSep", "-DOCSTART-").text(path)
    # The first line break ends the mark's own line.
    sents = F.filter(F.split(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\n[ \t\r]*\n"), lambda s: F.trim(F.translate(s, "\n\r\t", "   ")) != "")
    docs = in_file_order(text, F.size(sents) > 0)
    rows = docs.select(F.concat(F.lit("ID"), "n").alias("doc_key"), F.posexplode(sents).alias("sent_idx", "s"))
    rows = rows.select("doc_key", "sent_idx", F.posexplode(F.filter(F.split("s", r"\r?\n"), lambda x: F.trim(x) != "")).alias("i", "l"))
    part = lambda n: F.get(F.split(F.trim("l"), " "), F.lit(n))
    at = F.row_number().over(Window.partitionBy("doc_key").orderBy("sent_idx", "i")) - 1
    return rows.select("doc_key", "sent_idx", at.alias("idx"), part(0).alias("token"), part(3).alias("tag"))


#: Width of one pair's group of fields, and the fields by place (fixed values).
PAIR_FIELDS = 17


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, text, pos, relation, direction, cross, arg1_*, arg2_*): rows of two fixed columns and repeated groups of 17.

    Mention lists are parted by ``|``, places by ``:``; a relation of the form
    ``1:NAME:2`` is its middle.
    """
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> ''").select(F.get(parts, F.lit(0)).alias("doc_key"), F.get(parts, F.lit(1)).alias("text"), parts.alias("p"))
    groups = F.transform(F.sequence(F.lit(3), F.size("p") - PAIR_FIELDS + 1, F.lit(PAIR_FIELDS)), lambda i: F.slice("p", i, PAIR_FIELDS))
    rows = rows.where(F.size("p") > PAIR_FIELDS).select("doc_key", "text", F.posexplode(groups).alias("pos", "g"))
    ints = lambda c: F.transform(F.split(c, ":"), lambda x: x.cast("int"))

    def arg(name: str, at: int) -> list[Column]:
        g = lambda k: F.col("g")[at + k]
        return [
            g(0).alias(f"{name}_entity_id"),
            F.split(g(1), r"\|").alias(f"{name}_mentions"),
            g(2).alias(f"{name}_entity_type"),
            ints(g(3)).alias(f"{name}_begins"),
            ints(g(4)).alias(f"{name}_ends"),
            ints(g(5)).alias(f"{name}_sentences"),
        ]

    relation = F.coalesce(F.nullif(F.regexp_extract(F.col("g")[0], r"^\d+:(.*):\d+$", 1), F.lit("")), F.col("g")[0])
    return rows.select("doc_key", "text", "pos", relation.alias("relation"), F.col("g")[1].alias("direction"), F.col("g")[2].alias("cross"), *arg("arg1", 5), *arg("arg2", 11))


#: A line with a resource, its abstract and the language (fixed format).
ABSTRACT = r'<http://dbpedia\.org/resource/([^\s]+)> <[^\s]+> "(.*)"@(\w+) \.'


def read_abstracts(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """Entity pages from N-Triples of abstracts: entity_id, canonical_name, description, in one language; comments are skipped."""
    rows = spark.read.text(path).where("NOT startswith(value, '#') AND value <> ''")
    part = lambda n: F.regexp_extract("value", ABSTRACT, n)
    rows = rows.select(part(1).alias("entity_id"), part(2).alias("text"), part(3).alias("lang")).where(F.col("lang") == lang)
    return rows.select("entity_id", F.translate("entity_id", "_", " ").alias("canonical_name"), F.replace("text", F.lit("\\"), F.lit("")).alias("description"))


CONCEPT = "struct<`@PreferredConceptYN`:string,ScopeNote:string,TermList:struct<Term:string>>"
TERM = "struct<`@ConceptPreferredTermYN`:string,String:string>"


def _listed(raw: Column, element: str) -> Column:
    """A JSON list, or a single element as a list of one."""
    return F.when(F.startswith(F.trim(raw), F.lit("[")), F.from_json(raw, f"array<{element}>")).otherwise(F.array(F.from_json(raw, element)))


def read_subject_headings(spark: SparkSession, path: str, record_set: str = "DescriptorRecordSet", record: str = "DescriptorRecord", ui: str = "DescriptorUI", name: str = "DescriptorName") -> DataFrame:
    """Entity pages of a subject-heading file (JSON): synonyms are the other terms of the preferred concept.

    The description is the annotation and the preferred concept's scope note;
    the type follows from the first tree number. Fields that hold an object or
    a list are read as lists. For supplements give the names of their keys.
    """
    schema = f"`{record_set}` struct<`{record}`:array<struct<`{ui}`:string,`{name}`:struct<String:string>,Annotation:string,ConceptList:struct<Concept:string>,TreeNumberList:struct<TreeNumber:string>>>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(F.col(record_set)[record]).alias("r"))
    concepts = F.filter(_listed(F.col("r.ConceptList.Concept"), CONCEPT), lambda c: c["@PreferredConceptYN"] == "Y")
    numbers = F.col("r.TreeNumberList.TreeNumber")
    tree = F.when(numbers.isNull(), F.array().cast("array<string>")).when(F.startswith(F.trim(numbers), F.lit("[")), F.from_json(numbers, "array<string>")).otherwise(F.array(numbers))
    r = r.select(F.col("r")[ui].alias("entity_id"), F.col("r")[name]["String"].alias("canonical_name"), F.col("r.Annotation").alias("_a"), F.get(concepts, F.lit(0)).alias("_c"), tree.alias("tree_numbers"))
    terms = F.filter(_listed(F.col("_c.TermList.Term"), TERM), lambda t: t["@ConceptPreferredTermYN"] != "Y")
    return r.select("entity_id", tree_category(F.col("tree_numbers")).alias("entity_type"), "canonical_name", F.transform(terms, lambda t: t["String"]).alias("synonyms"), F.concat_ws(" ", "_a", "_c.ScopeNote").alias("description"), "tree_numbers")


def documents_of_vertices(df: DataFrame) -> DataFrame:
    """Documents of the form title, sents (array of token arrays), vertexSet, labels as working tables' input.

    Gives doc_key, sentences, mentions (token spans of the document, inclusive)
    and relations; blank tokens are left out and places shifted accordingly.
    ``df``: title, sents array<array<string>>, vertexSet
    array<array<struct<sent_id,pos,name,type>>>, labels array<struct<h,t,r,evidence>>.
    """
    from lodestone.functions.text import bind

    kept = F.transform("sents", lambda s: F.filter(s, lambda w: F.trim(w) != ""))
    # First token of each sentence in the document, blank tokens not counted.
    before = F.aggregate("sents", F.array(F.lit(0)), lambda a, s: F.array_append(a, F.element_at(a, -1) + F.size(F.filter(s, lambda w: F.trim(w) != ""))))

    def place(firsts: Column, m: Column, at: Column) -> Column:
        full = F.size(F.filter(F.slice(F.get(F.col("sents"), m["sent_id"]), F.lit(1), at), lambda w: F.trim(w) != ""))
        return F.get(firsts, m["sent_id"]) + full

    one = lambda firsts: F.flatten(F.transform("vertexSet", lambda v, i: F.transform(v, lambda m: F.struct(F.array(place(firsts, m, m["pos"][0]), place(firsts, m, m["pos"][1]) - 1).alias("span"), m["name"].alias("name"), m["type"].alias("entity_type"), i.cast("string").alias("entity_id")))))
    rel = F.transform("labels", lambda x: F.struct(x["h"].alias("arg1"), x["r"].alias("relation"), x["t"].alias("arg2"), x["evidence"].alias("evidences")))
    return df.select(F.col("title").alias("doc_key"), F.transform(kept, lambda s: F.array_join(s, " ")).alias("sentences"), bind(before, one).alias("mentions"), rel.alias("relations"))


def tables_of_pairs(pairs: DataFrame) -> dict[str, DataFrame]:
    """The working tables of ``read_pairs``: mentions, entities, relations and excluded pairs.

    mentions: doc_key, m_idx, begin, end (inclusive), name, entity_type,
    entity_id, sorted by span, of equal spans the first; entities share the
    mentions of their spans; relations: doc_key, head, relation, tail, each
    once; excluded: pairs marked ``not_include``.
    """
    from pyspark.sql import Window

    def side(arg: str, nth: int) -> DataFrame:
        each = F.arrays_zip(F.col(f"{arg}_mentions").alias("name"), F.col(f"{arg}_begins").alias("begin"), F.col(f"{arg}_ends").alias("stop"))
        return pairs.select("doc_key", F.struct("pos", F.lit(nth).alias("nth")).alias("at"), F.col(f"{arg}_entity_id").alias("entity_id"), F.col(f"{arg}_entity_type").alias("entity_type"), F.inline(each))

    found = side("arg1", 0).union(side("arg2", 1)).withColumn("end", F.col("stop") - 1)
    one = found.groupBy("doc_key", "begin", "end").agg(F.min_by(F.struct("name", "entity_type", "entity_id"), "at").alias("m"))
    place = F.row_number().over(Window.partitionBy("doc_key").orderBy("begin", "end")) - 1
    mentions = one.select("doc_key", place.alias("m_idx"), "begin", "end", "m.*")
    spans = found.join(mentions.select("doc_key", "begin", "end", "m_idx"), ["doc_key", "begin", "end"])
    ends = pairs.select("doc_key", F.col("arg1_entity_id").alias("head"), "relation", F.col("arg2_entity_id").alias("tail")).distinct()
    return {
        "mentions": mentions,
        "entities": aggregate_mentions(spans.select("doc_key", "m_idx", "name", "entity_type", "entity_id").distinct()),
        "relations": ends.where("relation NOT IN ('not_include', 'NR')"),
        "excluded": ends.where("relation = 'not_include'").drop("relation"),
    }
