"""Readers of plain formats; all take a session and a path that Spark can open."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.parts import numbered

PASSAGE = "title string, text string"
DOCUMENT = (
    "doc_key string, sentences array<string>, mentions array<struct<span:array<int>,name:string,entity_type:string,entity_id:string>>, "
    "entities array<struct<mention_indices:array<int>,mention_names:array<string>,entity_type:string,entity_id:string>>, "
    "relations array<struct<arg1:int,relation:string,arg2:int,evidences:array<int>>>, not_include_pairs array<struct<arg1:int,arg2:int>>"
)
TRIPLE = "head string, relation string, tail string"
ENTITY = "entity_id string, entity_index int, entity_type string, canonical_name string, synonyms array<string>, description string, tree_numbers array<string>"
COMMUNITY = "community_id string, nodes array<string>, level int, parent_community_id string, child_community_ids array<string>"
QUESTION = "question_key string, question string, answers array<struct<answer:string,answer_type:string,list_index:int,answer_index:int>>"
CONTEXTS = "question_key string, contexts array<struct<title:string,text:string,score:double,rank:int>>"


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """A file with one JSON array (a row per element) or one object."""
    return spark.read.schema(schema).option("multiLine", True).option("encoding", encoding).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON object per line."""
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines in a column ``value``."""
    return spark.read.text(path).select(F.trim("value").alias("value"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with answers; ``answer_index`` is taken for a missing ``list_index``."""
    q = read_json(spark, path, QUESTION)
    each = lambda a: F.struct(a["answer"].alias("answer"), a["answer_type"].alias("answer_type"), F.coalesce(a["list_index"], a["answer_index"]).alias("list_index"))
    return q.withColumn("answers", F.transform("answers", each))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, id, freq) of lines with two or three tab-separated fields; any other number is an error."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> ''").select(parts.alias("p"))
    bad = F.raise_error(F.concat(F.lit("vocabulary line with "), F.size("p").cast("string"), F.lit(" fields"))).cast("string")
    word = F.when(F.size("p").isin(2, 3), F.get("p", F.lit(0))).otherwise(bad)
    return rows.select(word.alias("word"), F.get("p", F.lit(1)).cast("int").alias("id"), F.get("p", F.lit(2)).cast("bigint").alias("freq"))


def vocabulary(df: DataFrame, col: str, null_label: str | None = None) -> DataFrame:
    """(word, id) of the sorted distinct labels of a column; a null label, if named, has id 0."""
    words = df.select(F.col(col).alias("word")).where("word IS NOT NULL").distinct()
    first = 0 if null_label is None else 1
    out = numbered(words, "word").select("word", (F.col("n") + first).cast("int").alias("id"))
    if null_label is not None:
        out = df.sparkSession.range(1).select(F.lit(null_label).alias("word"), F.lit(0).alias("id")).union(out)
    return out


def read_rrf(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A pipe-separated table of strings whose lines end in a separator; empty fields are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_end"]])
    return spark.read.schema(schema).option("sep", "|").option("quote", "").option("nullValue", "").csv(path).drop("_end")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_wiki_passages(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of id, text, title with a header row."""
    return spark.read.schema("id string, text string, title string").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_article_tree(spark: SparkSession, path: str, schema: str = "id string, url string, title string, text string") -> DataFrame:
    """JSON lines in nested folders, with the file they come from for order."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path).withColumn("source_file", F.input_file_name())


def read_python_lists(spark: SparkSession, path: str, columns: list[str], lists: list[str], sep: str = "\t") -> DataFrame:
    """A separated table some of whose columns hold list literals."""
    from lodestone.operators.kb import python_list

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    out = spark.read.schema(schema).option("sep", sep).option("quote", "").csv(path)
    for c in lists:
        out = out.withColumn(c, python_list(F.col(c)))
    return out


def prompt_template(name_or_path: str, spark: SparkSession | None = None) -> str:
    """A packaged template by its name, or a text file by its path."""
    if "/" not in name_or_path:
        return resources.files("lodestone.sources").joinpath("templates", name_or_path + ".txt").read_text()
    if spark is None:
        raise ValueError("a session is needed to read a template by path")
    return spark.read.text(name_or_path, wholetext=True).first()[0]
