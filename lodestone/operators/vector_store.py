"""Vectors of texts, kept by content: a text is encoded once for each model, however often and wherever it occurs.

Below one folder there is a table of vectors for each model, with the hash of
the text as its key. Encoding takes the texts whose hash is not there yet,
encodes distinct ones only, and adds them as a commit of its own; a run that
was broken off has added whole commits or nothing, so the next goes on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.retrieval import comparable
from lodestone.operators.vector_index import VectorIndex

Encoder = Callable[[DataFrame], DataFrame]


def content_key(text: Column) -> Column:
    """The name of a text: its sha256 in hex."""
    return F.sha2(text.cast("binary"), 256)


def by_column(encode: Callable[[Column], Column]) -> Encoder:
    """An encoder from a function of a text Column."""
    return lambda texts: texts.select("text_key", encode(F.col("text")).cast("array<float>").alias("vector"))


class VectorStore:
    """The vectors of one model below ``path``; ``model`` names it with its version, so another version starts anew."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        if not model or not all(c.isalnum() or c in "_.-" for c in model):
            raise ValueError("a model is named by letters, digits, '_', '.' and '-'")
        self.spark, self.path = spark, f"{path.rstrip('/')}/model={model}"

    def vectors(self) -> DataFrame:
        """(text_key, vector) of all texts encoded so far; of equal keys one."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [x.getPath().toString() for x in files.listStatus(where) if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))] if files.exists(where) else []
        if not done:
            return self.spark.createDataFrame([], "text_key string, vector array<float>")
        return self.spark.read.schema("text_key string, vector array<float>").parquet(*done).dropDuplicates(["text_key"])

    def missing(self, texts: DataFrame, text: str) -> DataFrame:
        """(text_key, text): the distinct texts (null: none) that have no vector yet."""
        rows = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").select(content_key(F.col("text")).alias("text_key"), "text")
        # Hashes meet hashes; the text itself is joined to what is left.
        return rows.join(self.vectors().select("text_key"), "text_key", "left_anti").dropDuplicates(["text_key"])

    def encode(self, texts: DataFrame, text: str, encoder: Encoder, key: str) -> DataFrame:
        """(key, vector) of every row, encoding what is missing first. ``encoder``: (text_key, text) to (text_key, vector). Null texts have a null vector."""
        self.add(texts, text, encoder)
        wanted = texts.select(F.col(key), content_key(F.col(text)).alias("text_key"))
        return wanted.join(self.vectors(), "text_key", "left").select(key, "vector")

    def add(self, texts: DataFrame, text: str, encoder: Encoder) -> None:
        """Encode the texts that are missing and add their vectors."""
        new = encoder(self.missing(texts, text)).select("text_key", F.col("vector").cast("array<float>").alias("vector"))
        new.write.parquet(f"{self.path}/{uuid.uuid4().hex}")


def refreshed_index(store: VectorStore, entities: DataFrame, key: str, text: str, encoder: Encoder, path: str, **settings) -> VectorIndex:
    """An index over the vectors of all entities' texts, made anew from the store: only texts that it lacks are encoded."""
    vectors = store.encode(entities, text, encoder, key)
    return VectorIndex.build(vectors.where(comparable(F.col("vector"))), key, "vector", path, **settings)


def dense_candidates(mentions: DataFrame, index: VectorIndex, store: VectorStore, encoder: Encoder, k: int, key: str = "doc_key", name: str = "name") -> DataFrame:
    """Ranked candidate entities of each mention: key, m_idx, rank, the index's key, score. Equal names are encoded and searched once."""
    names = mentions.select(F.lower(name).alias("_name")).where("_name IS NOT NULL").distinct()
    asked = store.encode(names, "_name", encoder, "_name")
    found = index.search(asked, "_name", "vector", k)
    return mentions.select(key, "m_idx", F.lower(name).alias("_name")).join(found, "_name").select(key, "m_idx", "rank", index.key, "score")
