"""A training corpus in five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import classifier, decontaminate, jaccard, mixing, sharding
from lodestone.plans.staging import stage

SHARDS = 24


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and the name there of each of its columns."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain, dict(zip(docs.columns, plain.columns, strict=True))


def own_names(rows: DataFrame, name: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(c).alias(own) for own, c in name.items()))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, does not reject.

    Null and empty texts are scored like others; repeated rows go or stay
    together; extra columns are carried along; an empty table stays empty.
    """
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, name = plain_names(docs)
    kept = classifier.score(plain, model, threshold=0.3, id_col=name["doc_id"], text_col=name["text"], keep=tuple(c for c in plain.columns if c != name["doc_id"]))
    return own_names(kept.where("predicted = 1"), name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each component of near duplicates (five words, 0.8).

    Rows that are equal in every column stay once; rows of one id that differ
    in any column, maps included, stay both. Texts without words are near
    nothing; those of a null id are one document.
    """
    groups = jaccard.jaccard_components(docs, size=5, percent=80)
    kept = stage(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct(), "kept")
    plain, name = plain_names(docs)
    # One row for each group: joined in the same way at every size.
    rows = plain.join(kept.hint("merge"), F.col(name["doc_id"]).eqNullSafe(F.col("kept"))).drop("kept")
    # Maps cannot be compared; their entries in order can, or else what they read as.
    kinds = {c: kind for c, kind in rows.dtypes if "map<" in kind or "variant" in kind}
    as_text = {f"as_{c}": F.to_json(F.struct(F.array_sort(F.map_entries(c)) if kind.startswith("map<") and "map<" not in kind[4:] else F.col(c))) for c, kind in kinds.items()}
    return own_names(rows.withColumns(as_text).dropDuplicates([c for c in rows.columns if c not in kinds] + list(as_text)), name)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; all rows of an id that does go. Null and empty texts hold none."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = stage(leaks.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    plain, name = plain_names(docs)
    return own_names(plain.join(leaks, F.col(name["doc_id"]).eqNullSafe(F.col("leak")), "left_anti"), name)


def mixed_order(docs: DataFrame) -> DataFrame:
    """doc_id and its place in the mix, a function of the documents' ids and sources."""
    order = mixing.mix_sources(docs, power=0.5, block_rows=32)
    return stage(order.groupBy("doc_id").agg(F.min("position").alias("place")), "mix-order")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files and the rows in them follow the schedule. Null sources are a source of their own."""
    order = mixed_order(docs).toDF("mixed", "place")
    last = order.agg(F.max("place")).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain, name = plain_names(docs)
    # The order has a row for each document, so it is joined in the same way at every size.
    placed = plain.join(order.hint("merge"), F.col(name["doc_id"]).eqNullSafe(F.col("mixed")))
    part = F.expr(f"cast(place * {parts} div {last + 1} as int)")
    return own_names(placed.repartitionById(parts, part).sortWithinPartitions("place"), name)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes, cut from the mixed order; it is found again from the rows, so it does not matter how they come. Null texts count 8 bytes."""
    return sharding.shard_by_size(docs, SHARDS, order=mixed_order(docs))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: SQL cannot express the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
