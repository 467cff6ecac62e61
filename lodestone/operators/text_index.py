"""A persisted inverted index for BM25, searched by upper bounds of blocks.

Below one folder there are three tables, each with one partition a segment:
``passages`` (key, length, block), ``postings`` (a row for each term and
block of at most 64 passages, with the passages, the largest frequency and
the least length among them; one without a term lists a block's passages) and
``sums``. A block's postings lie in one file. Nothing in a segment depends on the rest of the corpus, so more
segments can be added at any time: weights of terms and bounds of blocks are
worked out from the sums at search time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import ranked
from lodestone.plans.staging import stage, unstage

#: Passages of a block are 2 ** BLOCK_BITS at most.
BLOCK_BITS = 6


def _block(rows: pa.Table) -> pa.RecordBatch:
    """The postings of one block's passages (block, key, len, terms), by term, and a row without a term for all its passages."""
    keys, lens = rows["key"].combine_chunks(), rows["len"].to_numpy()
    sizes = pc.fill_null(pc.list_value_length(rows["terms"]), 0).to_numpy()
    words = pc.list_flatten(rows["terms"]).combine_chunks().dictionary_encode()
    at = np.repeat(np.arange(len(lens)), sizes)
    codes = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = words.dictionary
    order = pc.sort_indices(terms).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at, codes = at[codes >= 0], codes[codes >= 0]
    pairs, tf = np.unique(place[codes] * len(lens) + at, return_counts=True)
    term, at = pairs // len(lens), pairs % len(lens)
    # The passages' own row comes last.
    heads = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    at, tf = np.append(at, np.arange(len(lens))), np.append(tf, np.zeros(len(lens), np.int64))
    entries = pa.StructArray.from_arrays([keys.take(pa.array(at)), pa.array(tf, pa.int64()), pa.array(lens[at], pa.int32())], ["key", "tf", "len"])
    offsets = np.append(heads, len(at))
    columns = {
        "term": pa.concat_arrays([terms.take(pa.array(order)), pa.nulls(1, terms.type)]),
        "block": pa.array(np.full(len(heads), rows["block"][0].as_py()), pa.int64()),
        "n": pa.array(np.diff(offsets), pa.int64()),
        "most": pa.array(np.maximum.reduceat(tf, heads), pa.int64()),
        "shortest": pa.array(np.minimum.reduceat(lens[at], heads), pa.int32()),
        "entries": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries),
    }
    return pa.RecordBatch.from_pydict(columns)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of passages that come block by block."""
    held: list[pa.RecordBatch] = []  # of the last block
    for batch in batches:
        block = batch["block"].to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0]["block"][0].as_py() != block[lo]:
                yield _block(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield _block(pa.Table.from_batches(held))


class TextIndex:
    """A saved index; ``build`` makes one, ``TextIndex(spark, path)`` finds one again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.key, self.key_type, self.k1, self.b = about["key"], about["key_type"], about["k1"], about["b"]

    @staticmethod
    def build(passages: DataFrame, key: str, path: str, terms: str = "terms", k1: float = 1.5, b: float = 0.75) -> TextIndex:
        """An index over the passages (``key``, and ``terms``, an array of strings; null: none), saved below ``path``."""
        spark = passages.sparkSession
        kind = passages.schema[key].dataType.simpleString()
        about = spark.range(1).select(F.lit(key).alias("key"), F.lit(kind).alias("key_type"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))
        about.write.parquet(f"{path}/about")
        index = TextIndex(spark, path)
        index.append(passages, key, terms, "first")
        return index

    def append(self, passages: DataFrame, key: str, terms: str = "terms", segment: str | None = None) -> None:
        """Add passages as a segment; one of the same name is replaced, so a repeated append changes nothing. Keys are not compared with those already there."""
        segment = segment or uuid.uuid4().hex
        rows = passages.select(F.col(key).alias("key"), F.coalesce(F.col(terms), F.array().cast("array<string>")).alias("terms"))
        # Passages of like length and neighbouring keys share a block: often they share a source and its words too.
        like = F.floor(F.log2(F.size("terms") + 1)).alias("_like")
        rows = rows.select("*", F.size("terms").alias("len"), like).repartitionByRange("_like", "key").sortWithinPartitions("_like", "key").drop("_like")
        block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)  # blocks do not span partitions
        # A block's postings are made where its passages were sorted, and stay in one file: words are shuffled once, with their passages.
        made = rows.select(block.alias("block"), "key", "len", "terms").mapInArrow(_postings, self._postings_schema())
        path = f"{self.path}/postings/segment={segment}"
        made.write.mode("overwrite").parquet(path)
        held = self.spark.read.schema(self._postings_schema()).parquet(path).where("term IS NULL").select("block", F.inline("entries"))
        held.select("key", "len", "block").write.mode("overwrite").parquet(f"{self.path}/passages/segment={segment}")
        held = self.spark.read.schema(f"key {self.key_type}, len int, block bigint").parquet(f"{self.path}/passages/segment={segment}")
        held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("len").cast("bigint")), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{self.path}/sums/segment={segment}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, segment string").parquet(f"{self.path}/{name}")

    def passages(self) -> DataFrame:
        return self._read("passages", f"key {self.key_type}, len int, block bigint")

    def postings(self) -> DataFrame:
        return self._read("postings", self._postings_schema()).where("term IS NOT NULL")

    def _postings_schema(self) -> str:
        return f"term string, block bigint, n bigint, most bigint, shortest int, entries array<struct<key: {self.key_type}, tf: bigint, len: int>>"

    def _sums(self) -> tuple[int, float]:
        """Number of passages and their mean length."""
        n, total = self._read("sums", "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
        return n or 0, (total or 0) / n if n else 0.0

    def _part(self, weight: Column, tf: Column, length: Column, mean: float) -> Column:
        """What a term adds to a passage's score; it grows with tf and falls with the length."""
        share = length / F.lit(mean) if mean else F.lit(0.0)
        return weight * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * share))

    def weights(self, queries: DataFrame, query: str, terms: str = "terms") -> DataFrame:
        """(query, term, weight) of the terms in at most half of the passages; a term that a query repeats counts as often."""
        n, _ = self._sums()
        wanted = queries.select(query, F.explode(terms).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qtf"))
        held = self.postings().select("term", "n").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        return wanted.join(held, "term").select(query, "term", (F.col("qtf") * idf).alias("weight")).where("weight > 0")

    def bounds(self, weights: DataFrame, query: str) -> DataFrame:
        """(query, segment, block, bound): no passage of the block scores higher. Only the heads of postings are read."""
        _, mean = self._sums()
        heads = self.postings().select("term", "segment", "block", "most", "shortest")
        bound = self._part(F.col("weight"), F.col("most"), F.col("shortest"), mean)
        return heads.join(weights, "term").groupBy(query, "segment", "block").agg(F.sum(bound).alias("bound"))

    def scores(self, weights: DataFrame, blocks: DataFrame, query: str) -> DataFrame:
        """(query, key, score) of all passages in the given blocks (query, segment, block) that hold a weighted term."""
        _, mean = self._sums()
        # Postings of weighted terms are shuffled by their block alone, where its passages' scores are summed too.
        asked = weights.groupBy("term").agg(F.collect_list(F.struct(query, "weight")).alias("_asked"))
        need = blocks.groupBy("segment", "block").agg(F.collect_set(query).alias("_need"))
        met = self.postings().select("term", "segment", "block", "entries").join(asked, "term").join(need, ["segment", "block"])
        wanted = F.filter("_asked", lambda x: F.array_contains("_need", x[query]))
        each = met.select("segment", "block", "entries", F.inline(wanted)).select(query, "weight", "segment", "block", F.inline("entries"))
        part = self._part(F.col("weight"), F.col("tf"), F.col("len"), mean)
        return each.groupBy(query, "segment", "block", "key").agg(F.sum(part).alias("score")).select(query, "key", "score")

    def top_blocks(self, queries: DataFrame, query: str, k: int, terms: str = "terms", first: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Weights, blocks and scores of a search: the ``first`` blocks of greatest bound are read for each query, then those whose bound reaches its k-th best score so far.

        Blocks are (query, segment, block, bound, read); a block not ``read`` holds none of the k best.
        """
        weights = stage(self.weights(queries, query, terms), "term-weights")
        place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("bound"), "segment", "block"))
        bounds = stage(self.bounds(weights, query).withColumn("place", place), "block-bounds")
        early = stage(self.scores(weights, bounds.where(F.col("place") <= first), query), "block-scores")
        floor = ranked(early, query, "key", k).where(F.col("rank") == k).select(F.col(query).alias("_q"), F.col("score").alias("_floor"))
        # Scores are compared rounded to 9 places, so bounds are given as much room.
        reaches = F.col("bound") > F.coalesce("_floor", F.lit(0.0)) - 2e-9
        blocks = bounds.join(floor, F.col(query) == F.col("_q"), "left").withColumn("read", (F.col("place") <= first) | reaches)
        blocks = stage(blocks.select(query, "segment", "block", "bound", "place", "read"), "blocks-read")
        late = self.scores(weights, blocks.where((F.col("place") > first) & F.col("read")), query)
        return weights, blocks, early.unionByName(late)

    def search(self, queries: DataFrame, query: str, k: int, terms: str = "terms", fill: bool = True) -> DataFrame:
        """The ``k`` best passages of each query, the same rows as ``retrieval.bm25_search`` over all passages: query, key, score, rank.

        With ``fill`` a list that passages of positive score cannot fill goes
        on with others in key order, at score 0.
        """
        _, _, scored = self.top_blocks(queries, query, k, terms)
        if fill:
            more = queries.select(query).distinct().crossJoin(F.broadcast(self.passages().select("key").orderBy("key").limit(2 * k)))  # 2 k keys
            scored = stage(scored, "scored")
            scored = scored.unionByName(more.join(scored, [query, "key"], "left_anti").withColumn("score", F.lit(0.0)))
        return ranked(scored, query, "key", k).select(query, F.col("key").alias(self.key), "score", "rank")
