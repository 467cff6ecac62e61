"""Importance resampling of documents towards a target distribution.

Features are the n-grams of a text's words, hashed to buckets. What a bucket
gains in the target over the corpus gives documents weights, and noise that is
a function of the id alone makes the highest scores a sample by those weights.

Each slice of a partition is taken as one sequence of word ids. Its suffixes
are sorted as deep as the longest n-gram reaches; runs of suffixes that agree
in their first n words (longest common prefix of n and more) are the distinct
n-grams. Each run is hashed once, and its bucket is scattered back to the
places where its suffixes start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.text_arrow import slices, string_column
from lodestone.plans.staging import stage

#: What separates words: every ASCII character but digits and lower-case letters, after A-Z are lowered (fixed value).
BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


class WordIds:
    """The words of some texts as numbers: ``ids`` over ``unique``, ``doc`` the text of each, ``start`` each text's first."""

    def __init__(self, texts: pa.Array):
        split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN_WORDS)
        flat = split.flatten()
        doc = pc.list_parent_indices(split).to_numpy()
        full = pc.greater(pc.binary_length(flat), 0)
        if len(flat) and not pc.all(full).as_py():
            doc = doc[full.to_numpy(zero_copy_only=False)]
            flat = flat.filter(full)
        coded = flat.dictionary_encode()
        self.unique = [w.encode() for w in coded.dictionary.to_pylist()]
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.doc = doc
        self.start = np.searchsorted(doc, np.arange(len(texts) + 1))


def suffix_order(ids: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``ids`` in the order of their suffixes, told apart by up to ``depth`` words at least; suffixes end with their text.

    Ranks by the first words are doubled until they reach ``depth`` words.
    """
    rank, known = ids + 1, 1  # 0 is the end of a text
    while known < depth:
        ahead = np.zeros_like(rank)
        if len(rank) > known:
            same = doc[known:] == doc[:-known]
            ahead[:-known][same] = rank[known:][same]
        order = np.lexsort((ahead, rank))
        new = np.ones(len(rank), bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        known *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, doc: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order the number of words, up to ``depth``, that it shares with the one before (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(depth):
        a, b = order[alive - 1], order[alive]
        inside = (a + k < len(ids)) & (b + k < len(ids))
        alive, a, b = alive[inside], a[inside] + k, b[inside] + k
        same = (ids[a] == ids[b]) & (doc[a] == doc[order[alive - 1]]) & (doc[b] == doc[order[alive]])
        alive = alive[same]
        out[alive] = k + 1
    return out


def feature_buckets(words: WordIds, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, bucket) of every occurrence of a run of 1 to ``max_n`` words within a text."""
    order = suffix_order(words.ids, words.doc, max_n)
    shared = common_prefixes(words.ids, words.doc, order, max_n)
    left = words.start[words.doc + 1] - np.arange(len(words.ids))  # words from each place to its text's end
    docs, found = [], []
    for n in range(1, max_n + 1):
        reach = left[order] >= n
        at, first = order[reach], (shared < n)[reach]
        # A suffix too short for n words sorts before all that go on, so no run is torn by leaving it out.
        heads = at[first]
        of_run = np.empty(len(heads), np.int64)
        for r, h in enumerate(heads.tolist()):
            of_run[r] = zlib.crc32(b" ".join([words.unique[i] for i in words.ids[h : h + n].tolist()])) % buckets
        scattered = np.empty(len(words.ids), np.int64)
        scattered[at] = of_run[np.cumsum(first) - 1] if len(at) else 0
        places = np.flatnonzero(left >= n)
        docs.append(words.doc[places])
        found.append(scattered[places])
    return np.concatenate(docs), np.concatenate(found)


def bucket_counts(texts: DataFrame, text_col: str, max_n: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; every task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                total += np.bincount(feature_buckets(WordIds(string_column(part, "_text")), max_n, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select(texts[text_col].cast("string").alias("_text"))
    return rows.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, floor(1000 * ln of the smoothed target share over the smoothed corpus share).

    The two sides are tables (bucket, n) of at most ``buckets`` rows, so the
    result is of fixed size whatever the corpus is.
    """
    both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.collect():  # at most ``buckets`` rows
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def feature_weights(df: DataFrame, id_col: str, text_col: str, gains: np.ndarray, max_n: int) -> DataFrame:
    """(_id, n_words, n_features, weight) of every row: weight is the floored mean of its features' gains, 0 without any."""
    rows = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words = WordIds(string_column(part, "_text"))
                doc, bucket = feature_buckets(words, max_n, len(gains))
                n = np.bincount(doc, minlength=part.num_rows)
                total = np.bincount(doc, weights=gains[bucket], minlength=part.num_rows).astype(np.int64)  # exact below 2**53
                columns = [part.column("_id"), pa.array(np.diff(words.start).astype(np.int64)), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, f"_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(id_col: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the first 8 hex digits of sha256(``seed:id``), rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked_by_score(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` with the rank of the floor(percent * N / 100) best of the N rows that are ``_in``; null for all others.

    Scores are whole numbers within a range that depends on the counts' logarithms
    only, so their histogram is small: its sums give the place of the first row
    of every score, and rows are numbered within one score alone.
    """
    held = scored.where("_in").groupBy("score").agg(F.count(F.lit(1)).alias("_k"))
    block = F.floor(F.col("score") / 256)
    before = Window.partitionBy("_b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy(block.alias("_b")).agg(F.sum("_k").alias("_kb"))
    over = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row for 256 scores
    blocks = blocks.select("_b", F.coalesce(F.sum("_kb").over(over), F.lit(0)).alias("_higher"))
    held = held.withColumn("_b", block).withColumn("_within", F.coalesce(F.sum("_k").over(before), F.lit(0))).join(blocks, "_b")
    n = scored.agg(F.count(F.when(F.col("_in"), 1))).first()[0]
    drawn = n * percent // 100
    starts = held.select(F.col("score").alias("_s"), (F.col("_higher") + F.col("_within")).alias("_start")).where(F.col("_start") < drawn)
    starts = stage(starts, "score-places")
    least = starts.agg(F.min("_s")).first()[0]
    reaches = F.col("_in") & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    # Only rows of the scores that are drawn from are numbered.
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.col("_id").asc_nulls_first(), "n_features", "weight"))
    placed = scored.where(reaches).join(starts, F.col("score") == F.col("_s"))
    placed = placed.withColumn("_rank", (F.col("_start") + nth).cast("bigint")).withColumn("rank", F.when(F.col("_rank") <= drawn, F.col("_rank")))
    rest = scored.where(~reaches).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.select(*rest.columns).unionByName(rest)


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    max_n: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: str = "2024",
) -> DataFrame:
    """Draw ``percent`` percent of the documents of at least ``min_words`` words by importance towards ``target``.

    Returns a row for each row of ``df``: id, n_features, weight, score and
    rank (1, 2, 3 ... by score, ties to the smaller id; null if not drawn).

    Null and empty texts have no features and weight 0; texts are taken whole;
    a null id draws its noise as an empty one; repeated rows are drawn each by
    itself; an empty target makes all buckets of it equally likely; an empty
    table gives an empty result.
    """
    corpus = bucket_counts(df, text_col, max_n, buckets)
    gains = bucket_gains(corpus, bucket_counts(target, target_col, max_n, buckets), buckets)
    weighed = feature_weights(df, id_col, text_col, gains, max_n)
    scored = weighed.select("_id", "n_features", "weight", (F.col("weight") + noise(F.col("_id"), seed)).alias("score"), (F.col("n_words") >= min_words).alias("_in"))
    scored = stage(scored, "importance")
    return ranked_by_score(scored, percent).select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")
