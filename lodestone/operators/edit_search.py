"""Exact nearest texts by edit distance, without comparing all with all.

First the close ones: cut each text into r + 1 segments; a text within r edits
of a query holds one of them whole, at a place that is off by few characters.
Queries meet the texts that share such a segment, for growing r, and one is
settled when its k-th best distance is at most r.

Then, for queries with nothing so near: a distance is at least the difference
of lengths, so texts are met by length, in rings around the query's own, and a
query is settled when its k-th best distance is below the next ring.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import ranked
from lodestone.plans.staging import stage

#: Radii of the first part, and widest differences of length of the rings; each further ring is four times as wide.
RADII = (1, 3)
FIRST_RING = 2
#: Parts that the texts of one length are dealt to.
SALTS = 16


def _bounds_of_segment(length: Column, i: Column, r: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of r + 1; the last ones take what is left over."""
    parts = r + 1
    short, longer = F.floor(length / parts).cast("int"), F.pmod(length, F.lit(parts))
    plain = F.lit(parts) - longer  # segments without one more
    return (i * short + F.greatest(F.lit(0), i - plain)).cast("int"), (short + F.when(i >= plain, 1).otherwise(0)).cast("int")


def segments_of_texts(texts: DataFrame, r: int) -> DataFrame:
    """(_t, _length, _i, _part): r + 1 segments of each text, or the whole as -1 if it has no more than r characters."""
    length = F.length("_t")
    i = F.explode(F.when(length > r, F.sequence(F.lit(0), F.lit(r))).otherwise(F.array(F.lit(-1)))).alias("_i")
    cut = texts.select("_t", "_held", length.alias("_length"), i)
    start, size = _bounds_of_segment(F.col("_length"), F.col("_i"), r)
    part = F.when(F.col("_i") < 0, F.lit("")).otherwise(F.substring(F.col("_t"), start + 1, size))
    return cut.select("_t", "_held", "_length", "_i", part.alias("_part"))


def segments_of_queries(asked: DataFrame, r: int) -> DataFrame:
    """(_q, _length, _i, _part): for every length that texts within r edits can have, the places where their segments can stand."""
    own = F.length("_q")
    wide = asked.select("_q", own.alias("_own"), F.explode(F.sequence(F.greatest(F.lit(0), own - r), own + r)).alias("_length"))
    i = F.explode(F.when(F.col("_length") > r, F.sequence(F.lit(0), F.lit(r))).otherwise(F.array(F.lit(-1)))).alias("_i")
    wide = wide.select("_q", "_own", "_length", i)
    start, size = _bounds_of_segment(F.col("_length"), F.col("_i"), r)
    shift = F.col("_own") - F.col("_length")
    # Edits before the segment move it by at most i, those behind it by at most r - i.
    low = F.greatest(F.lit(0), start - F.col("_i"), start + shift - (r - F.col("_i")))
    high = F.least(F.col("_own") - size, start + F.col("_i"), start + shift + (r - F.col("_i")))
    places = F.when(F.col("_i") < 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high))
    wide = wide.select("_q", "_length", "_i", size.alias("_size"), F.explode(places).alias("_at"))
    part = F.when(F.col("_i") < 0, F.lit("")).otherwise(F.substring(F.col("_q"), F.col("_at") + 1, F.col("_size")))
    return wide.select("_q", "_length", "_i", part.alias("_part")).distinct()


def near_candidates(asked: DataFrame, texts: DataFrame, r: int) -> DataFrame:
    """(_q, _t, _held): all pairs within r edits, and others that share a segment."""
    return segments_of_texts(texts, r).join(segments_of_queries(asked, r), ["_length", "_i", "_part"]).select("_q", "_t", "_held").distinct()


def ring_candidates(asked: DataFrame, texts: DataFrame, low: int, high: int) -> DataFrame:
    """(_q, _t, _held, _most): all pairs whose lengths differ by ``low`` to ``high``, the texts of one length dealt to SALTS tasks."""
    salted = texts.select("_t", "_held", F.length("_t").alias("_length"), F.pmod(F.xxhash64("_t"), F.lit(SALTS)).cast("int").alias("_salt"))
    own = F.length("_q")
    lengths = F.filter(F.sequence(F.greatest(F.lit(0), own - high), own + high), lambda x: F.abs(x - own) >= low)
    wide = asked.select("_q", "_most", F.explode(lengths).alias("_length"))
    wide = wide.join(salted.select("_length").distinct(), "_length", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(wide, ["_length", "_salt"]).select("_q", "_t", "_held", "_most")


def _k_best(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs (_q, _t, _held, _d) that can be among the k best keys of a query, with the k-th distance _kth (null: fewer keys)."""
    # Keys at each distance come first, so the window is over distances and not over pairs.
    levels = pairs.groupBy("_q", "_d").agg(F.sum("_held").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_q").orderBy("_d"))
    kth = levels.withColumn("_upto", upto).where(F.col("_upto") >= k).groupBy("_q").agg(F.min("_d").alias("_kth"))
    return pairs.join(kth, "_q", "left").where(F.col("_kth").isNull() | (F.col("_d") <= F.col("_kth")))


def nearest_texts(texts: DataFrame, asked: DataFrame, k: int, counted=None) -> DataFrame:
    """(_q, _t, _d): for each distinct query text the texts that hold its ``k`` nearest keys, ties included.

    ``texts``: _t, distinct, and _held, how many keys it stands for; ``asked``:
    _q, distinct. ``counted`` is told the step and the candidates of each round
    as a DataFrame (for tests).
    """
    texts, open_ = stage(texts, "texts"), stage(asked, "asked")
    settled: list[DataFrame] = []
    best = None
    for r in RADII:
        pairs = near_candidates(open_, texts, r)
        if counted:
            counted(f"radius {r}", pairs)
        near = pairs.withColumn("_d", F.levenshtein("_q", "_t", r)).where("_d >= 0")
        held = stage(_k_best(near, k), "near-texts")
        settled.append(held.where("_kth IS NOT NULL").select("_q", "_t", "_d"))
        open_ = stage(open_.join(held.where("_kth IS NOT NULL").select("_q").distinct(), "_q", "left_anti"), "asked")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
    longest = texts.agg(F.max(F.length("_t"))).first()[0] or 0
    longest = max(longest, open_.agg(F.max(F.length("_q"))).first()[0] or 0)
    low, high = 0, FIRST_RING
    open_ = open_.withColumn("_most", F.lit(None).cast("int"))
    while True:
        pairs = ring_candidates(open_, texts, low, high)
        if counted:
            counted(f"ring {low} to {high}", pairs)
        far = F.greatest(F.length("_q"), F.length("_t"))
        met = pairs.withColumn("_d", F.levenshtein("_q", "_t")) if low == 0 else pairs.withColumn("_d", F.expr("levenshtein(_q, _t, coalesce(_most, greatest(length(_q), length(_t))))")).where("_d >= 0")
        met = met.where(F.col("_d") <= far).select("_q", "_t", "_held", "_d")
        held = stage(_k_best(met if best is None else met.unionByName(best), k), "near-texts")
        last = high >= longest
        done = held.where(F.lit(last) | (F.col("_kth") <= high))
        settled.append(done.select("_q", "_t", "_d"))
        if last:
            return reduce(DataFrame.unionByName, settled)
        kths = held.where("_kth IS NOT NULL").select("_q", F.col("_kth").alias("_most")).distinct()
        open_ = open_.drop("_most").join(kths, "_q", "left")
        open_ = stage(open_.where(F.col("_most").isNull() | (F.col("_most") > high)), "asked")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        best = held.join(open_.select("_q"), "_q", "left_semi").select("_q", "_t", "_held", "_d")
        low, high = high + 1, high * 4


def string_search(passages: DataFrame, queries: DataFrame, key: str, query: str, text: str, query_text: str, k: int, counted=None) -> DataFrame:
    """The ``k`` passages closest to each query by 1 / (Levenshtein distance + 1): query, key, score, rank.

    Equal texts are compared once. Null texts are found by no query and find
    nothing; empty ones are texts like others.
    """
    rows = passages.select(F.col(key).alias("_key"), F.col(text).alias("_t")).where("_t IS NOT NULL")
    texts = rows.groupBy("_t").agg(F.count(F.lit(1)).alias("_held"))
    asked = queries.select(F.col(query_text).alias("_q")).where("_q IS NOT NULL").distinct()
    found = nearest_texts(texts, asked, k, counted)
    # The k best keys are among the first k of each text.
    nth = F.row_number().over(Window.partitionBy("_t").orderBy("_key"))
    keys = rows.join(found.select("_t").distinct(), "_t", "left_semi").withColumn("_n", nth).where(F.col("_n") <= k).drop("_n")
    scored = found.join(keys, "_t").select("_q", "_key", (F.lit(1.0) / (F.col("_d") + 1)).alias("score"))
    best = ranked(scored, "_q", "_key", k)
    return queries.select(query, F.col(query_text).alias("_q")).join(best, "_q").select(query, F.col("_key").alias(key), "score", "rank")
