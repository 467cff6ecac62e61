"""Size-balanced sharding with sampled splitters (DataFrame operations only).

A size-weighted sample of keys gives quantile boundaries; records are
range-partitioned between them. Ranges that turn out overfull are subdivided
the same way: by the quantiles of a sample drawn inside them, so key order
holds throughout. Prefix sums over the ranges place each record by the bytes
before it. Each shard is a contiguous run of the key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import stage, unstage

SMALLEST = -(2**63)
#: Pieces that one range is cut into at a time, at most.
FAN_OUT = 1024
KEYS = ("_k1", "_k2", "_k3")


def _as_key(col: Column, kind: str) -> Column:
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(col.cast("bigint") if whole else F.xxhash64(col), F.lit(SMALLEST))


def _reached(bounds: Column) -> Column:
    """How many of the sorted bounds (structs of KEYS) a record's key has reached, by binary search."""
    steps = [1 << i for i in reversed(range(FAN_OUT.bit_length()))]

    def step(pos: Column, size: Column) -> Column:
        x = F.get(bounds, pos + size - 1)
        k1, k2, k3 = (F.col(k) for k in KEYS)
        reached = (k1 > x["_k1"]) | ((k1 == x["_k1"]) & ((k2 > x["_k2"]) | ((k2 == x["_k2"]) & (k3 >= x["_k3"]))))
        return F.when((pos + size <= F.size(bounds)) & reached, pos + size).otherwise(pos)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), step)


def _subdivided(rows: DataFrame, full: DataFrame, draws: int, bounded: bool) -> DataFrame:
    """``rows`` with the ranges in ``full`` (_range, _bytes, _pieces) cut at sampled quantiles of the key; _range grows by a digit."""
    side = F.broadcast(full) if bounded else full
    # Poisson sample: a record's chance is in proportion to its size.
    draw = F.pmod(F.xxhash64(*KEYS, "_range", F.lit(9)), F.lit(2**40)) / F.lit(float(2**40))
    drawn = rows.join(side, "_range").where(draw < F.col("_size") * F.col("_pieces") * draws / F.col("_bytes"))
    inside = Window.partitionBy("_range")
    nth, of = F.row_number().over(inside.orderBy(*KEYS)), F.count(F.lit(1)).over(inside)
    tile = F.floor((nth - 1) * F.col("_pieces") / of)
    least = drawn.select("_range", *KEYS, tile.alias("_tile")).groupBy("_range", "_tile").agg(F.min(F.struct(*KEYS)).alias("_b")).where("_tile > 0")
    bounds = stage(least.groupBy("_range").agg(F.array_sort(F.collect_list("_b")).alias("_bounds")), "shard-bounds")
    cut = rows.join(F.broadcast(bounds) if bounded else bounds, "_range", "left")
    return cut.withColumn("_range", F.col("_range") * (2 * FAN_OUT) + F.when(F.col("_bounds").isNull(), 0).otherwise(_reached(F.col("_bounds")))).drop("_bounds")


def shard_by_size(
    df: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    order_col: str | None = None,
    order: DataFrame | None = None,
    ranges_per_shard: int = 16,
    rows_per_range: int = 500_000,
    draws_per_range: int = 20,
) -> DataFrame:
    """Deal every row of ``df`` into ``n_shards`` shards of near equal bytes.

    Key order: ``order_col`` if given (a number), or the place that ``order``
    (rows of id and place) has for the id, else a hash of the text; then the
    id. So equal texts stand together where no order is given. First there are
    ``n_shards * ranges_per_shard`` ranges (at most FAN_OUT); a range of over
    ``rows_per_range`` rows is subdivided. Boundaries come from
    ``draws_per_range`` keys a range, drawn with a chance in proportion to
    size; they are tables, never gathered on the driver. The shard of a record
    is the shard that holds the middle of its bytes in key order; so any shard
    is within one record of total / n_shards.

    Returns id, size (UTF-8 bytes + 8), text_crc32, shard and slot (gapless
    from 0 within the shard, in key order). Null texts count 0 bytes, long
    texts whole; null ids and repeated rows are kept, one result each; ties
    are broken by a fixed salt. An empty input gives an empty result.
    """
    kinds = dict(df.dtypes)
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("_size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("bigint").alias("_crc"),
        (_as_key(F.col(order_col), kinds[order_col]) if order_col else F.xxhash64(text)).alias("_k1"),
        _as_key(F.col(id_col), kinds[id_col]).alias("_k2"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_k3"),
    )
    if order is not None:
        placed = order.toDF("_i", "_place")
        rows = rows.join(placed, F.col("_id").eqNullSafe(F.col("_i")), "left").withColumn("_k1", _as_key(F.col("_place"), dict(order.dtypes)[order.columns[1]])).drop("_i", "_place")
    keys = stage(rows.withColumn("_range", F.lit(0).cast("bigint")), "shard-keys")

    # The whole is one overfull range; then as often as it takes.
    sums = [F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")]
    pieces = F.lit(min(FAN_OUT, n_shards * ranges_per_shard))
    level = 0
    while True:
        held = keys.groupBy("_range").agg(*sums)
        full = stage(held.where(F.lit(level == 0) | (F.col("_rows") > rows_per_range)).select("_range", "_bytes", pieces.cast("int").alias("_pieces")), "shard-full")
        if level == 5 or full.isEmpty():
            break
        # At the first two levels there are at most FAN_OUT ranges to cut, of at most FAN_OUT bounds each.
        after = stage(_subdivided(keys, full, draws_per_range, bounded=level < 2), "shard-ranges")
        unstage(keys)
        keys, level = after, level + 1
        pieces = F.least(F.lit(FAN_OUT), F.ceil(2 * F.col("_rows") / rows_per_range))

    # Bytes and rows before each range: within its first-level range, and before that.
    first = F.expr(f"_range div {(2 * FAN_OUT) ** max(0, level - 1)}")
    held = stage(keys.groupBy("_range").agg(*sums).withColumn("_top", first), "shard-held")
    until = Window.unboundedPreceding, -1
    within = Window.partitionBy("_top").orderBy("_range").rowsBetween(*until)
    over = Window.orderBy("_top").rowsBetween(*until)  # at most FAN_OUT rows
    tops = held.groupBy("_top").agg(F.sum("_bytes").alias("_b"), F.sum("_rows").alias("_r"))
    tops = tops.select("_top", F.coalesce(F.sum("_b").over(over), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_r").over(over), F.lit(0)).alias("_r0"))
    held = held.join(F.broadcast(tops), "_top").select(
        "_range",
        (F.col("_b0") + F.coalesce(F.sum("_bytes").over(within), F.lit(0))).alias("_bytes0"),
        (F.col("_r0") + F.coalesce(F.sum("_rows").over(within), F.lit(0))).alias("_rows0"),
    )
    inside = Window.partitionBy("_range").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, 0)
    placed = keys.withColumn("_cum", F.sum("_size").over(inside)).withColumn("_nth", F.count(F.lit(1)).over(inside)).join(held, "_range")
    total = keys.agg(F.sum("_size")).first()[0] or 1
    middle = F.col("_bytes0") + F.col("_cum") - F.col("_size") / 2
    placed = placed.select(
        "_id",
        "_size",
        "_crc",
        F.least(F.floor(middle * n_shards / F.lit(total)), F.lit(n_shards - 1)).cast("int").alias("_shard"),
        (F.col("_rows0") + F.col("_nth") - 1).alias("_rank"),
    )
    placed = stage(placed, "shard-ranks")
    unstage(keys)
    first = placed.groupBy("_shard").agg(F.min("_rank").alias("_first"))
    placed = placed.join(F.broadcast(first), "_shard")  # n_shards rows
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (F.col("_rank") - F.col("_first")).cast("bigint").alias("slot"),
    )
