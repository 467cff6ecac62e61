"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

Each source's rows are cut into blocks. In the fluid schedule all sources flow
at their weights at once; one that has run out leaves its share to the others
in their ratio. Block j of a source may run from the slot in which the fluid
schedule begins it and must run before the slot after which it ends it; the
earliest deadline among the released blocks goes first, which keeps every
source within one block of the fluid schedule at every slot.

The stream is cut into frames of slots that are scheduled independently of each
other, so no step gathers the blocks. At a frame's start the state of a valid
schedule is found from nearby: begin one frame earlier with each source's
whole fluid blocks, give what is missing to the earliest deadlines, and
schedule up to the start. No block stays open longer than a frame, so both
sides of such a state can be completed; the blocks between two states are
then put in order by earliest deadline first.
"""

from __future__ import annotations

import json
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import stage

#: Weights are whole parts of this, so that slots come out exact in decimal(38) for up to 2**40 blocks.
WHOLE = 1 << 60
#: Slots of a frame, at least, and slots whose blocks are gathered at a time.
FRAME_SLOTS, RUN_SLOTS = 2048, 1024


def exact(weights: list[float]) -> list[int]:
    """Whole parts of WHOLE in the ratio of the weights, each as near as can be."""
    if any(not w > 0 for w in weights):
        raise ValueError("target weights must be positive")
    parts = [Fraction(w) for w in weights]
    whole = sum(parts)
    return [max(1, round(x * WHOLE / whole)) for x in parts]

def quanta(weights: list[float], frame: int) -> list[int]:
    """Blocks a frame for each weight: largest remainders, at least 1 each, summing to the frame."""
    frame = max(frame, 4 * len(weights))
    if any(not w > 0 for w in weights):
        raise ValueError("target weights must be positive")
    exact = [w * frame / sum(weights) for w in weights]
    out = [max(1, int(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    i = 0
    while sum(out) < frame:
        out[order[i % len(out)]] += 1
        i += 1
    while sum(out) > frame:
        out[max(range(len(out)), key=lambda i: out[i])] -= 1
    return out




def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _slot(x: str, j: str, up: bool) -> str:
    """The slot at which the fluid schedule has given source ``x`` j blocks, rounded down or up."""
    piece = f"element_at(filter(src, p -> ({j}) * p.w <= p.n * {x}.w), 1)"
    return _let("q", piece, f"q.done + (({j}) * q.act{f' + {x}.w - 1' if up else ''}) div {x}.w")


def _open(x: str, j: str, limit: str) -> str:
    """A source's state: its next block j with release and deadline, and the block it stops before."""
    return f"named_struct('i', {x}.i, 's', {x}.s, 'n', {x}.n, 'w', {x}.w, 'j', {j}, 'r', {_slot(x, j, False)}, 'd', {_slot(x, f'least({j} + 1, {x}.n)', True)}, 'until', {limit})"


def _near(t: str) -> str:
    """The state at slot ``t`` by the fluid schedule: whole blocks, and what is missing to the earliest deadlines."""
    flow = f"(x.w * ({t} - k.done))"
    whole = f"transform(src, x -> named_struct('x', x, 'j', least(x.n, {flow} div k.act), 'part', {flow} div k.act < x.n AND {flow} % k.act > 0))"
    due = "transform(filter(whole, y -> y.part), y -> named_struct('d', " + _slot("y.x", "y.j + 1", True) + ", 's', y.x.s, 'i', y.x.i))"
    short = f"cast({t} - aggregate(whole, 0L, (a, y) -> a + y.j) as int)"
    ahead = f"transform(slice(array_sort({due}), 1, {short}), v -> v.i)"
    state = _let("ahead", ahead, "transform(whole, y -> " + _let("g", "named_struct('x', y.x, 'j', y.j + if(array_contains(ahead, y.x.i), 1L, 0L))", _open("g.x", "g.j", "g.x.n")) + ")")
    return _let("k", f"coalesce(element_at(filter(src, p -> ({t} - p.done) * p.w <= p.act * p.n), 1), element_at(src, -1))", _let("whole", whole, state))


#: The released block of earliest deadline in a state at slot t, and the state after it.
_FIRST = "array_min(transform(filter(st, x -> x.r <= t AND x.j < x.until), x -> named_struct('d', x.d, 's', x.s, 'i', x.i)))"
_AFTER = f"transform(st, x -> if(x.i = c.i, {_open('x', 'x.j + 1', 'x.until')}, x))"


def _run(state: str, begin: str, end: str) -> str:
    """The state after the slots from ``begin`` to ``end``."""
    return f"if({begin} < {end}, aggregate(sequence({begin}, {end} - 1), {state}, (st, t) -> {_let('c', _FIRST, _AFTER)}), {state})"


def _gathered(state: str, begin: str, end: str) -> str:
    """The blocks (source, block) of the slots in runs, with a step for a run so that lists stay short."""
    take = _let("c", _FIRST.replace("st,", "acc.st,"), "named_struct('st', " + _AFTER.replace("transform(st,", "transform(acc.st,") + ", 'out', concat(acc.out, array(named_struct('s', c.s, 'block', element_at(acc.st, c.i + 1).j))))")
    none = "cast(array() as array<struct<s: int, block: bigint>>)"
    run = f"aggregate(sequence(at, least(at + {RUN_SLOTS}, {end}) - 1), named_struct('st', whole.st, 'out', {none}), (acc, t) -> {take})"
    step = _let("done", run, "named_struct('st', done.st, 'runs', concat(whole.runs, array(done.out)))")
    begins = f"sequence({begin}, {end} - 1, {RUN_SLOTS}L)"
    return f"aggregate({begins}, named_struct('st', {state}, 'runs', cast(array() as array<array<struct<s: int, block: bigint>>>)), (whole, at) -> {step}, whole -> whole.runs)"


def block_slots(spark: SparkSession, weights: list[int], blocks: list[int], frame_slots: int = FRAME_SLOTS) -> DataFrame:
    """The slot of every block of every source: s, block, slot.

    ``weights`` are whole numbers of at most WHOLE in all, ``blocks`` how many
    blocks each source has (1 at least). A row a frame, all frames at once.
    """
    order = sorted(range(len(blocks)), key=lambda i: (Fraction(blocks[i], weights[i]), i))
    done, active, src = 0, sum(weights), []
    frame = max(frame_slots, 2 + -(-active // min(weights)))
    for k, i in enumerate(order):
        wide = "cast({} as decimal(20, 0))".format
        src.append(f"named_struct('i', {k}, 's', {i}, 'n', {blocks[i]}L, 'w', {wide(weights[i])}, 'done', {done}L, 'act', {wide(active)})")
        done, active = done + blocks[i], active - weights[i]
    slots = done
    frame = min(frame, slots)
    frames = -(-slots // frame)
    parts = min(frames, max(spark.sparkContext.defaultParallelism, frames // 256))
    rows = spark.range(0, frames, 1, parts).select(F.col("id").alias("f"), F.expr(f"array({', '.join(src)})").alias("src"))
    rows = rows.withColumn("b", F.col("f") * frame).withColumn("e", F.least(F.lit(slots), (F.col("f") + 1) * frame))
    rows = rows.withColumn("held", F.expr(_run(_near(f"greatest(0L, b - {frame})"), f"greatest(0L, b - {frame})", "b")))
    rows = rows.withColumn("next", F.expr(_run(_near("b"), "b", "e")))
    limited = "transform(held, x -> named_struct('i', x.i, 's', x.s, 'n', x.n, 'w', x.w, 'j', x.j, 'r', x.r, 'd', x.d, 'until', element_at(next, x.i + 1).j))"
    rows = rows.withColumn("limited", F.expr(limited)).withColumn("runs", F.expr(_gathered("limited", "b", "e")))
    runs = rows.select("b", F.posexplode("runs").alias("k", "run")).select((F.col("b") + F.col("k") * RUN_SLOTS).alias("b"), F.posexplode("run").alias("k", "x"))
    return runs.select("x.s", "x.block", (F.col("b") + F.col("k")).alias("slot"))

def repeated_slots(spark: SparkSession, quota: list[int], blocks: list[int]) -> DataFrame:
    """The slot of every block (s, block, slot) where one frame of quota blocks is repeated; slots of sources that have run out are left out."""
    once = block_slots(spark, quota, quota)
    own, left = F.get(F.lit(quota), F.col("s")), F.get(F.lit(blocks), F.col("s")) - 1 - F.col("block")
    rows = once.where(left >= 0).select("s", "block", "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(left / own))).alias("f"))
    rows = rows.select("s", (F.col("f") * own + F.col("block")).alias("block"), "f", F.row_number().over(Window.partitionBy("f").orderBy("slot")).alias("nth"))
    # Blocks of the frames before: within a run of frames, and before that.
    until = Window.unboundedPreceding, -1
    held = rows.groupBy("f", F.expr(f"f div {RUN_SLOTS}").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    runs = held.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(*until)), F.lit(0)).alias("b0"))
    held = held.join(runs, "run").select("f", (F.col("b0") + F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("f").rowsBetween(*until)), F.lit(0))).alias("b0"))
    return rows.join(held, "f").select("s", "block", (F.col("b0") + F.col("nth") - 1).alias("slot"))


def mix_sources(
    df: DataFrame,
    weights: dict[str | None, float] | None = None,
    power: float = 0.5,
    block_rows: int = 32,
    frame: int | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    bucket_rows: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """Give every row its place in a stream that follows the target weights.

    ``weights`` maps sources to target weights (any missing source is an
    error); without it a source's weight is its row count to the ``power``.
    The weights are followed to a part in WHOLE; where a ``frame`` is given they
    are rounded to whole blocks a frame, and one frame is repeated.
    Rows of one source come in a seeded pseudo-random order, ``block_rows`` to
    a block. When a source runs out, its slots fall away and the others keep
    their ratio; no row is dropped or repeated.

    Returns id, source, block (of the source, from 0), in_block and position
    (0 to rows - 1, each once). A null source is a source of its own; null ids
    and repeated rows are kept; an empty input gives an empty result. The
    driver holds a few numbers a source, nothing a block. Texts are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"))
    rows = stage(rows.withColumn("_h", F.xxhash64(F.lit(seed), "_id", "_source")), "mix-rows")
    counts = sorted(((r[0], r[1]) for r in rows.groupBy("_source").count().collect()), key=lambda r: (r[0] is not None, r[0]))
    if not counts:
        return rows.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), *(F.lit(0).cast("bigint").alias(c) for c in ("block", "in_block", "position")))
    names, sizes = [c[0] for c in counts], [c[1] for c in counts]
    target = [weights[n] for n in names] if weights else [s**power for s in sizes]
    shares = quanta(target, frame) if frame else exact(target)

    def local(values: list[dict], schema: str) -> DataFrame:
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")))

    sources = local([{"name": n, "s": i} for i, n in enumerate(names)], "name:string,s:int")
    rows = rows.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("name"))).drop("name")  # what the driver holds already

    # Ranks within a source: many hash buckets, prefix sums over their counts.
    buckets = max(512, -(-sum(sizes) // bucket_rows))
    rows = rows.withColumn("_bucket", F.pmod(F.shiftright("_h", 20), F.lit(buckets)))
    held = rows.groupBy("s", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("s", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("s", "_bucket").orderBy("_h", "_id"))
    rows = rows.withColumn("_nth", nth).join(held, ["s", "_bucket"])
    rows = rows.withColumn("_i", F.col("_before") + F.col("_nth") - 1)
    rows = rows.withColumn("block", F.expr(f"_i div {block_rows}"))

    blocks = [-(-n // block_rows) for n in sizes]
    slots = stage(repeated_slots(spark, shares, blocks) if frame else block_slots(spark, shares, blocks), "mix-slots")
    # A source's last block may be short; what it lacks moves up all that follows. One row a source.
    short = [k * block_rows - n for k, n in zip(blocks, sizes, strict=True)]
    last = slots.where(F.col("block") == F.get(F.lit(blocks), F.col("s")) - 1).collect()
    gaps = [{"slot": r["slot"], "n": short[r["s"]]} for r in last if short[r["s"]]]
    lacking = F.aggregate(F.from_json(F.lit(json.dumps(gaps)), "array<struct<slot:bigint,n:bigint>>"), F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["slot"] < F.col("slot"), x["n"]).otherwise(0))
    places = slots.select("s", "block", (F.col("slot") * block_rows - lacking).alias("_start"))
    rows = rows.join(places, ["s", "block"])
    in_block = F.expr(f"_i % {block_rows}")
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("block").cast("bigint").alias("block"),
        in_block.cast("bigint").alias("in_block"),
        (F.col("_start") + in_block).cast("bigint").alias("position"),
    )
