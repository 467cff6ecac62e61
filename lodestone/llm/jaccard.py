"""Components of an n-gram Jaccard join by vertical partitioning.

The n-grams of all documents stand in one global order, the rarest first (by
the number of different sets that hold them, then by hash). It is found in
fragments: every set is cut along the hash range, the parts of one fragment
meet in one task, which counts each n-gram. N-grams of one set only stand at
the order's beginning and can be common to nobody; most sets have too many of
them to reach the threshold with any partner and are done.

The order of the rest is cut into fragments again. A candidate pair must share
an n-gram of both sets' first n - ceil(t n) + 1; its partial overlaps are
counted fragment by fragment (rows keyed by pair and fragment) and summed per
pair. Only connectivity is asked for, so identical sets are one class, each
class is first held against one likely partner (of the sets that share an
early n-gram the one with the fewest n-grams of its own), and after that only
pairs whose ends are not connected yet are formed. No pair is dropped: pairs
are skipped where their ends are known to be connected or where a bound (set
size, place in the order, overlap with a common partner) proves them below
the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrow import Words, shingle_sets, slices, string_column
from lodestone.operators.components import connected_components
from lodestone.plans.staging import stage, unstage

#: Bytes of text whose n-grams one fragment of the hash range takes, and the least number of fragments.
FRAGMENT_BYTES, FRAGMENTS = 16 << 20, 32
#: Frequencies at which the global order is cut for counting.
CUTS = (4, 16, 128)
#: N-grams of so many sets are equally frequent; a task holds about MOST_HELD places before it hands those on.
FREQUENT, MOST_HELD = 1 << 16, 12_000_000
#: Rows that meet under one key of a salted join, about.
SALT_ROWS = 256
#: Places in the order up to which a row carries what stands before it.
CARRIED = 64

_HEAD = np.dtype([("f1", "<i8"), ("f2", "<i8"), ("n", "<i4"), ("k", "<i4")])
_COUNTED = "_id bigint, n bigint, f1 bigint, f2 bigint, g bigint, df int"


def _spread(rows: DataFrame, size: int, fragments: int) -> DataFrame:
    """Each row's set size and 128-bit fingerprint, and the parts of the different sets by fragment of the hash range.

    A row has either the former (frag spreads the rows) or, for a fragment,
    the heads of some sets (_HEAD, k: n-grams here) and their n-grams.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["frag", "_id", "n", "f1", "f2", "heads", "grams"]
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(Words(string_column(part, "_text"), lower=True), size)
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                both, ids = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2), part.column("_id")
                sizes, k = np.fromiter(map(len, sets), np.int64, len(sets)), len(sets)
                at = (both[:, 0].view(np.uint64) % np.uint64(fragments)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), ids, pa.array(sizes), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)
                real = ids.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
                own = list({p: i for i, p in enumerate(prints) if real[i]}.values())  # copies in the slice count once
                if not own:
                    continue
                flat = np.concatenate([sets[i] for i in own])
                frag = ((flat >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
                cell, begin, count = np.unique(frag * len(own) + np.repeat(np.arange(len(own)), sizes[own]), return_index=True, return_counts=True)
                order = np.argsort(frag, kind="stable")
                flat, stop = flat[order], np.cumsum(count)
                heads = np.zeros(len(cell), _HEAD)
                who = np.array(own)[cell % len(own)]
                heads["f1"], heads["f2"], heads["n"], heads["k"] = both[who, 0], both[who, 1], sizes[who], count
                edge = np.flatnonzero(np.diff(cell // len(own), prepend=-1, append=-1))
                spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                k = len(spans)
                longs = [pa.nulls(k, pa.int64())] * 4
                blobs = [pa.array([heads[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([flat[stop[a] - count[a] : stop[b - 1]].tobytes() for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array((cell[edge[:-1]] // len(own)).astype(np.int32)), *longs, *blobs], names=names)

    return rows.mapInArrow(emit, "frag int, _id bigint, n bigint, f1 bigint, f2 bigint, heads binary, grams binary")


def _once(heads: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of different sets, each once."""
    order = np.lexsort((heads["f2"], heads["f1"]))
    x = heads[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x["f1"][1:] != x["f1"][:-1]) | (x["f2"][1:] != x["f2"][:-1])
    keep = np.zeros(len(x), bool)
    keep[order[fresh]] = True
    return heads[keep], grams[np.repeat(keep, heads["k"])]


def _counted(spread: DataFrame, fragments: int) -> DataFrame:
    """The facts of ``spread`` passed on (df null), and (set, n-gram, df) for every n-gram that several sets hold."""

    def rows_of(heads: np.ndarray, seg: np.ndarray, grams: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(seg), 1 << 18):
            s = slice(a, a + (1 << 18))
            h = heads[seg[s]]
            cols = [pa.nulls(len(h), pa.int64()), pa.array(h["n"].astype(np.int64)), pa.array(h["f1"].copy()), pa.array(h["f2"].copy()), pa.array(grams[s].view(np.int64)), pa.array(df[s].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "n", "f1", "f2", "g", "df"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, grams, frequent = [np.zeros(0, _HEAD)], [np.zeros(0, np.uint64)], np.zeros(0, np.uint64)
        held, limit = 0, MOST_HELD

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal frequent, held, limit
            h, g = _once(np.concatenate(heads), np.concatenate(grams))
            heads.clear(), grams.clear()
            order = np.argsort(g, kind="stable")
            ranked = g[order]
            edge = np.append(0, np.flatnonzero(ranked[1:] != ranked[:-1]) + 1) if len(g) else np.zeros(0, np.int64)
            del ranked
            count = np.diff(edge, append=len(g))
            df = np.empty(len(g), np.int32)
            df[order] = np.repeat(np.minimum(count, FREQUENT).astype(np.int32), count)
            del order, edge, count
            if len(frequent):
                df[np.isin(g, frequent)] = FREQUENT
            seg = np.repeat(np.arange(len(h), dtype=np.int32), h["k"])
            out = df > 1 if last else df >= FREQUENT
            yield from rows_of(h, seg[out], g[out], df[out])
            if not last:
                frequent = np.union1d(frequent, g[out])
                h["k"] = np.bincount(seg[~out], minlength=len(h))
                heads.append(h[h["k"] > 0])
                grams.append(g[~out])
                held = len(grams[0])
                limit = max(MOST_HELD, 2 * held)

        for batch in batches:
            fact = batch.column("heads").is_null()
            facts = batch.filter(fact)
            k = facts.num_rows
            if k:
                yield pa.RecordBatch.from_arrays([*(facts.column(c) for c in ("_id", "n", "f1", "f2")), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], names=["_id", "n", "f1", "f2", "g", "df"])
            for x, y in zip(batch.column("heads").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                if x is not None:
                    heads.append(np.frombuffer(x, _HEAD))
                    grams.append(np.frombuffer(y, np.uint64))
                    held += len(grams[-1])
                    if held >= limit:
                        yield from settle(False)
        yield from settle(True)

    return spread.repartitionById(fragments, F.col("frag")).mapInArrow(emit, _COUNTED)


def _reachable(counted: DataFrame, percent: int, fragments: int) -> DataFrame:
    """The sets that can reach the threshold: n, u (n-grams of their own only), the shared n-grams in the global order with their df, the order's cuts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        f1, f2, n, g, df = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((g, df, f2, f1))
        f1, f2, n, g, df = f1[order], f2[order], n[order], g[order], df[order]
        fresh = np.ones(len(f1), bool)
        fresh[1:] = (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
        new = fresh.copy()
        new[1:] |= g[1:] != g[:-1]  # a set's part may have come more than once
        f1, f2, n, g, df, fresh = (x[new] for x in (f1, f2, n, g, df, fresh))
        begin = np.flatnonzero(fresh)
        count = np.diff(begin, append=len(f1))
        able = 100 * count >= percent * n[begin]
        inside = np.repeat(able, count)
        begin, count, g, df = begin[able], count[able], g[inside], df[inside]
        row = np.repeat(np.arange(len(begin)), count)
        cuts = np.stack([np.bincount(row[df < c], minlength=len(begin)) for c in CUTS], 1) if len(begin) else np.zeros((0, len(CUTS)), np.int64)
        ends = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(f1[begin]), pa.array(f2[begin]), pa.array(n[begin]), pa.array(n[begin] - count),
                pa.ListArray.from_arrays(ends, pa.array(g)), pa.ListArray.from_arrays(ends, pa.array(df)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * len(CUTS)), pa.array(cuts.ravel().astype(np.int32))),
            ],
            names=["f1", "f2", "n", "u", "grams", "dfs", "cuts"],
        )

    schema = "f1 bigint, f2 bigint, n bigint, u bigint, grams array<bigint>, dfs array<int>, cuts array<int>"
    shared = counted.where("df IS NOT NULL").select("f1", "f2", "n", "g", "df")
    sets = shared.repartition(fragments, "f1", "f2").mapInArrow(emit, schema)
    # most: the largest partner; first: how many shared n-grams the first fragment has; top: the most frequent of them.
    most = F.expr(f"least((n - u) * {100 + percent} div {percent} - n, n * 100 div {percent})")
    first = F.expr(f"cast(n - (n * {percent} + 99) div 100 + 1 - u as int)")
    sets = sets.select(F.monotonically_increasing_id().alias("k"), "*", most.alias("most"), first.alias("first"))
    return sets.withColumn("top", F.element_at("dfs", F.col("first")))


def _salts(rows: Column) -> Column:
    return F.ceil(rows / SALT_ROWS).cast("int")


def _summed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The whole overlap of pairs (a, b): partial overlaps by fragment of the order, summed per pair; n and m are the sizes.

    A much wanted ``a`` is salted by its most frequent early n-gram.
    """
    edges = F.concat(F.array(F.lit(0)), "cuts", F.array(F.size("grams")))
    part = F.transform(F.sequence(F.lit(0), F.lit(len(CUTS))), lambda i: F.slice(F.col("grams"), F.get(edges, i) + 1, F.get(edges, i + 1) - F.get(edges, i)))
    cut = sets.select("k", "n", "top", F.posexplode(part).alias("f", "part")).where(F.size("part") > 0)
    ours = cut.select(F.col("k").alias("b"), F.col("n").alias("m"), "f", F.col("part").alias("pb"))
    theirs = cut.select(F.col("k").alias("a"), "n", "f", F.col("part").alias("pa"), F.explode(F.sequence(F.lit(0), _salts(F.col("top")) - 1)).alias("salt"))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), _salts(F.col("top"))).cast("int").alias("salt"))
    both = salted.join(ours, "b").join(theirs, ["a", "salt", "f"])
    partial = both.select("a", "b", "n", "m", F.size(F.array_intersect("pa", "pb")).alias("c"))
    out = partial.groupBy("a", "b").agg(F.sum("c").alias("overlap"), F.max("n").alias("n"), F.max("m").alias("m"))
    return out.withColumn("linked", F.col("overlap") * (100 + percent) >= (F.col("n") + F.col("m")) * percent)


def _early(sets: DataFrame, *more: str) -> DataFrame:
    """The first fragment's n-grams of every set, a row each: place r among its shared ones, n-gram g, df."""
    pre = F.arrays_zip(F.slice("grams", 1, F.col("first")).alias("g"), F.slice("dfs", 1, F.col("first")).alias("df"))
    out = sets.select("k", "n", "u", "most", "top", *more, F.posexplode(pre).alias("r", "_x"))
    return out.select("k", "n", "u", "most", "top", *more, "r", F.col("_x.g").alias("g"), F.col("_x.df").alias("df"))


def _likely(sets: DataFrame) -> DataFrame:
    """For each set one partner (a, b = the set): of the sets of fewest own n-grams under its early n-grams the one it shares most of these with."""
    early = _early(sets)
    best = F.min(F.struct((F.col("u") * 1000 / F.col("n")).alias("own"), "k", "n", "most", "top"))
    hub = early.groupBy("g").agg(best.alias("h"), F.max("df").alias("df"), F.count(F.lit(1)).alias("c")).where("c > 1")
    hub = hub.select("g", "h", F.explode(F.sequence(F.lit(0), _salts(F.col("df")) - 1)).alias("salt"))
    salted = early.select("k", "n", "most", "g", F.pmod(F.xxhash64("k"), _salts(F.col("df"))).cast("int").alias("salt"))
    fits = (F.col("k") != F.col("h.k")) & (F.col("h.n") <= F.col("most")) & (F.col("n") <= F.col("h.most"))
    met = salted.join(hub, ["g", "salt"]).where(fits).groupBy(F.col("k").alias("b"), F.col("h.k").alias("a")).agg(F.count(F.lit(1)).alias("c"), F.max("h.top").alias("top"))
    return met.groupBy("b").agg(F.max_by(F.struct("a", "top"), F.struct("c", -F.col("a"))).alias("x")).select("x.a", "b", "x.top")


def _open_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) between components that no bound rules out; ``sets`` have component, anchor and its overlap.

    Under each n-gram, members of its largest component are met by the others
    only. A pair is formed at its first common n-gram (at each, where places
    lie beyond CARRIED).
    """
    before = F.when(F.col("r") <= CARRIED, F.slice(F.col("grams"), F.lit(1), F.col("r")))
    early = _early(sets, "grams", "component", "anchor", "shared").withColumn("before", before).drop("grams")
    held = early.groupBy("g", "component").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("most").alias("most"))
    held = held.groupBy("g").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("c", "component")).alias("major"), F.min("least").alias("_least"), F.max("most").alias("_most")).where("parts > 1")
    rows = early.join(held, "g").where("_least <= most AND n <= _most").drop("parts", "_least", "_most", "df")
    rows = stage(rows, "join-open")
    names = ["k", "n", "u", "most", "top", "component", "anchor", "shared", "r", "before"]
    x = rows.where("component <> major").select("g", *(F.col(c).alias(f"x_{c}") for c in names))
    y = rows.select("g", "major", *(F.col(c).alias(f"y_{c}") for c in names))
    need = f"(x_n + y_n) * {percent}"
    unlike = [
        "x_component <> y_component AND (y_component = major OR x_k < y_k)",
        "x_n <= y_most AND y_n <= x_most",
        "NOT (x_anchor <=> y_k) AND NOT (y_anchor <=> x_k)",
        # Common ones before this place, this one, and what can be common after it.
        f"(least(x_r, y_r) + 1 + least(x_n - x_u - x_r, y_n - y_u - y_r) - 1) * {100 + percent} >= {need}",
        # Both overlaps with one anchor are known; beyond it only n-grams that others hold too can be common.
        f"(x_anchor IS NULL OR NOT (x_anchor <=> y_anchor) OR (least(x_shared, y_shared) + least(x_n - x_u - x_shared, y_n - y_u - y_shared)) * {100 + percent} >= {need})",
        "NOT coalesce(arrays_overlap(x_before, y_before), false)",
    ]
    met = x.join(y, "g").where(F.expr(" AND ".join(f"({c})" for c in unlike)))
    pairs = stage(met.groupBy(F.col("x_k").alias("a"), F.col("y_k").alias("b")).agg(F.max("x_top").alias("top")), "join-pairs")
    unstage(rows)
    return pairs


def jaccard_components(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every row under links between texts of Jaccard similarity >= percent / 100.

    A text's set: the distinct ``size``-word shingles of its words (A-Z
    lower-cased, split at ASCII white space); with fewer words the whole
    sequence; without words empty, and linked with nothing. Texts of any
    length count whole. Ids are whole numbers. Returns id, n_shingles and
    component_id, the smallest id reachable by links (itself included), one
    row per input row. Rows that share an id are one node: what any of its
    texts links to is one component. A null id is no node: such a row gets the
    component of an equal set, or null. An empty input gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    volume = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    fragments = max(FRAGMENTS, -(-volume // FRAGMENT_BYTES))
    counted = stage(_counted(_spread(rows, size, fragments), fragments), "join-counted")
    docs = counted.where("df IS NULL").select("_id", "n", "f1", "f2")
    sets = stage(_reachable(counted, percent, fragments), "join-sets")

    # Each set with its likeliest partner.
    likely = stage(_likely(sets), "join-likely")
    star = stage(_summed(likely, sets, percent), "join-star")
    parts = connected_components(star.where("linked"), "a", "b")

    # What is left between components.
    known = star.select(F.col("b").alias("k"), F.col("a").alias("anchor"), F.col("overlap").alias("shared"))
    named = sets.join(parts.toDF("k", "component"), "k", "left").join(known, "k", "left").withColumn("component", F.coalesce("component", "k"))
    rest = _open_pairs(named, percent)
    more = stage(_summed(rest, sets, percent).where("linked"), "join-more")

    # From sets to ids; ids with several sets tie these together.
    classes = stage(docs.where("n > 0 AND _id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("_id").alias("rep")), "join-classes")
    keyed = stage(sets.select("k", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).select("k", "rep"), "join-reps")
    links = star.where("linked").select("a", "b").union(more.select("a", "b"))
    links = links.join(keyed.toDF("a", "src"), "a").join(keyed.toDF("b", "dst"), "b").select("src", "dst")
    held = docs.where("n > 0 AND _id IS NOT NULL").select("_id", "f1", "f2", "n").distinct()
    several = held.groupBy("_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_id")
    ties = held.join(several, "_id").join(classes, ["f1", "f2", "n"]).select(F.col("_id").alias("src"), F.col("rep").alias("dst"))
    whole = connected_components(links.union(ties))
    for t in (sets, likely, star, rest, more, keyed):
        unstage(t)

    named = classes.join(whole.toDF("rep", "component"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    full = docs.where("n > 0").join(named, ["f1", "f2", "n"], "left").select("_id", "n", "component")
    # A text without words goes with the other texts of its id.
    empty = docs.where("n = 0").select("_id", "n")
    other = held.join(empty.select("_id").distinct(), "_id").join(named, ["f1", "f2", "n"]).groupBy("_id").agg(F.min("component").alias("component"))
    out = full.union(empty.join(other, "_id", "left").select("_id", "n", F.coalesce("component", "_id")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
