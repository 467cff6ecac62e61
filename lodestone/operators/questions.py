"""Questions generated from graph patterns: all candidates, with their answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import neighbours
from lodestone.plans.staging import stage


def fill(template: Column, **values: Column) -> Column:
    """The template with each ``{name}`` replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def entity_names(canonical: Column, synonyms: Column, mentioned: Column | None = None) -> Column:
    """Canonical name, synonyms and names as mentioned, each once."""
    lists = [F.array(canonical), F.coalesce(synonyms, F.array().cast("array<string>"))]
    return F.array_distinct(F.concat(*lists, *([mentioned] if mentioned is not None else [])))


#: Nodes of one side of a block that a task meets at once at most (fixed value).
NODES_A_TASK = 1 << 16
#: Parts into which nodes are dealt, edges that make another part worth its while, and edges that a part holds at most, about: blocks of pairs are met in one task each.
PARTS, EDGES_MORE, EDGES_A_PART = 16, 4096, 1 << 20
#: Pairs by shared neighbour that a task holds at once, about.
PAIRS_AT_ONCE = 1 << 20


def neighbourhood(edges: DataFrame, templates: dict[str, str] | None = None, least: int = 2) -> DataFrame:
    """Nodes with ``least`` neighbours or more under one relation: node, relation, question, answers."""
    near = neighbours(edges).groupBy("node", "relation").agg(F.array_sort(F.collect_set("neighbour")).alias("answers")).where(F.size("answers") >= least)
    if not templates:
        return near.withColumn("question", F.lit(None).cast("string"))
    known = F.create_map(*(F.lit(x) for kv in templates.items() for x in kv))
    out = near.withColumn("_t", F.try_element_at(known, F.col("relation"))).where("_t IS NOT NULL")
    return out.select("node", "relation", fill(F.col("_t"), target=F.col("node")).alias("question"), "answers")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _ordered(values: pa.Array) -> pa.Array:
    return (u := pc.unique(values)).take(pc.sort_indices(u))


def _codes(values: pa.Array, of: pa.Array) -> np.ndarray:
    return pc.index_in(values, of).to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(nodes: pa.Array, neighbours: pa.Array, ns: np.ndarray) -> bytes:
    """The edges of a part, and each node's number of neighbours: every name once, edges by node as steps between their neighbours' places, compressed."""
    names, hubs = _ordered(nodes), _ordered(neighbours)
    a, hub = _codes(nodes, names), _codes(neighbours, hubs)
    order = np.lexsort((hub, a))
    n = np.zeros(len(names), np.int32)
    n[a] = ns
    columns = [names, pa.array(n), pa.array(np.bincount(a, minlength=len(names)).astype(np.int32)), hubs, pa.array(np.diff(hub[order], prepend=0).astype(np.int32))]
    row = pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["names", "n", "edges", "hubs", "steps"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(part: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Names, their numbers of neighbours, the edges' nodes and neighbours as places, and the neighbours' names."""
    row = pa.ipc.open_stream(part).read_all()
    names, n, edges, hubs, steps = (row[c].combine_chunks().flatten() for c in ("names", "n", "edges", "hubs", "steps"))
    return names, n.to_numpy(), np.repeat(np.arange(len(names)), edges.to_numpy()), hubs, np.cumsum(steps.to_numpy(), dtype=np.int64)


def _met(rows: pa.Table, least: int, at_once: int, nodes_at_once: int) -> Iterator[pa.RecordBatch]:
    """The pairs of one block: nodes of part ``i`` with nodes of part ``j`` (the row with ``far``) that share ``least`` neighbours or more, each having others too."""
    same = rows["i"][0].as_py() == rows["j"][0].as_py()
    if not same and len(rows) < 2:
        return
    sides = [_unpacked(r["part"]) for r in sorted(rows.select(["far", "part"]).to_pylist(), key=lambda r: r["far"])]
    names, hubs = (_ordered(pa.concat_arrays([s[c] for s in sides])) for c in (0, 3))

    def placed(side: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = _codes(side[0], names)
        return at[side[2]], _codes(side[3], hubs)[side[4]], side[1][side[2]]

    a, hub_a, n_a = placed(sides[0])
    b, hub_b, n_b = (a, hub_a, n_a) if same else placed(sides[1])
    n = np.zeros(len(names), np.int64)
    n[a], n[b] = n_a, n_b
    by_hub = np.argsort(hub_b, kind="stable")
    b, sizes = b[by_hub], np.bincount(hub_b, minlength=len(hubs))
    first = np.cumsum(sizes) - sizes
    by_node = np.argsort(a, kind="stable")
    a, hub_a = a[by_node], hub_a[by_node]
    pairs, starts = np.cumsum(sizes[hub_a]), np.flatnonzero(np.diff(a, prepend=-1))
    node_bits, hub_bits = len(names).bit_length(), len(hubs).bit_length()
    at = 0
    while at < len(starts):
        # Whole nodes, until there are enough pairs: a node's pairs are at most the far side's edges.
        lo = starts[at]
        upto = max(at + 1, min(at + nodes_at_once, int(np.searchsorted(starts, np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + at_once, "right"), "right")) - 1))
        hi = starts[upto] if upto < len(starts) else len(a)
        at = upto
        x, hub, size = a[lo:hi] - a[lo], hub_a[lo:hi], sizes[hub_a[lo:hi]]
        y = b[_ranges(first[hub], size)]
        key = (((np.repeat(x, size) << node_bits) | y) << hub_bits) | np.repeat(hub, size)
        if same:
            key = key[np.repeat(x, size) + a[lo] < y]
        key.sort()
        pair = key >> hub_bits
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        k = np.diff(heads, append=len(pair))
        x, y = (pair[heads] >> node_bits) + a[lo], pair[heads] & ((1 << node_bits) - 1)
        kept = (k >= least) & (n[x] > k) & (n[y] > k)
        if not kept.any():
            continue
        x, y, heads, k = x[kept], y[kept], heads[kept], k[kept]
        shared = hubs.take(pa.array(key[_ranges(heads, k)] & ((1 << hub_bits) - 1)))
        answers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), shared)
        relation = pa.array([rows["relation"][0].as_py()]).take(pa.array(np.zeros(len(x), np.int64)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(np.minimum(x, y))), names.take(pa.array(np.maximum(x, y))), relation, answers], ["node_a", "node_b", "relation", "answers"])


def intersection(edges: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of nodes that share ``least`` neighbours under one relation, each having others too: node_a < node_b, relation, answers.

    The nodes of a relation are dealt to parts, whose edges are packed. Each
    pair of parts is a block, to which go both; its task meets them some nodes
    at a time, so that pairs by shared neighbour are never rows.
    """
    near = neighbours(edges).distinct()
    size = near.groupBy("node", "relation").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") > least)
    near = near.join(size, ["node", "relation"])
    held = near.groupBy("relation", "neighbour").agg(F.count(F.lit(1)).alias("_held")).where("_held > 1")
    near = stage(near.join(held, ["relation", "neighbour"]), "near")
    parts = F.greatest(F.least(F.lit(PARTS), F.ceil(F.count(F.lit(1)) / EDGES_MORE)), F.ceil(F.count(F.lit(1)) / EDGES_A_PART)).cast("int")
    near = near.join(F.broadcast(near.groupBy("relation").agg(parts.alias("_parts"))), "relation")  # one row per relation of the schema
    dealt = near.select("relation", F.pmod(F.xxhash64("node"), "_parts").cast("int").alias("_p"), "_parts", "node", "neighbour", "n")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        first = t.slice(0, 1)
        part = _packed(t["node"].combine_chunks(), t["neighbour"].combine_chunks(), t["n"].to_numpy())
        yield pa.RecordBatch.from_arrays([first[c].combine_chunks() for c in ("relation", "_p", "_parts")] + [pa.array([part], pa.binary())], ["relation", "_p", "_parts", "part"])

    # A part is packed once; its copies for the blocks are a few bytes an edge.
    packed = stage(dealt.groupBy("relation", "_p").applyInArrow(pack, "relation string, _p int, _parts int, part binary"), "parts")
    other = packed.select("relation", "_p", "part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_o"))
    blocks = other.select("relation", F.least("_p", "_o").alias("i"), F.greatest("_p", "_o").alias("j"), (F.col("_p") > F.col("_o")).alias("far"), "part")
    at_once, nodes_at_once = PAIRS_AT_ONCE, NODES_A_TASK

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _met(pa.Table.from_batches(batches), least, at_once, nodes_at_once)

    kind = near.schema["node"].dataType.simpleString()
    return blocks.groupBy("relation", "i", "j").applyInArrow(meet, f"node_a {kind}, node_b {kind}, relation string, answers array<{kind}>")


def two_hop(edges: DataFrame, least: int = 2) -> DataFrame:
    """Nodes from which one relation and then another one leads to ``least`` ends or more: node, relation1, relation2, answers."""
    near = neighbours(edges)
    a = near.select("node", F.col("relation").alias("relation1"), F.col("neighbour").alias("_m"))
    b = near.select(F.col("node").alias("_m"), F.col("relation").alias("relation2"), F.col("neighbour").alias("_e"))
    plain = lambda c: F.replace(F.col(c), F.lit("#inverse"), F.lit(""))
    ends = a.join(b, "_m").where(plain("relation1") != plain("relation2"))
    return ends.groupBy("node", "relation1", "relation2").agg(F.array_sort(F.collect_set("_e")).alias("answers")).where(F.size("answers") >= least)


def sampled(questions: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """``n`` questions in a seeded order."""
    return questions.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *keys)), *keys).limit(n)
