"""Removal of repeated byte strings with suffix arrays by difference cover.

A byte goes if it is covered by a string of ``length`` bytes that also starts
earlier in the corpus. The decision is made on suffix arrays that the
difference-cover algorithm builds: sort the triples at positions not divisible
by 3, recurse on their names, merge the remaining suffixes, and compare
adjacent suffixes on their first ``length`` bytes.

A suffix array of the whole corpus would move tens of times its size through
the shuffles. So positions are first brought together by content: every
window of ``length`` bytes is filed under its anchor, the 32-byte gram of
smallest hash in it. Equal windows have equal anchors, and neighbouring
windows mostly share theirs, so a file holds segments (runs of windows) and
there are few anchors a text. Anchors that occur once are done; of equal
segments all but the first go whole; only the different segments of an anchor
need suffix arrays. They are sorted anchor by anchor, in chunks of bounded
size. Anchors with more segments than a chunk holds are settled window by
window, by 128-bit hashes in an ordinary aggregation, which no hot anchor can
overload. Before the sort, a segment goes whose text around the anchor, on the
side that its windows need, no other segment of the anchor shares. Nothing is
sampled or dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrow import slices
from lodestone.plans.staging import stage, unstage

GRAM = 32
#: Bytes of text hashed at a time (numpy arrays of eight times that stay in the cache).
HASH_BYTES = 1 << 18
#: Bytes of segments that one suffix array is built over, and the segments of an anchor up to which it is used.
CHUNK_BYTES, MOST_SEGMENTS = 1 << 20, 4096


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The sorted suffixes of a sequence of whole numbers, by the difference cover modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.uint64)
    t[:n] = np.unique(text, return_inverse=True)[1] + 1
    bits = np.uint64(int(t.max()).bit_length())
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + (n % 3 == 2), 3)
    one = one[one < n + (n % 3 == 1)]
    two = two[two < n]
    cover = np.concatenate([one, two])
    if 3 * int(bits) <= 64:
        triple = (t[cover] << (bits * np.uint64(2))) | (t[cover + 1] << bits) | t[cover + 2]
        names = np.unique(triple, return_inverse=True)[1]
    else:
        pair = np.unique((t[cover] << bits) | t[cover + 1], return_inverse=True)[1].astype(np.uint64)
        names = np.unique((pair << bits) | t[cover + 2], return_inverse=True)[1]
    if names.max() + 1 < len(names):
        order = suffix_array(names)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
    else:
        rank = names
        order = np.argsort(names, kind="stable")
    ranks = np.zeros(n + 4, np.uint64)
    ranks[cover] = rank + 1
    rbits = np.uint64(int(len(names) + 1).bit_length())

    # The rest, by first number and the rank of what follows it.
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((t[zero] << rbits) | ranks[zero + 1], kind="stable")]
    sampled = cover[order]
    sampled = sampled[sampled < n]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    by_one = lambda i: (t[i] << rbits) | ranks[i + 1]
    pairs = np.unique(np.concatenate([(t[i] << bits) | t[i + 1] for i in (zero, twos)]), return_inverse=True)[1].astype(np.uint64)
    by_two_zero = (pairs[: len(zero)] << rbits) | ranks[zero + 2]
    by_two_twos = (pairs[len(zero) :] << rbits) | ranks[twos + 2]
    out = np.empty(n, np.int64)
    out[np.arange(len(zero)) + np.searchsorted(by_one(ones), by_one(zero)) + np.searchsorted(by_two_twos, by_two_zero)] = zero
    place = np.empty(len(sampled), np.int64)
    place[sampled % 3 == 1] = np.searchsorted(by_one(zero), by_one(ones))
    place[sampled % 3 == 2] = np.searchsorted(by_two_zero, by_two_twos)
    out[np.arange(len(sampled)) + place] = sampled
    return out


def repeated_windows(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, its windows of ``length`` bytes (by offset) that also start earlier (doc, start) in some segment."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    seg = np.repeat(np.arange(len(parts)), sizes)
    sa = suffix_array(data)
    sa = sa[sa + length <= (begin + sizes)[seg[sa]]]
    same = np.zeros(len(sa), bool)
    wide = np.lib.stride_tricks.sliding_window_view(data, length)
    for a in range(1, len(sa), 1 << 16):
        x = sa[a - 1 : a + (1 << 16)]
        same[a : a + len(x) - 1] = (wide[x[1:]] == wide[x[:-1]]).all(1)
    group = np.cumsum(~same)
    d, p = doc[seg[sa]], start[seg[sa]] + sa - begin[seg[sa]]
    order = np.lexsort((p, d, group))
    lead = np.concatenate([[True], np.diff(group[order]) > 0])
    first = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    later = (d[order] != d[first]) | (p[order] != p[first])
    hits = np.sort(sa[order[later]])
    at = np.searchsorted(hits, np.append(begin, len(data)))
    return [hits[at[k] : at[k + 1]] - begin[k] for k in range(len(parts))]


def runs(offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that windows at these sorted offsets cover, as (start, end) runs."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > length)
    return list(zip(offsets[np.append(0, cut + 1)].tolist(), (offsets[np.append(cut, len(offsets) - 1)] + length).tolist(), strict=True))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes: the 8-byte words at all places, mixed and joined twice over."""
    raw = data.tobytes()
    n = len(raw) - 7
    h = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        h[o::8] = np.frombuffer(raw, "<u8", count=(n - o + 7) // 8, offset=o)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    size = 8
    while size < GRAM:
        a, b = h[:-size] * np.uint64(0xBF58476D1CE4E5B9 + 2 * size), h[size:]
        h = a + (b ^ (b >> np.uint64(29)))
        size *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, place of the anchor, hash of its gram.

    ``data``: some texts one after another, ending at ``ends``. The anchor of
    a window is the leftmost of its grams with the smallest hash.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data)
    span = length - GRAM + 1
    low, size = h, 1
    while size < span:
        hop = min(size, span - size)
        low, size = np.minimum(low[:-hop], low[hop:]), size + hop
    begins = np.append(0, ends[:-1])
    limit = np.repeat(ends, ends - begins)[: len(low)]
    s = np.flatnonzero(np.arange(len(low)) + length <= limit)
    if not len(s):
        return none, none, none, none.astype(np.uint64)

    # Runs of windows with one smallest hash; the anchor is where the first window has it.
    cut = np.flatnonzero((np.diff(low[s]) != 0) | (np.diff(s) != 1))
    first, last = s[np.append(0, cut + 1)], s[np.append(cut, len(s) - 1)]
    anchor = first + (np.lib.stride_tricks.sliding_window_view(h, span)[first] == low[first][:, None]).argmax(1)
    odd = np.flatnonzero(anchor < last)
    if len(odd):
        # The hash occurs again: later windows of the run have a later anchor.
        parts = [(first, last, anchor)]
        keep = np.ones(len(first), bool)
        keep[odd] = False
        for k in odd.tolist():
            x, y = int(first[k]), int(last[k])
            at = x + np.flatnonzero(h[x : y + span] == low[x])
            own = at[np.searchsorted(at, np.arange(x, y + 1))]
            turn = np.flatnonzero(np.diff(own))
            parts.append((x + np.append(0, turn + 1), x + np.append(turn, y - x), own[np.append(0, turn + 1)]))
        parts[0] = (first[keep], last[keep], anchor[keep])
        first, last, anchor = (np.concatenate(c) for c in zip(*parts, strict=True))
    return first, last, anchor, h[anchor]


def _bytes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    texts = pc.fill_null(part.column("_text"), "").cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.frombuffer(b"".join(texts.to_pylist()), np.uint8), ends, texts


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """Every segment: anchor hash, 128-bit fingerprint, document (id and text), first window and number of windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", HASH_BYTES):
                data, ends, _ = _bytes(part)
                first, last, anchor, key = segments(data, ends, length)
                raw = data.tobytes()
                prints = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)])
                both = np.frombuffer(prints, np.int64).reshape(-1, 2)
                row = np.searchsorted(ends, first, side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(both[:, 0]),
                        pa.array(both[:, 1]),
                        part.column("_id").take(pa.array(row)),
                        part.column("_t").take(pa.array(row)),
                        pa.array((first - np.append(0, ends)[row]).astype(np.int32)),
                        pa.array((last - first + 1).astype(np.int32)),
                        pa.array((anchor - first).astype(np.int32)),
                    ],
                    names=["key", "f1", "f2", "_id", "_t", "s", "n", "o"],
                )

    return rows.mapInArrow(emit, "key bigint, f1 bigint, f2 bigint, _id bigint, _t bigint, s int, n int, o int")


def _same(side: DataFrame) -> tuple[DataFrame, Column]:
    """A table by document, and the condition that joins it to the rows (a null id is one)."""
    return side.withColumnsRenamed({"_id": "_i", "_t": "_u"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_u"))


def _cut_out(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of segments (key, _id, _t, s, n, o)."""
    lists = wanted.groupBy("_id", "_t").agg(F.collect_list(F.struct("key", "s", "n", "o")).alias("_w"))
    joined = rows.join(*_same(lists)).select("_id", "_t", "_text", "_w")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                out, row = [], []
                texts = _bytes(part)[2].to_pylist()
                for i, asked in enumerate(part.column("_w").to_pylist()):
                    for x in asked:
                        piece = texts[i][x["s"] : x["s"] + x["n"] + length - 1]
                        if len(piece) == x["n"] + length - 1:
                            out.append((x["key"], x["s"], piece, x["o"]))
                            row.append(i)
                key, s, piece, o = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), *(part.column(c).take(pa.array(row, pa.int64())) for c in ("_id", "_t")), pa.array(s, pa.int32()), pa.array(piece, pa.binary()), pa.array(o, pa.int32())],
                    names=["key", "_id", "_t", "s", "piece", "o"],
                )

    return joined.mapInArrow(emit, "key bigint, _id bigint, _t bigint, s int, piece binary, o int")


def worth_sorting(group: list[tuple], length: int) -> list[tuple]:
    """The segments (key, _id, _t, s, piece, o) of one anchor that may share a window with another.

    A window with the anchor in its left half holds the text from the anchor
    on for ``length - half`` bytes, any other window the text before it; equal
    windows have it equal.
    """
    half = (length - GRAM) // 2
    sides = []
    seen: dict[bytes | tuple, int] = {}
    for *_, piece, o in group:
        mine = []
        if len(piece) - length >= o - half:
            mine.append(piece[o : o + length - half])
        if o > half:
            mine.append((piece[o - half - 1 : o + GRAM],))
        for x in mine:
            seen[x] = seen.get(x, 0) + 1
        sides.append(mine)
    return [r for r, mine in zip(group, sides, strict=True) if any(seen[x] > 1 for x in mine)]


def _by_suffix_arrays(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated runs of bytes (_id, _t, a, b) in segments that are filed under the same anchors."""

    def settle(rows: list[tuple]) -> list[tuple[int | None, int, int, int]]:
        docs = [(r[1] is not None, r[1], r[2]) for r in rows]
        place = {d: k for k, d in enumerate(sorted(set(docs), key=lambda d: (d[0], d[1] or 0, d[2])))}
        start = np.array([r[3] for r in rows], np.int64)
        found = repeated_windows([r[4] for r in rows], np.array([place[d] for d in docs], np.int64), start, length)
        return [(r[1], r[2], r[3] + a, r[3] + b) for r, x in zip(rows, found, strict=True) for a, b in runs(x, length)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list[tuple]) -> pa.RecordBatch:
            got = settle(rows)
            i, t, a, b = zip(*got, strict=True) if got else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["_id", "_t", "a", "b"])

        held: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and r[0] != group[0][0]:
                    found = worth_sorting(group, length)
                    held += found
                    size += sum(len(x[4]) for x in found)
                    group = []
                    if size >= CHUNK_BYTES:
                        yield give(held)
                        held, size = [], 0
                group.append(r)
        held += worth_sorting(group, length)
        if held:
            yield give(held)

    # All segments of an anchor reach one task, at most MOST_SEGMENTS of them.
    return pieces.repartition("key").sortWithinPartitions("key").select("key", "_id", "_t", "s", "piece", "o").mapInArrow(emit, "_id bigint, _t bigint, a int, b int")


def _by_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The same for segments of any number: each window by its 128-bit hash, pre-aggregated before the shuffle."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(0, batch.num_rows, 2000):
                part = batch.slice(r, 2000)
                row, at, prints = [], [], []
                for i, (s, piece) in enumerate(zip(part.column("s").to_pylist(), part.column("piece").to_pylist(), strict=True)):
                    for o in range(len(piece) - length + 1):
                        row.append(i)
                        at.append(s + o)
                        prints.append(xxhash.xxh3_128_digest(piece[o : o + length]))
                both = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *(part.column(c).take(pa.array(row, pa.int64())) for c in ("_id", "_t")), pa.array(at, pa.int32())], names=["w1", "w2", "_id", "_t", "a"])

    windows = stage(pieces.mapInArrow(emit, "w1 bigint, w2 bigint, _id bigint, _t bigint, a int"), "suffix-windows")
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("_id", "_t", "a")).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    later = windows.join(first, ["w1", "w2"]).where(~(F.col("_id").eqNullSafe(F.col("f._id")) & (F.col("_t") == F.col("f._t")) & (F.col("a") == F.col("f.a"))))
    return later.select("_id", "_t", "a", (F.col("a") + length).cast("int").alias("b"))


def remove_repeats(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text without strings of ``length`` bytes that also start earlier.

    Earlier: at a smaller id, or in the same document further left; strings
    are judged on the input, overlaps count, and none crosses documents. Ids
    are whole numbers; a null id comes before all others. Returns id, n_bytes
    (UTF-8), n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    remaining bytes) and spans (start, end). Null texts count as empty, long
    ones whole. Repeated rows stand at the same places, so they do not remove
    each other; different texts of one id, or of null ids, are documents of
    their own, in the order of a hash of the text. An empty input gives an empty
    result.
    """
    text = F.col(text_col).cast("string")
    told = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.hash(text))
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), told.cast("bigint").alias("_t"), text.alias("_text"))
    anchors = _anchors(rows, length)
    shared = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("k"), *(x(c).alias(f"{x.__name__}{c}") for x in (F.min, F.max) for c in ("f1", "f2")), F.min(F.struct("_id", "_t", "s")).alias("first"))
    shared = stage(shared.where("k > 1").select("key", F.expr("minf1 <> maxf1 OR minf2 <> maxf2").alias("mixed"), "first"), "suffix-anchors")
    hits = stage(anchors.join(shared, "key"), "suffix-hits")
    unstage(shared)

    # All segments of the anchor are equal: all but the first go whole.
    end = (F.col("s") + F.col("n") + length - 1).cast("int").alias("b")
    later = lambda c: ~(F.col("_id").eqNullSafe(F.col(c)["_id"]) & (F.col("_t") == F.col(c)["_t"]) & (F.col("s") == F.col(c)["s"]))
    plain = hits.where(~F.col("mixed") & later("first")).select("_id", "_t", F.col("s").alias("a"), end)

    # Several different segments: of each all but its first go whole, the firsts are compared.
    mixed = hits.where("mixed").select("key", "f1", "f2", "_id", "_t", "s", "n", "o")
    heads = stage(mixed.groupBy("key", "f1", "f2").agg(F.min(F.struct("_id", "_t", "s", "n", "o")).alias("r")), "suffix-heads")
    copies = mixed.join(heads, ["key", "f1", "f2"]).where(later("r")).select("_id", "_t", F.col("s").alias("a"), end)
    many = heads.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    wanted = heads.join(many, "key").select("key", "r.*", "m")
    large = stage(_cut_out(rows, wanted.where(F.col("m") > MOST_SEGMENTS), length), "suffix-large")
    small = stage(_cut_out(rows, wanted.where(F.col("m") <= MOST_SEGMENTS), length), "suffix-pieces")
    partly = stage(_by_suffix_arrays(small, length).union(_by_windows(large, length)), "suffix-runs")

    spans = plain.union(copies).union(partly).groupBy("_id", "_t").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    spans = stage(spans, "suffix-spans")
    for t in (hits, heads, small, large, partly):
        unstage(t)
    out = rows.join(*_same(spans), "left").select("_id", "_text", "_spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = _bytes(part)[2].to_pylist()
                done = []
                lists = part.column("_spans")
                flat, at = lists.flatten(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
                a_all, b_all = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for i, text in enumerate(texts):
                    a, b = a_all[at[i] : at[i + 1]], np.minimum(b_all[at[i] : at[i + 1]], len(text))
                    a, b = a[a < b], b[a < b]
                    merged, kept = [], text
                    if len(a):
                        order = np.argsort(a, kind="stable")
                        a, reach = a[order], np.maximum.accumulate(b[order])
                        cut = np.flatnonzero(a[1:] > reach[:-1])
                        merged = list(zip(a[np.append(0, cut + 1)].tolist(), reach[np.append(cut, len(a) - 1)].tolist(), strict=True))
                        ends = [0, *(x[1] for x in merged)]
                        kept = b"".join(text[e:s] for e, s in zip(ends, [*(x[0] for x in merged), len(text)], strict=True))
                    done.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in merged]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *(pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
                )

    return out.mapInArrow(finish, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>")
