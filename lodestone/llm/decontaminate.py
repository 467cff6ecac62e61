"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK random walk copies a sequence word by word and, by a random bit of
step and word, moves on or stays; sequences at small edit distance fall into
step again, so their walks agree in many places. Windows of an item's size are
embedded like the item, from both ends; a window is a candidate if it agrees
with the item in one of the sampled places (bit-sampling LSH). How many places
are sampled follows from the item's length: pairs with as many edits as are
allowed (deletions, insertions, mixed) are embedded beforehand, and the number
is raised until the one of them that agrees least is missed with a chance of at
most 1 - recall. Items of over
LONGEST words, or of lengths at which MOST_SAMPLES places are not enough, have
all their windows verified.

Windows are looked at only where they can match: within d edits of an L-word
item some run of ceil((L - d) / (d + 1)) of its words stands unchanged, and each
edit destroys at most g of its L - g + 1 runs of g words, so L - g + 1 - d g of
them stand, on diagonals (place in the document less place in the item) that
differ by at most d. This loses nothing. Candidates are verified with the exact
edit distance over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrow import Words, hash_strings, mix64, slices, string_column

SEED_WORDS = 3
#: Walks (half of them from the end back), places sampled of each at most, trials a kind of edit, and words embedded at a time.
WALKS, MOST_SAMPLES, TRIALS, EMBED_WORDS = 4, 128, 32, 1 << 21
#: Items of more words have their windows verified without LSH.
LONGEST = 512
_G = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word: white-space words, lower-cased, letters and digits only; words without any go."""
    words = Words(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(words.unique), r"[^\p{L}\p{N}]+", "")
    full = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False) if len(plain) else np.zeros(0, bool)
    h = hash_strings(plain)
    if not len(words.ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = full[words.ids]
    return h[words.ids][keep], np.asarray(words.doc, np.int64)[keep]


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    acc = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        acc = mix64(acc * _G + h[k : len(h) - size + 1 + k] + np.uint64(k + 1))
    return acc


def seed_plan(size: int, most: int) -> tuple[int, int]:
    """Words of a seed of an item, and how many of its seeds stand in any match within ``most`` edits."""
    g = min(SEED_WORDS, -(-(size - most) // (most + 1)))
    return g, max(1, size - g + 1 - most * g)


def embed(h: np.ndarray, first: np.ndarray, count: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """One CGK walk for each window of ``count`` words from ``first`` on (odd walks: from its end back): the word at each step, 0 beyond the window."""
    at = np.zeros(len(first), np.int64)
    out = np.zeros((len(first), steps), np.uint64)
    for j in range(steps):
        live = at < count
        c = np.where(live, h[np.where(live, first + (count - 1 - at if walk % 2 else at), 0)], np.uint64(0))
        out[:, j] = c
        at += live & (mix64(c + np.uint64((int(_G) * (1 + j + 100_003 * (walk // 2))) % 2**64)) >> np.uint64(63) == 1)
    return out


def _edited(rng: np.random.Generator, item: np.ndarray, edits: int, kind: str) -> list[int]:
    words, fresh = item.tolist(), iter(range(-(2**31), 0))
    for at in sorted(rng.choice(len(words), edits, replace=False).tolist(), reverse=True):
        step = kind if kind != "mixed" else ("delete", "insert", "replace")[rng.integers(3)]
        words[at : at + (step != "insert")] = [] if step == "delete" else [next(fresh) % 2**64]
    return words


def calibrated(size: int) -> int:
    """The length at which an item of ``size`` words is calibrated: up to 16 words its own, beyond the next in steps of an eighth."""
    out = 16
    while out < size:
        out += out // 8
    return out if size > 16 else size


@lru_cache(maxsize=1024)
def samples_for(size: int, similarity: float, recall: float) -> int:
    """Places a walk to sample so that of the trial pairs with all edits allowed the most different is missed with a chance of at most 1 - recall; 0 where MOST_SAMPLES is not enough."""
    rng, most = np.random.default_rng(size), int((1 - similarity) * size + 1e-9)
    g, need = seed_plan(size, most)
    items, docs, trial, first, count = [], [], [], [], []
    begin = 0
    for k in range(3 * TRIALS):
        item = rng.integers(1, 2**63, size, dtype=np.uint64)
        side = rng.integers(1, 2**63, 2 * most + 4, dtype=np.uint64)
        doc = np.concatenate([side, np.array(_edited(rng, item, most, ("delete", "insert", "mixed")[k % 3]), np.uint64), side[::-1]])
        where = dict(zip(grams(item, g).tolist(), range(size), strict=False))
        met = np.array(sorted(i - where[x] for i, x in enumerate(grams(doc, g).tolist()) if x in where), np.int64)
        full = np.maximum(0, np.unique(met[np.searchsorted(met, met + most, side="right") - np.arange(len(met)) >= need]))
        items.append(item)
        docs.append(doc)
        trial.append(np.full(len(full), k))
        first.append(begin + full)
        count.append(np.minimum(size, len(doc) - full))
        begin += len(doc)
    trial, flat = np.concatenate(trial), np.concatenate(docs)
    missed = np.zeros(3 * TRIALS)
    for w in range(WALKS):
        ones = embed(np.concatenate(items), size * np.arange(len(items)), np.full(len(items), size), w, 2 * size)[trial]
        same = ((embed(flat, np.concatenate(first), np.concatenate(count), w, 2 * size) == ones) & (ones != 0)).mean(1)
        missed += np.bincount(trial, np.log(np.maximum(1e-9, 1 - same)), len(missed))
    needed = 1
    while needed <= MOST_SAMPLES and np.exp(needed * missed.max()) > 1 - recall:
        needed *= 2
    return needed if needed <= MOST_SAMPLES else 0


class Items:
    """The benchmark items of one block, with their seeds, the sampled places of their walks and the places of each word.

    Besides the text an item takes at most 8 * WALKS * MOST_SAMPLES bytes of samples.
    """

    def __init__(self, ids: list, texts: list[str], similarity: float, recall: float):
        self.ids, self.words = [], []
        for i, t in zip(ids, texts, strict=True):
            h, _ = word_hashes(pa.array([t]))
            if len(h):
                self.ids.append(i)
                self.words.append(h)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.most = np.array([int((1 - similarity) * n + 1e-9) for n in self.size], np.int64)
        self.longest = int(self.size.max()) if len(self.size) else 0
        # Seeds by their number of words: sorted hashes, and for each the item and the place in it.
        seeds: dict[int, list] = {}
        self.need = np.ones(len(self.size), np.int64)
        for k, w in enumerate(self.words):
            g, self.need[k] = seed_plan(len(w), int(self.most[k]))
            g_hash = grams(w, g)
            seeds.setdefault(g, []).append((g_hash, np.full(len(g_hash), k), np.arange(len(g_hash))))
        self.seeds = {}
        for g, parts in seeds.items():
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.argsort(cols[0], kind="stable")
            table = np.zeros(1 << 20, bool)
            table[(cols[0] >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[g] = (*(c[order] for c in cols), table)
        self.masks = [word_masks(w.tolist()) for w in self.words]
        self.back_masks = [word_masks(w[::-1].tolist()) for w in self.words]
        # Samples of items of one length: the steps of each walk, and each item's words there.
        self.steps: dict[int, np.ndarray] = {}
        self.sampled: dict[int, np.ndarray] = {}
        self.row = np.zeros(len(self.size), np.int64)
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            self.row[own] = np.arange(len(own))
            s = samples_for(calibrated(n), similarity, recall) if n <= LONGEST else 0
            if s:
                rng = np.random.default_rng(n)
                self.steps[n] = np.stack([rng.choice(2 * n, min(s, 2 * n), replace=False) for _ in range(WALKS)])
                flat = np.concatenate([self.words[k] for k in own])
                self.sampled[n] = self.sample(flat, n * np.arange(len(own)), np.full(len(own), n), n)

    def sample(self, h: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
        """The sampled places of windows held against items of ``size`` words: window x walk x sample."""
        out = np.zeros((len(first), *self.steps[size].shape), np.uint64)
        room = max(1, EMBED_WORDS // (2 * size))
        for a in range(0, len(first), room):
            for w, steps in enumerate(self.steps[size]):
                out[a : a + room, w] = embed(h, first[a : a + room], count[a : a + room], w, 2 * size)[:, steps]
        return out

    def candidates(self, h: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which windows agree with their item in a sampled place."""
        hit = np.ones(len(item), bool)
        for n in np.unique(self.size[item]).tolist():
            if n in self.steps:
                at = np.flatnonzero(self.size[item] == n)
                for a in range(0, len(at), 4096):
                    x = at[a : a + 4096]
                    theirs = self.sampled[n][self.row[item[x]]]
                    ours = self.sample(h, first[x], np.minimum(n, end[x] - first[x]), n)
                    hit[x] = ((ours == theirs) & (theirs != 0)).any((1, 2))
        return hit


def word_masks(item: list[int]) -> dict[int, int]:
    """For each word of the item, the bits of its places."""
    out: dict[int, int] = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


def edit_row(masks: dict[int, int], size: int, words: list[int], free_start: bool) -> Iterator[int]:
    """Edit distances of the item to the first 0, 1, 2... words, or with ``free_start`` to their best ends (Myers' bit vectors)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    vp, vn, d = full, 0, size
    yield d
    for w in words:
        eq = masks.get(w, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (~(xh | vp) & full)
        hn = vp & xh
        d += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 | (not free_start), hn << 1
        vp = (hn | ~(xv | hp)) & full
        vn = hp & xv & full
        yield d


def best_alignment(masks: dict[int, int], back: dict[int, int], size: int, window: list[int]) -> tuple[int, int, int]:
    """Smallest edit distance of the item to any part of the window, with the part's start and end (first end, then latest start)."""
    d, end = min((d, j) for j, d in enumerate(edit_row(masks, size, window, True)))
    before = window[max(0, end - size - d) : end][::-1]
    return d, end - next(j for j, x in enumerate(edit_row(back, size, before, False)) if x == d), end


def _scan(part: pa.RecordBatch, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, start, end) of the best verified window for each row and item."""
    h, doc = word_hashes(string_column(part, "_text"))
    if not len(h) or not items.ids:
        return []
    ends = np.searchsorted(doc, np.arange(part.num_rows), side="right")
    begins = np.searchsorted(doc, np.arange(part.num_rows), side="left")
    found = []
    for g, (hashes, item, place, table) in items.seeds.items():
        if len(h) < g:
            continue
        acc = grams(h, g)
        at = np.flatnonzero(table[(acc >> np.uint64(44)).astype(np.int64)] & (doc[: len(acc)] == doc[g - 1 :]))
        lo = np.searchsorted(hashes, acc[at], side="left")
        hi = np.searchsorted(hashes, acc[at], side="right")
        k = hi - lo
        if not k.sum():
            continue
        pos = np.repeat(at, k)
        which = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        k, row, diagonal = item[which], doc[pos], pos - place[which]
        order = np.lexsort((diagonal, k, row))
        k, row, diagonal = k[order], row[order], diagonal[order]
        pair = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (row[1:] != row[:-1])])
        key = pair * (len(h) + 3 * items.longest) + diagonal  # diagonals of two pairs are further apart than any budget
        full = np.searchsorted(key, key + items.most[k], side="right") - np.arange(len(key)) >= items.need[k]
        row, k, diagonal = row[full], k[full], diagonal[full]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (k[1:] != k[:-1]) | (diagonal[1:] != diagonal[:-1])
        row, k, diagonal = row[fresh], k[fresh], diagonal[fresh]
        near = items.candidates(h, k, np.maximum(diagonal, begins[row]), ends[row])
        found.append(np.stack([row[near], k[near], diagonal[near]], 1))
    if not found:
        return []
    # Where the words of a match can lie, on either side of a candidate's diagonal; places that overlap become one.
    places: dict[tuple[int, int], list[list[int]]] = {}
    for row, k, diagonal in np.concatenate(found).tolist():
        most, held = int(items.most[k]), places.setdefault((row, k), [])
        lo, hi = max(int(begins[row]), diagonal - most), min(int(ends[row]), diagonal + int(items.size[k]) + most)
        if held and lo <= held[-1][1]:
            held[-1][1] = hi
        else:
            held.append([lo, hi])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for (row, k), spans in places.items():
        for lo, hi in spans:
            d, s, e = best_alignment(items.masks[k], items.back_masks[k], int(items.size[k]), h[lo:hi].tolist())
            got = (d, lo + s - int(begins[row]), lo + e - int(begins[row]))
            if d <= items.most[k] and ((row, k) not in best or got < best[row, k]):
                best[row, k] = got
    return [(row, k, *v) for (row, k), v in best.items()]


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    recall: float = 0.9999,
    block_items: int = 20_000,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Benchmark items within documents: id, item_id, distance, similarity, start_word, end_word.

    An item of L words leaks where some run of the document's words is within
    floor((1 - similarity) L) word edits of it; one row for each document row
    and item, with the closest place among the candidates, of which one at the
    very threshold is found with a chance of ``recall`` (closer ones: more). The
    benchmark is taken in blocks of at most ``block_items`` items and
    ``block_bytes`` of text (or one item), each against all documents; a block
    takes some 40 bytes a byte of text and 4 KB an item. Items and documents
    without words match nothing; long texts count whole; repeated rows and
    items give a row each; null ids are kept. An empty input gives an empty
    result.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind, item_kind = rows.schema["_id"].dataType.simpleString(), benchmark.schema[item_col].dataType
    queries = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).cast("string").alias("_itext")).where("_itext IS NOT NULL")
    out: list[DataFrame] = []

    def search(block: list) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(Items([b[0] for b in block], [b[1] for b in block], similarity, recall))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part in slices(batch, "_text"):
                    got = _scan(part, items)
                    n = [len(items.words[k]) for _, k, *_ in got]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("_id").take(pa.array([x[0] for x in got], pa.int64())),
                            pa.array([items.ids[x[1]] for x in got], ARROW[item_kind.simpleString()]),
                            pa.array([x[2] for x in got], pa.int64()),
                            pa.array([1 - x[2] / m for x, m in zip(got, n, strict=True)], pa.float64()),
                            pa.array([x[3] for x in got], pa.int64()),
                            pa.array([x[4] for x in got], pa.int64()),
                        ],
                        names=[id_col, "item_id", "distance", "similarity", "start_word", "end_word"],
                    )

        return rows.mapInArrow(emit, f"`{id_col}` {kind}, item_id {item_kind.simpleString()}, distance bigint, similarity double, start_word bigint, end_word bigint")

    block, held = [], 0
    for item, text in queries.toLocalIterator():
        if block and (len(block) >= block_items or held + len(text) > block_bytes):
            out.append(search(block))
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    out.append(search(block))
    return reduce(DataFrame.unionByName, out)


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
