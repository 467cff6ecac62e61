"""All occurrences of many patterns in texts at once, by Aho-Corasick automata.

A set of patterns is cut into parts of bounded size; each part is shipped to
the executors, where a worker builds its automaton once and runs every text
through it. However many patterns there are, a text is read once for each part.
Names of whole words are met by their hashes instead where there are many.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.staging import stage

#: Characters of the patterns of one part, about: some hundred bytes of automaton each.
PART_CHARS = 1_000_000

#: The automaton that this worker built last, under its part's name.
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, patterns: list[str]) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for pattern in patterns:
            made.add_word(pattern, pattern)
        made.make_automaton()
        _built[name] = made
    return _built[name]


def occurrences(texts: DataFrame, patterns: DataFrame, key: str = "key", text: str = "text", pattern: str = "pattern", part_chars: int = PART_CHARS) -> DataFrame:
    """(key, pattern, at): every place (from 0, in characters) where a text holds a pattern, overlaps included.

    Null texts and null or empty patterns are found nowhere. Equal patterns
    count once.
    """
    return _places(texts, patterns, key, text, pattern, part_chars).drop("word")


def _places(texts: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str, part_chars: int) -> DataFrame:
    """``occurrences`` with ``word``: how many spaces the text has before the place."""
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()
    distinct = patterns.select(F.col(pattern).alias("p")).where("p <> ''").distinct()
    total = distinct.agg(F.sum(F.length("p"))).first()[0] or 0
    parts = max(1, -(-total // part_chars))
    distinct = stage(distinct.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(parts)).cast("int")), "patterns") if parts > 1 else distinct.withColumn("part", F.lit(0))
    rows = stage(rows, "texts") if parts > 1 else rows  # made once, read for each part
    found: list[DataFrame] = []
    for part in range(parts):
        shipped = texts.sparkSession.sparkContext.broadcast([r[0] for r in distinct.where(F.col("part") == part).select("p").collect()])  # about part_chars characters

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped, label=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            machine = _automaton(label, shipped.value) if shipped.value else None
            for batch in batches if machine else ():
                row, names, at, words = [], [], [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    seen = n = 0
                    for start, name in sorted((end - len(name) + 1, name) for end, name in machine.iter(value)):
                        n += value.count(" ", seen, start)
                        seen = start
                        row.append(i)
                        names.append(name)
                        at.append(start)
                        words.append(n)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(names, pa.string()), pa.array(at, pa.int64()), pa.array(words, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "pattern", "at", "word"])

        found.append(rows.mapInArrow(search, f"key {kind}, pattern string, at bigint, word int"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("key").alias(key), F.col("pattern").alias(pattern), "at", "word")


def containing(texts: DataFrame, patterns: DataFrame, key: str, text: str, pattern_key: str, pattern: str) -> DataFrame:
    """Distinct (pattern_key, key) of the texts that hold a pattern; an empty pattern is held by every text that is not null."""
    met = occurrences(texts, patterns, key, text, pattern).select(key, pattern).distinct()
    out = patterns.select(pattern_key, pattern).join(met, pattern).select(pattern_key, key)
    empty = patterns.where(F.col(pattern) == "").select(pattern_key)
    if not empty.isEmpty():
        out = out.unionByName(empty.crossJoin(texts.where(F.col(text).isNotNull()).select(key)).select(pattern_key, key))
    return out.distinct()


#: Bits of the filter of names at most (16 MB), bits for a name below that, and characters of the texts met at once, about.
FILTER_BITS, BITS_A_NAME, TEXT_CHARS = 1 << 27, 16, 1 << 22
#: An odd number for the hash of a run of words, and its inverse modulo 2^64.
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _run_hashes(words: pa.Array) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function that gives the hashes of the runs of so many words that begin at the places named."""
    coded = words.dictionary_encode()
    each = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False).astype(np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]
    sums = np.zeros(len(each) + 1, np.uint64)
    np.cumsum(each * _powers(ODD, len(each)), dtype=np.uint64, out=sums[1:])
    back = _powers(INVERSE, len(each) + 1)

    def of(at: np.ndarray, n: int) -> np.ndarray:
        h = (sums[at + n] - sums[at]) * back[at]
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))

    return of


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The three places that a hash has in a filter of so many bits (a power of two)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(3):
        yield (hashes + np.uint64(i) * step) & np.uint64(bits - 1)


def _name_filter(names: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the names (name, words between single spaces), as bytes: at most ``FILTER_BITS``, however many there are."""
    bits = min(FILTER_BITS, 1 << max(10, (count * BITS_A_NAME - 1).bit_length()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for batch in batches:
            lists = pc.split_pattern(batch.column(0), " ")
            of, at, sizes = _run_hashes(lists.flatten()), lists.offsets.to_numpy()[:-1].astype(np.int64), pc.list_value_length(lists).to_numpy()
            for n in np.unique(sizes):
                for place in _probes(of(at[sizes == n], int(n)), bits):
                    held[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], ["f"])

    out = np.zeros(bits // 8, np.uint8)
    for row in names.select("name").coalesce(16).mapInArrow(add, "f binary").toLocalIterator():  # 16 filters of fixed size at most, one at a time
        out |= np.frombuffer(row["f"], np.uint8)
    return out


def _runs_like_names(documents: DataFrame, names: DataFrame, count: int) -> DataFrame:
    """(doc_key, start, end, name): the runs of words that the filter of the names lets through: all names, and few other runs."""
    sizes = sorted(r[0] for r in names.select(F.size(F.split("name", " "))).distinct().collect())  # one row per number of words
    shipped = documents.sparkSession.sparkContext.broadcast(_name_filter(names, count))
    texts = documents.select("doc_key", F.array_join(T.words(F.col("text")), " ").alias("text")).where("doc_key IS NOT NULL AND text <> ''")
    kind = texts.schema["doc_key"].dataType.simpleString()

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch cut where its texts have enough characters."""
        piece = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy()) // TEXT_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in (piece for whole in batches for piece in pieces(whole)):
            lists = pc.split_pattern(batch.column(1), " ")
            words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
            of, row = _run_hashes(words), np.repeat(np.arange(len(counts)), counts)
            ends = np.cumsum(counts)
            for n in sizes:
                at = np.flatnonzero(np.arange(len(words)) + n <= ends[row])
                passed = np.ones(len(at), bool)
                for place in _probes(of(at, n), len(held) * 8):
                    passed &= (held[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1
                at = at[passed]
                if not len(at):
                    continue
                name = words.take(pa.array(at)) if n == 1 else pc.binary_join_element_wise(*(words.take(pa.array(at + j)) for j in range(n)), " ")
                start = (at - (ends - counts)[row[at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), pa.array(start), pa.array(start + np.int32(n)), name], ["doc_key", "start", "end", "name"])

    return texts.mapInArrow(search, f"doc_key {kind}, start int, end int, name string")


def _longest_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document's spans (doc_key, start, end, many, ...), which come together and sorted, those that stand when the leftmost, and of these the longest, go first.

    ``many`` is how many mentions a span stands for; it becomes the number of the mentions before it.
    """
    document, free, before = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, start, end = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        new = np.concatenate([[keys[0].as_py() != document], pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)])
        if (~new & (start < np.concatenate([[free], end[:-1]]))).any():
            kept = []
            for i, (first, a, b) in enumerate(zip(new.tolist(), start.tolist(), end.tolist(), strict=True)):
                if first or a >= free:
                    kept.append(i)
                    free = b
            kept = np.array(kept)
        else:
            kept = np.arange(len(keys))
        # A document's first span always stands.
        many, new = batch.column(3).to_numpy()[kept], new[kept]
        sofar = np.cumsum(many) - many
        group = np.cumsum(new)
        base = np.concatenate([[-before], sofar[new]])[group]
        document, free, before = keys[len(keys) - 1].as_py(), int(end[kept[-1]]), int(sofar[-1] - base[-1] + many[-1])
        out = batch.take(pa.array(kept))
        yield out.set_column(3, "many", pa.array((sofar - base).astype(np.int32)))


def names_in_texts(documents: DataFrame, names: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_key, start, end, name): the dictionary names (name) in each document (doc_key, text), by words from 0, ends exclusive.

    Names are sequences of words and are met as whole words only, whatever
    white space is between them. Where names overlap, the leftmost stands, and
    of those that begin together the longest.
    """
    named = names.select(F.array_join(T.words(F.col("name")), " ").alias("name")).where("name <> ''").distinct()
    met, named, exact = _name_places(documents, named, part_chars)
    met = met if exact else met.join(named, "name", "left_semi")
    return _standing(met.select("doc_key", "start", "end", F.lit(1).alias("many"), "name")).drop("many")


def _name_places(documents: DataFrame, named: DataFrame, part_chars: int) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_key, start, end, name) of all names and, of a large dictionary, a few runs of words that are none; the names; whether all are names."""
    n, chars = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("name") + 2), F.lit(0))).first()
    if chars > part_chars:
        named = stage(named, "names")
        return _runs_like_names(documents, named, n), named, False
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    texts = documents.select("doc_key", spaced(F.array_join(T.words(F.col("text")), " ")).alias("text"))
    # A name begins at the space before its first word.
    places = _places(texts, named.select(spaced(F.col("name")).alias("pattern")), "doc_key", "text", "pattern", part_chars).where("doc_key IS NOT NULL")
    name = F.trim("pattern")
    return places.select("doc_key", F.col("word").alias("start"), (F.col("word") + F.size(F.split(name, " "))).cast("int").alias("end"), name.alias("name")), named, True


def _standing(spans: DataFrame) -> DataFrame:
    """The spans that ``_longest_first`` leaves of each document."""
    spans = spans.repartition("doc_key").sortWithinPartitions("doc_key", "start", F.desc("end"))
    return spans.mapInArrow(_longest_first, spans.schema)


def numbered_names(documents: DataFrame, names: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``names_in_texts`` for names (name, kind) with the kinds of each, a row for each kind, and its number (nth, from 0) in the document by place and kind.

    A dictionary of up to ``part_chars`` characters is an automaton. The runs
    of words of a text are held against a filter of a larger one, and those
    that pass against the names themselves, so a text is read once however
    many names there are.
    """
    plain = names.select(F.array_join(T.words(F.col("name")), " ").alias("name"), "kind").where("name <> ''")
    named = plain.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("kind"))).alias("kinds"))
    met, named, _ = _name_places(documents, named, part_chars)
    stand = _standing(met.join(named, "name").select("doc_key", "start", "end", F.size("kinds").alias("many"), "name", "kinds"))
    each = stand.select("doc_key", "start", "end", "name", "many", F.posexplode("kinds").alias("_at", "_k"))
    return each.select("doc_key", "start", "end", "name", (F.col("many") + F.col("_at")).alias("nth"), F.col("_k.kind").alias("kind"))
