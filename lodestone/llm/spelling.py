"""Grouping of spelling variants by letter-parity bands (DataFrame operations only).

A word's mask holds the parity of how often each letter occurs. One inserted
or deleted code point flips one bit of it, one replaced code point at most two.
Of three bands of the mask at least one therefore stays whole, and words are
joined where a band of theirs is equal and their lengths differ by at most one.
The edit also leaves the words whole either before or after their middle, so
the join key holds that half of the word besides the band; this loses no pair
and keeps groups small where a vocabulary is large. Each pair is taken at the
first key that it shares and verified by its edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import stage, unstage

#: A run of letters of a text, in regular-expression form, and the letters that are lowered (fixed values).
LETTER_RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a band; letters are dealt to the three bands in turn.
BAND_BITS = 20


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def thinned(word: Column, doc_id: Column, divisor: int) -> Column:
    """The word as it counts for the document: where ``divisor`` divides the crc32 h of ``id:word``, without code point h % length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(F.pmod(h, F.lit(divisor)) == 0, shorter).otherwise(word)


def word_counts(df: DataFrame, id_col: str, text_col: str, divisor: int, min_length: int, min_count: int) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points that occur ``min_count`` times or more."""
    runs = df.select(df[id_col].alias("_id"), F.explode(F.regexp_extract_all(df[text_col], F.lit(LETTER_RUN), F.lit(0))).alias("_run"))
    # A deletion takes one code point, so shorter runs cannot become words.
    words = runs.where(F.length("_run") >= min_length).select(thinned(lowered(F.col("_run")), F.col("_id"), divisor).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def parity_mask(word: Column) -> Column:
    """A long with one bit a letter, set where the letter occurs an odd number of times; letter c lies in band c % 3."""

    def flip(mask: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        bit = F.pmod(code, F.lit(3)) * BAND_BITS + F.pmod(F.floor(code / 3), F.lit(BAND_BITS))
        return mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int")))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), flip)


def _keyed(words: DataFrame, base: Column) -> DataFrame:
    """``words`` once for each half and band, as sides of pairs whose shorter word has ``base`` code points.

    The halves are the first base div 2 code points and the last base - base div 2.
    """
    middle = F.floor(base / 2).cast("int")
    word, length = F.col("word"), F.length("word")
    halves = F.array(F.substring(word, F.lit(1), middle), F.substring(word, length - (base - middle) + 1, length))
    bands = F.array(*(F.call_function("shiftright", F.col("mask"), F.lit(BAND_BITS * k)).bitwiseAND(F.lit((1 << BAND_BITS) - 1)) for k in range(3)))
    out = words.select("word", "n", "mask", base.alias("base"), halves.alias("halves"), F.posexplode(halves).alias("half", "part"))
    return out.select("word", "n", "mask", "base", "halves", "half", "part", F.posexplode(bands).alias("band", "bits"))


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs (a, b) of words at edit distance 1, each once, with their counts na and nb; words has word, n and mask."""
    length = F.length("word")
    left = _keyed(words, length).select("base", "half", "part", "band", "bits", F.col("word").alias("a"), F.col("n").alias("na"), F.col("mask").alias("ma"), F.col("halves").alias("ha"))
    right = _keyed(words, length).unionByName(_keyed(words, length - 1))
    right = right.select("base", "half", "part", "band", "bits", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("mask").alias("mb"), F.col("halves").alias("hb"))
    met = left.join(right, ["base", "half", "part", "band", "bits"])
    differ = F.col("ma").bitwiseXOR(F.col("mb"))

    def band_differs(k: int) -> Column:
        return differ.bitwiseAND(F.lit(((1 << BAND_BITS) - 1) << (BAND_BITS * k))) != 0

    first_band = ((F.col("band") < 1) | band_differs(0)) & ((F.col("band") < 2) | band_differs(1))
    first_half = (F.col("half") == 0) | (F.get("ha", F.lit(0)) != F.get("hb", F.lit(0)))
    one_way = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return met.where(one_way & first_band & first_half & (F.bit_count(differ) <= 2)).where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def spelling_variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    divisor: int = 199,
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
) -> DataFrame:
    """The words of all texts with the form that each is a variant of: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z lowered), thinned by document (``thinned``),
    of ``min_length`` code points and ``min_count`` occurrences at least. Two
    words are near at edit distance 1. A word's form is its near word of
    largest n (ties: smallest in code-point order) if that n is at least
    ``ratio`` times its own; root follows the forms to the last one.

    Null and empty texts have no words; a null id counts as an empty one;
    repeated rows count again; runs of any length are taken whole; an empty
    table, or one without frequent words, gives an empty result.
    """
    counted = word_counts(df, id_col, text_col, divisor, min_length, min_count)
    words = stage(counted.withColumn("mask", parity_mask(F.col("word"))), "words")
    pairs = stage(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("_best"))
    led = words.drop("mask").join(best, "word", "left").withColumn("_takes", -F.col("_best.m") >= F.col("n") * ratio)
    led = led.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("_takes"), F.col("_best.near")).alias("form"), F.when(F.col("_takes"), -F.col("_best.m")).alias("form_n"))
    led = stage(led, "forms")
    unstage(pairs)
    unstage(words)
    # Counts grow by ``ratio`` from word to form, so chains are short; every round doubles the way that is known.
    roots = stage(led.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        hop = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if roots.join(hop, "root", "left_semi").isEmpty():
            break
        after = stage(roots.join(hop, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        unstage(roots)
        roots = after
    out = led.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
