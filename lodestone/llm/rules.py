"""Document and host quality rules (DataFrame operations only).

Rule counts are computed inside each row with higher-order functions. Rule
failures are then aggregated by host, host rates are shrunk towards the
corpus with an empirical beta prior (fitted by moments over hosts), and the
verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import stage

#: White space that separates words, and characters that count as symbols (fixed values).
SPACES = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"


def _bind(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    parts = F.split(F.translate(text, SPACES, " " * len(SPACES)), " ")
    return F.array_remove(parts, "")


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window whose words occur twice or more in the text."""

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            def repeated(x: Column, i: Column) -> Column:
                after = F.get(pairs, i + 1)["h"]
                return (F.coalesce(after == x["h"], F.lit(False))) | ((i > 0) & F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False)))

            places = F.array_sort(F.transform(F.filter(pairs, repeated), lambda x: x["i"]))
            start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(
                places,
                start,
                lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("bigint").alias("n"), p.alias("last")),
            )["n"]

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unique, F.lit(0).cast("bigint")).otherwise(_bind(F.sort_array(pairs), of_sorted))

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(_bind(hashes, of_hashes))

    return _bind(words, of_words)


def rule_counts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text, beside ``keep``.

    Nulls and empty texts count 0 throughout. Windows are compared by a
    64-bit hash of their three words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = _bind(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("r")))
    return df.select(
        *keep,
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        counts.alias("_c"),
    ).select("*", F.col("_c.n").alias("n_words"), F.col("_c.r").alias("n_repeat_words")).drop("_c")


def host_verdicts(failures: DataFrame, host_col: str, failed_col: str, reject_above: float = 0.5) -> DataFrame:
    """One row per host: rows, failures, shrunk failure rate and whether the host is rejected.

    The beta prior has the mean and, by moments, the variance of the hosts'
    raw rates; where they do not vary (or there is one host) it weighs as much
    as 10 rows. The posterior mean (failures + a) / (rows + a + b) is
    compared with ``reject_above``.
    """
    hosts = failures.groupBy(host_col).agg(F.count(F.lit(1)).alias("host_rows"), F.sum(F.col(failed_col).cast("bigint")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_rows")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    m, v = F.col("m"), F.col("v")
    weight = F.when((v > 0) & (m > 0) & (m < 1) & (m * (1 - m) / v > 1.5), m * (1 - m) / v - 1).otherwise(F.lit(10.0))
    prior = prior.select(m.alias("_m"), F.least(weight, F.lit(10000.0)).alias("_w"))
    shrunk = (F.col("host_failed") + F.col("_m") * F.col("_w")) / (F.col("host_rows") + F.col("_w"))
    return (
        hosts.join(F.broadcast(prior))  # one row
        .withColumn("host_rate", shrunk)
        .withColumn("host_rejected", F.col("host_rate") > reject_above)
        .drop("_m", "_w")
    )


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    reject_above: float = 0.5,
) -> DataFrame:
    """Rule counts, the document's own verdict and its host's, for every row.

    A document fails with under ``min_words`` words, or when more than
    ``max_repeat_percent`` percent of its words are repeated. ``kept`` is
    false for a failed document and for every document of a rejected host.
    A null host is a host of its own; a null or empty text has no words and
    fails; repeated rows are kept; an empty input gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_text"))
    counts = rule_counts(rows, "_text", ("_id", "_host"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = stage(counts.withColumn("base_failed", failed), "rule-counts")
    verdicts = stage(host_verdicts(counts, "_host", "base_failed", reject_above), "host-verdicts").withColumnRenamed("_host", "_h")
    out = counts.join(verdicts, F.col("_host").eqNullSafe(F.col("_h")))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "host_rate",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
    )
