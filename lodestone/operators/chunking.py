"""Passages, chunks and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def chunk_passages(df: DataFrame, window: int, text_col: str = "text", long_texts: bool = False) -> DataFrame:
    """One row per chunk: all columns of the passage, the text replaced by the chunk, and chunk_index.

    ``long_texts`` splits sentences paragraph by paragraph. A passage without
    sentences has no chunks.
    """
    units = (T.paragraph_sentences if long_texts else T.sentences)(F.col(text_col))
    others = [c for c in df.columns if c != text_col]
    packed = df.select(*others, T.pack_chunks(units, window).alias("_chunks"))
    return packed.select(*others, F.posexplode("_chunks").alias("chunk_index", text_col))


def chunk_statistics(before: DataFrame, after: DataFrame, text_col: str = "text") -> DataFrame:
    """Passages and their mean spaced length before and after chunking, one row."""
    n = T.spaced_length(F.col(text_col))
    one = before.agg(F.count(F.lit(1)).alias("passages"), F.avg(n).alias("mean_words"))
    two = after.agg(F.count(F.lit(1)).alias("chunks"), F.avg(n).alias("mean_chunk_words"))
    return one.crossJoin(two)  # one row each


def documents_from_passages(df: DataFrame, doc_key: Column, text_col: str = "text", title_col: str | None = None, tokenize: bool = False) -> DataFrame:
    """doc_key and sentences: the title first where there is one, white space collapsed."""
    split = T.tokenized_sentences if tokenize else T.sentences
    body = split(F.col(text_col))
    if title_col:
        title = F.array_join(T.tokens(F.col(title_col)), " ") if tokenize else F.col(title_col)
        body = F.when(F.col(title_col).isNotNull(), F.concat(F.array(title), body)).otherwise(body)
    return df.select(doc_key.alias("doc_key"), F.transform(body, T.collapse_spaces).alias("sentences"))


def passage_keys(df: DataFrame, order_col: str, prefix: str = "Passage#", buckets: int = 64) -> DataFrame:
    """``df`` with doc_key ``prefix`` + global row number from 0 in the order of a numeric column.

    Numbers are dealt range by range: ranges of the order column (cut by
    approximate quantiles) are counted, and each row adds its place in the
    range to the rows before it, so no task sees all rows.
    """
    cuts = df.agg(F.percentile_approx(order_col, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    at = F.aggregate(F.lit(sorted(set(cuts)) or [0]), F.lit(0), lambda n, c: n + (F.col(order_col) > c).cast("int"))
    placed = df.withColumn("_r", at)
    held = placed.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = held.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    nth = F.row_number().over(Window.partitionBy("_r").orderBy(order_col))
    return placed.withColumn("_i", nth).join(F.broadcast(before), "_r").withColumn("doc_key", F.concat(F.lit(prefix), (F.col("_b") + F.col("_i") - 1).cast("string"))).drop("_r", "_b", "_i")


def sentence_offsets(sentences: DataFrame, key: str = "doc_key", pos: str = "sent_idx", text: str = "sentence") -> DataFrame:
    """Adds each sentence's first token index within its document and its number of tokens."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    counted = sentences.withColumn("n_tokens", F.size(T.words(F.col(text))).cast("bigint"))
    return counted.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def mark_mentions(words: Column, mentions: Column) -> Column:
    """The words with each mention in braces, ``{words:TYPE}``; inner (shorter) mentions are marked first.

    ``mentions``: array of struct(begin, end, entity_type), ends inclusive.
    """
    by_length = F.array_sort(F.transform(mentions, lambda m: F.struct((m["end"] - m["begin"]).alias("d"), m["begin"].alias("b"), m["end"].alias("e"), m["entity_type"].alias("t"))))

    def mark(ws: Column, m: Column) -> Column:
        opened = lambda w, i: F.when(i == m["b"], F.concat(F.lit("{"), w)).otherwise(w)
        closed = lambda w, i: F.when(i == m["e"], F.concat(w, F.lit(":"), m["t"], F.lit("}"))).otherwise(w)
        return F.transform(F.transform(ws, opened), closed)

    return F.array_join(F.aggregate(by_length, words, mark), " ")


def merge_crossed_sentences(sentences: DataFrame, mentions: DataFrame, key: str = "doc_key") -> DataFrame:
    """Sentences joined until no mention crosses a boundary: key, sent_idx (new), sentence.

    ``sentences``: key, sent_idx, sentence; ``mentions``: key, begin, end (token
    indices in the document). A boundary is kept where no mention has tokens
    on both sides; the running count of kept boundaries numbers the results.
    """
    placed = sentence_offsets(sentences, key)
    # A boundary is crossed if, of the mentions that begin before it, the farthest end reaches it.
    none = F.lit(None).cast("bigint")
    cuts = placed.select(key, "sent_idx", "sentence", F.col("first_token").alias("_at"), none.alias("_end"))
    spans = mentions.select(key, none.alias("sent_idx"), F.lit(None).cast("string").alias("sentence"), F.col("begin").cast("bigint").alias("_at"), F.col("end").cast("bigint").alias("_end"))
    reach = F.max("_end").over(Window.partitionBy(key).orderBy("_at", F.col("sent_idx").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flagged = cuts.unionByName(spans).withColumn("_crossed", F.when(reach >= F.col("_at"), True)).where("sent_idx IS NOT NULL")
    kept = F.when((F.col("sent_idx") > 0) & F.col("_crossed").isNull(), 1).otherwise(0)
    run = F.sum(kept).over(Window.partitionBy(key).orderBy("sent_idx"))
    parts = F.array_sort(F.collect_list(F.struct("sent_idx", "sentence")))
    merged = F.array_join(F.transform(parts, lambda x: x["sentence"]), " ")
    return flagged.withColumn("_g", run.cast("bigint")).groupBy(key, "_g").agg(merged.alias("sentence")).withColumnRenamed("_g", "sent_idx")


def space_mentions(text: Column, mentions: Column) -> Column:
    """The text with spaces put around mention edges and round or square brackets.

    ``mentions``: array of struct(begin, end), characters, end exclusive.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    edge = lambda i: F.exists(mentions, lambda m: (m["begin"] == i) | (m["end"] == i))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(edge(i) & (i > 0), F.concat(F.lit(" "), c)).otherwise(c)), "")
    return F.regexp_replace(spaced, r"([()\[\]])", " $1 ")


def align_characters(tokens: Column, begin: Column, end: Column) -> Column:
    """Token span (inclusive) of a span of non-space characters [begin, end).

    Offsets count the characters of the tokens only, as left after all white
    space is removed from the text.
    """
    ends = F.aggregate(tokens, F.array().cast("array<int>"), lambda a, t: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(t)))
    first = lambda x: F.size(F.filter(ends, lambda e: e <= x))
    return F.struct(first(begin).alias("begin"), first(end - 1).alias("end"))


def drop_blank_tokens(tokens: DataFrame, key: str = "doc_key") -> DataFrame:
    """Token rows (key, idx, token) without blank ones, with the new index and the old one."""
    keep = F.when(F.trim("token") != "", 1).otherwise(0)
    new = F.sum(keep).over(Window.partitionBy(key).orderBy("idx")) - 1
    return tokens.withColumn("new_idx", new.cast("bigint")).where(F.trim("token") != "").select(key, F.col("idx").alias("old_idx"), "new_idx", "token")
