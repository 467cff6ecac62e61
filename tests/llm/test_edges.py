"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import classifier, decontaminate, jaccard, licenses, mixing, pages, rules, sharding, suffixes, tokens

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use or return, as extra columns.
CLASH = ("_id", "_text", "size", "shard", "slot", "score", "n_words", "key", "n", "block", "host", "component_id", "spans")
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (None, "some words of a null id", "en", None, 20),
    (4, "one two", "en", "b", 7),
    (4, "one two", "en", "b", 7),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "c", len(LONG)),
    (7, "Größe ñandú 😀 übung MIT License, line\nline\nline", "de", "c", 40),
]


def operators(spark):
    items = spark.createDataFrame([(1, "word5 x5 word6 x6 word7 x7 word8 x8"), (2, None), (3, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    return {
        "mix": mixing.mix_sources,
        "tokens": tokens.count_tokens,
        "jaccard": lambda d: jaccard.jaccard_components(d, 4, 85),
        "suffixes": suffixes.remove_repeats,
        "licenses": licenses.scan_licenses,
        "rules": rules.quality_rules,
        "leaks": lambda d: decontaminate.find_leaks(d, items),
        "shard": lambda d: sharding.shard_by_size(d, 3),
        "classifier": lambda d: classifier.score(d, classifier.fit(d, labels)),
    }


NAMES = ("mix", "tokens", "jaccard", "suffixes", "licenses", "rules", "leaks", "shard", "classifier")


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_names(spark, name):
    docs = spark.createDataFrame(ROWS, DOC)
    plain = operators(spark)[name](docs)
    got = sorted(map(str, plain.collect()))
    if name != "leaks":
        assert len(got) == len(ROWS)
    wide = docs.select("*", *(F.lit(c).alias(c) for c in CLASH))
    assert sorted(map(str, operators(spark)[name](wide).collect())) == got


def test_pages_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://h/x", "<p>a&amp;b <br> c"), (3, "http://h/x", "<p>a&amp;b <br> c"), (None, "no host", "plain & simple")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in pages.extract_pages(df.withColumn("text", F.lit("clash"))).collect())
    assert got == [(0, "plain & simple", 14), (1, "", 0), (2, "", 0), (3, "a&b c", 5), (3, "a&b c", 5)]
    assert pages.extract_pages(df.limit(0)).collect() == []


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, DOC)
    shards = sharding.shard_by_size(docs, 3).collect()
    assert sum(r["size"] for r in shards) == sum(len((r[1] or "").encode()) + 8 for r in ROWS)
    assert sorted(r["text_crc32"] for r in shards) == sorted(zlib.crc32((r[1] or "").encode()) for r in ROWS)
    comps = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, 4, 85).collect()]
    assert comps.count((4, 1, 4)) == 2 and (2, 0, 2) in comps and (3, 0, 3) in comps and (None, 3, None) in comps
    assert {c for d, _, c in comps if d in (5, 6)} == {5}
    left = {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs).collect() if r["doc_id"] in (2, 6)}
    assert left == {(2, 0, hashlib.sha256(b"").hexdigest()), (6, len(LONG), hashlib.sha256(b"").hexdigest())}
    marks = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert marks[7]["base_labels"] == "mit" and marks[7]["first_word"] == 4 and marks[1]["n_words"] == 0 and marks[1]["first_word"] is None
    kept = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    assert kept[7]["n_dup_lines"] == 1 and kept[1]["base_failed"]
    leaks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, spark.createDataFrame([(1, "x5 word6 x6 word7 x7 word8 x8")], "item_id bigint, text string")).collect()}
    assert leaks == {(5, 1), (6, 1)}


def test_empty_side_tables(spark):
    docs = spark.createDataFrame(ROWS, DOC)
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id bigint, text string")).collect() == []
    model = classifier.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {round(r["score"], 6) for r in classifier.score(docs, model).collect()} == {0.5}
    one_class = classifier.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id bigint, quality int, toxic int"))
    assert all(r["score"] > 0.5 for r in classifier.score(docs, one_class).collect())
