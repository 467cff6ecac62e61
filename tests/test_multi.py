"""Names and patterns in texts, and overlapping spans, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import facades, metrics as M, multi_search as P


def test_occurrences(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("ab é😀", k=rng.choice([0, 5, 60])))) for i in range(60)] + [(90, None), (91, "ab" * 30_000)]
    patterns = sorted({"".join(rng.choices("ab é😀", k=rng.randrange(1, 5))) for _ in range(60)}) + ["ab" * 200, "", None]
    t, p = spark.createDataFrame(texts, "k int, t string").repartition(3), spark.createDataFrame([(x,) for x in patterns] * 2, "p string")
    want = sorted((k, x, m.start()) for k, v in texts if v is not None for x in set(patterns) if x for m in re.finditer(f"(?={re.escape(x)})", v))
    for size in (P.PART_CHARS, 40):  # in one part and in many
        got = sorted((r["k"], r["p"], r["at"]) for r in P.occurrences(t.where("k <> 91"), p, "k", "t", "p", size).collect())
        assert got == [w for w in want if w[0] != 91]
    assert P.occurrences(t, p, "k", "t", "p").where("k = 91").count() == sum(w[0] == 91 for w in want)
    q = spark.createDataFrame(list(enumerate(patterns)), "i int, p string")
    held = sorted((r["i"], r["k"]) for r in P.containing(t, q, "k", "t", "i", "p").collect())
    assert held == sorted((i, k) for i, x in enumerate(patterns) if x is not None for k, v in texts if v is not None and x in v)
    assert P.occurrences(t, p.limit(0), "k", "t", "p").collect() == [] and P.occurrences(t.limit(0), p, "k", "t", "p").collect() == []


def test_names_of_any_length(spark):
    """Whole words only, over any white space; leftmost and longest; several types of a name are several mentions."""
    rng = random.Random(3)
    names = [("new york", "City"), ("new  york city", "City"), ("york", "Name"), ("york", "Town"), ("a b c", "X"), ("b", "Y"), ("c d", "Z"), ("", "none"), (None, "none")]
    texts = [(f"d{i}", rng.choice([" ", "  ", "\n"]).join(rng.choices(["new", "york", "city", "a", "b", "c", "d", "newyork"], k=rng.choice([0, 3, 30])))) for i in range(40)] + [("long", "a b c d " * 5_000), ("null", None)]
    docs, known = spark.createDataFrame(texts, "doc_key string, text string"), spark.createDataFrame(names, "name string, entity_type string")
    kinds = {}
    for n, k in names:
        if n:
            kinds.setdefault(tuple(n.split()), []).append(k)
    want = []
    for key, text in texts:
        words, at, out = (text or "").split(), 0, []
        while at < len(words):
            best = max((n for n in kinds if tuple(words[at : at + len(n)]) == n), key=len, default=None)
            if best:
                out += [(at, at + len(best), " ".join(best), k) for k in sorted(kinds[best])]
            at += len(best) if best else 1
        want += [(key, i, *m) for i, m in enumerate(out)]
    got = facades.ner(docs, "dictionary", dictionary=known).collect()
    assert sorted((r["doc_key"], r["m_idx"], r["start"], r["end"], r["name"], r["entity_type"]) for r in got) == sorted(want)


def test_a_large_dictionary(spark):
    """A hundred thousand names in several parts."""
    names = spark.range(100_000).select(F.concat(F.lit("name "), "id").alias("name"), F.lit("T").alias("entity_type"))
    docs = spark.createDataFrame([("d", "this is name 77 and name 99999, or name 5 name 100000")], "doc_key string, text string")
    got = P.names_in_texts(docs, names, part_chars=400_000).collect()
    assert sorted((r["start"], r["end"], r["name"]) for r in got) == [(2, 4, "name 77"), (8, 10, "name 5")]


def test_a_text_is_read_once_for_all_names(spark, monkeypatch):
    """Names of one to six words held against a filter, in a full one too, equal brute force; texts do not pass a part of the names at a time."""
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefé") + rng.choice("xy")
    names = sorted({" ".join(word() for _ in range(rng.choice([1, 2, 2, 3, 6]))) for _ in range(60)})
    kinds = {tuple(n.split()): sorted({None, "K"} if i % 5 == 0 else {f"K{i % 3}", "K"}, key=lambda k: k or "") for i, n in enumerate(names)}
    texts = [(i, "\t".join(word() for _ in range(rng.choice([0, 1, 5, 200])))) for i in range(50)] + [(90, None), (91, " "), (92, "ax by " * 20_000)]
    docs = spark.createDataFrame(texts, "doc_key int, text string").repartition(3)
    known = spark.createDataFrame([(" ".join(n), k) for n, ks in kinds.items() for k in ks], "name string, kind string")
    want = []
    for key, text in texts:
        words, at, nth = (text or "").split(), 0, 0
        while at < len(words):
            best = max((n for n in range(1, 7) if at + n <= len(words) and tuple(words[at : at + n]) in kinds), default=0)
            for k in kinds[tuple(words[at : at + best])] if best else ():
                want.append((key, at, at + best, " ".join(words[at : at + best]), nth, k))
                nth += 1
            at += best or 1
    monkeypatch.setattr(P, "_places", lambda *_: pytest.fail("texts passed through automata"))
    monkeypatch.setattr(P, "TEXT_CHARS", 300)
    order = lambda rows: sorted(rows, key=lambda r: (*r[:5], r[5] or ""))
    for bits in (1 << 27, 8):
        monkeypatch.setattr(P, "FILTER_BITS", bits)
        assert order(map(tuple, P.numbered_names(docs, known, part_chars=100).collect())) == order(want)


def test_overlapping_spans(spark):
    rng = random.Random(2)

    def spans(n):
        out = []
        for _ in range(n):
            b = rng.randrange(60)
            out.append((rng.choice(["d1", "d2", None]), b, b + rng.choice([0, 0, 3, 9, -1]), rng.choice(["A", "B", None])))
        return out

    schema = "doc_key string, begin int, end int, entity_type string"
    p, g = spans(60), spans(70)
    hit = lambda a, b: sum(any(x[0] == y[0] is not None and x[3] == y[3] is not None and x[1] <= y[2] and y[1] <= x[2] for y in b) for x in set(a))
    out = M.overlap_scores(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema))
    r = out.first()
    assert (r["correct_pred"], r["correct_gold"]) == (hit(p, g), hit(g, p))
    many = spark.range(100_000).select(F.lit("d").alias("doc_key"), (F.col("id") * 3).cast("int").alias("begin"), (F.col("id") * 3 + 1).cast("int").alias("end"), F.lit("A").alias("entity_type"))
    r = M.overlap_scores(many, many.withColumn("begin", F.col("begin") + 2).withColumn("end", F.col("end") + 2)).first()
    assert (r["correct_pred"], r["correct_gold"]) == (99_999, 99_999)  # one document of 100,000 spans
