from pyspark.sql import functions as F

from lodestone.operators import metrics as M, segments as S


def test_packing_by_length(spark):
    x = lambda ns, most: [tuple(r) for r in spark.range(1).select(S.pack_segments(F.lit(ns), most).alias("x")).first()[0]]
    assert x([3, 3, 3], 6) == [(0, 0), (0, 3), (1, 0)]
    assert x([14, 2, 5], 6) == [(0, 0), (2, 2), (3, 0)]


def test_token_segments(spark):
    t = spark.createDataFrame([("d", s, s * 100 + i) for s, n in enumerate([14, 2, 5]) for i in range(n)], "doc_key string, sent_idx int, idx int")
    got = [(r["segment"], r["place"]) for r in S.token_segments(t, 6).orderBy("idx").collect()]
    assert got == [(i // 6, i % 6) for i in range(16)] + [(3, i) for i in range(5)]


def test_decoding(spark):
    rows = [("d", 0, 1, [0.0, 2.0, 1.0], True), ("d", 1, 2, [0.0, 1.0, 3.0], True), ("d", 4, 4, [5.0, 1.0, 1.0], True), ("d", 6, 6, [0.0, 9.0, 1.0], False), ("d", 0, 30, [0.0, 9.0, 1.0], True)]
    df = spark.createDataFrame(rows, "doc_key string, begin int, end int, logits array<double>, valid boolean")
    assert [tuple(r)[1:] for r in S.decode_span_scores(df, ["NONE", "A", "B"]).collect()] == [(1, 2, "B")]


def test_composition(spark):
    df = spark.createDataFrame([("ÉA",), (None,)], "s string")
    assert [r[0] for r in df.select(S.composed_lower("s")).collect()] == ["éa", None]


def test_official_scores_without_predictions(spark):
    t = spark.createDataFrame([("d", "a", "r", "b", [0])], "doc_key string, head string, relation string, tail string, evidences array<int>")
    names = spark.createDataFrame([("d", "a", "a")], "doc_key string, entity string, name string")
    facts = spark.createDataFrame([], "head_name string, relation string, tail_name string")
    r = M.official_scores(t.limit(0), t, names, facts).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    r = M.official_scores(t.union(t), t, names, facts).first()
    assert r["pred"] == 1 and r["f1"] == 100.0 and r["evidence_f1"] == 100.0
