"""Steps that must not grow faster than their input: what they start, shuffle and hold, with results against plainer ways."""

import numpy as np


def test_upserts_start_what_is_asked(spark, tmp_path):
    """Nodes or edges alone need the other's stream not to run; no state is kept in Python."""
    from lodestone.streaming import graph_upsert as U

    schema = "head string, relation string, tail string, doc_key string, ingest struct<part:int,pos:bigint>"
    spark.createDataFrame([("a", "r", "b", "d", (1, i)) for i in range(3)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for what, n in (("edges", 1), ("nodes", 2)):
        started = U.start_upserts(stream, str(tmp_path / what), what=(what,))
        for q in started:
            q.awaitTermination()
        assert len(started) == n and sorted(p.name for p in (tmp_path / what).iterdir()) == ["checkpoints", what]
        assert "Pandas" not in "".join(q._jsq.explainInternal(False) for q in started)
    assert [r["doc_key_list"] for r in U.nodes_now(spark, str(tmp_path / "nodes")).collect()] == ["d", "d"]
    assert [r["doc_key_list"] for r in U.edges_now(spark, str(tmp_path / "edges")).collect()] == ["d"]


def test_late_search(spark):
    """Equal to scores of all pairs; pairs are never rows."""
    from pyspark.sql import functions as F

    from lodestone.operators import retrieval as R

    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, (int(rng.integers(1, 4)), 4)).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v array<array<double>>").repartition(3)
    asked = df.where("id % 7 = 0").withColumnRenamed("id", "q")
    got = R.late_search(df, asked, "id", "q", "v", 5, 4)
    assert "Join" not in got._jdf.queryExecution().toString()
    plain = df.crossJoin(asked.withColumnRenamed("v", "w")).select("q", "id", R.max_similarity(F.col("w"), F.col("v")).alias("score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.ranked(plain, "q", "id", 5).collect()))


def test_best_entities(spark):
    """The negatives from each task's best rows equal those from all pairs, with ties, copies of ids and odd vectors; pairs are no rows but for odd vectors."""
    from pyspark.sql import functions as F

    from lodestone.operators import linking, retrieval as R

    rng = np.random.default_rng(6)
    rows = [(i % 290, rng.integers(-2, 3, 3).astype(float).tolist(), int(rng.integers(0, 40))) for i in range(300)]
    rows += [(600, None, 3), (601, [1.0, float("nan"), 0.0], 41), (602, [1.0], 42), (603, [1.0, 1.0, 1.0], None), (604, [9.0, 9.0, 9.0], 5)]
    df = spark.createDataFrame(rows, "id int, v array<double>, e int").repartition(3)
    asked = df.where("id % 7 = 0 OR id = 601").select(F.col("id").alias("q"), "v", F.col("e").alias("gold_id")).dropDuplicates(["q"])
    got = linking.hard_negatives(R.best_entities(df.withColumnRenamed("id", "vec_id").withColumnRenamed("e", "entity_id"), asked, "vec_id", "q", "v", "entity_id", "gold_id", 5), "q", 5)
    pairs = df.crossJoin(asked.withColumnRenamed("v", "w")).select("q", "gold_id", F.col("id").alias("vec_id"), F.col("e").alias("entity_id"), F.round(R.inner_product(F.col("w"), F.col("v")), 9).alias("score"))
    want = linking.hard_negatives(pairs.where("vec_id <> q OR entity_id <> gold_id"), "q", 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_buckets_without_pairs(spark):
    """LSH scores what shares a bucket without a join of pairs."""
    from lodestone.operators import retrieval as R

    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))], "id int, v array<double>")
    asked = df.where("id % 9 = 0").withColumnRenamed("id", "q")
    few = R.lsh_search(df, asked, "id", "q", "v", 200, bits=6, tables=1)
    assert "Join" not in few._jdf.queryExecution().toString()
    planes = np.random.default_rng(3).normal(size=(8, 6))
    codes = {r["id"]: tuple(np.array(r["v"]) @ planes > 0) for r in df.collect()}
    assert {(r["q"], r["id"]) for r in few.collect()} == {(q, i) for q in range(0, 200, 9) for i in codes if codes[i] == codes[q]}


def test_best_is_bounded():
    """Of many blocks some 2 k rows a query are held; ties at the last place go by key."""
    from lodestone.operators.retrieval import Best

    rng = np.random.default_rng(8)
    s = rng.integers(0, 50, (6, 5000)).astype(float)
    held, most = Best(6, 10), 0
    for at in range(0, 5000, 100):
        held.add(s[:, at : at + 100], np.arange(5000 - at, 4900 - at, -1))
        most = max(most, held.held)
    keys = np.arange(5000, 0, -1)
    want = [(q, int(keys[c])) for q in range(6) for c in np.lexsort((keys, -s[q]))[:10]]
    assert [(int(q), int(k)) for q, k in zip(*held.rows()[:2])] == want and most < 6 * 10 * 4 + 600


def test_names_without_a_call_a_document(spark):
    """Spans of one document are told apart across batches, without a group a document and without a join back to the words."""
    from lodestone.operators import multi_search as P

    docs = spark.createDataFrame([(f"d{i}", "a b c " * (i % 5)) for i in range(40)], "doc_key string, text string")
    got = P.names_in_texts(docs, spark.createDataFrame([("a b",), ("b c",), ("c",)], "name string"))
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Join" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == sorted((f"d{i}", 3 * j + a, 3 * j + b, n) for i in range(40) for j in range(i % 5) for a, b, n in ((0, 2, "a b"), (2, 3, "c")))


def test_hub_facts(spark):
    """Facts of a hub and of a plain entity, in a small document and a large one, equal to the plain join."""
    from lodestone.operators import facades

    facts = [("h", "r", f"t{i}") for i in range(50)] + [("p", "s", "t1"), ("p", "s", "p"), ("t1", "r", "h")]
    docs = {"x": ["h", "t3", "t4", "u"], "y": ["p", "t1", "h"] + [f"t{i}" for i in range(20, 90)], "z": []}
    d = spark.createDataFrame([(k, "", [(e,) for e in v]) for k, v in docs.items()], "doc_key string, text string, entities array<struct<entity_id:string>>")
    got = facades.known_relations(d, spark.createDataFrame(facts, "head string, relation string, tail string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, *f) for k, v in docs.items() for f in facts if f[0] in v and f[2] in v and f[0] != f[2])


def test_bm25_without_pairs(spark):
    """The ranking equals that of all pairs' scores, with and without groups and fill; nulls and empty passages too."""
    from pyspark.sql import functions as F

    from lodestone.operators import retrieval as R

    rng = np.random.default_rng(9)
    rows = [(i, [str(w) for w in rng.integers(0, 30, int(rng.integers(0, 12)))], [None, "a", "b", "c"][i % 4]) for i in range(400)] + [(1000, None, "a")]
    p = spark.createDataFrame(rows, "id int, terms array<string>, g string").repartition(3)
    q = spark.createDataFrame([(j, [str(w) for w in rng.integers(0, 32, 4)]) for j in range(6)] + [(9, ["none"]), (10, [])], "q int, terms array<string>")
    best = R._bm25_best(p, q, "id", "q", 7, None)
    assert best.count() <= 3 * 7 * 6 and "Aggregate" not in best._jdf.queryExecution().toString()
    scored = R.bm25_scores(p, q, "id", "q", keep_zero=False)
    shown = lambda df, *c: sorted((r["q"], r["id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    assert shown(R.bm25_search(p, q, "id", "q", 7, fill=False)) == shown(R.ranked(scored, "q", "id", 7))
    assert shown(R.bm25_search(p, q, "id", "q", 7, group="g", fill=False)) == shown(R.ranked(scored.join(p.select("id", "g"), "id"), "q", "id", 7, group=F.col("g")))
    every = q.select("q").crossJoin(p.select("id")).join(scored, ["q", "id"], "left").fillna(0.0, ["score"])
    assert shown(R.bm25_search(p, q, "id", "q", 7)) == shown(R.ranked(every, "q", "id", 7))


def test_two_hop_of_hubs(spark, monkeypatch):
    """Hubs in parts, nodes that meet over several others once, equal to brute force; one neighbour needs no removal of repeats."""
    import random

    from lodestone.operators import graph

    rng = random.Random(4)
    monkeypatch.setattr(graph, "NODES_A_TASK", 3)
    rows = [("hub", "r", f"s{i}") for i in range(20)] + [(f"e{rng.randrange(9)}", "r", f"e{rng.randrange(9)}") for _ in range(25)] + [("e1", "q", "hub"), ("s1", "r", "s1")]
    near = {(a, b) for h, _, t in rows for a, b in ((h, t), (t, h)) if a != b}
    got = [tuple(r) for r in graph.two_hop(spark.createDataFrame(rows, "head string, relation string, tail string")).collect()]
    assert sorted(got) == sorted({(a, d) for a, b in near for c, d in near if b == c and a != d})


def test_vectors_met_without_broadcast(spark, tmp_path):
    """The candidates of a search, small in their files and large in memory, are not sent to the driver to be broadcast."""
    from lodestone.operators.vector_index import VectorIndex

    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(200)], "id int, v array<double>")
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "i"))
    near = spark.createDataFrame([(0, 1, 0)], "n int, key int, list int")
    plan = index._reranked(near, df.limit(1).selectExpr("id AS _q", "v AS _v").collect(), "q", df.schema["id"].dataType)
    plan.collect()
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_scores_by_kind_make_no_pairs(spark):
    """Equal to the scores of the triples that ``intra_inter`` files under the kind; no join is by document alone."""
    from lodestone.operators import metrics as M

    rng = np.random.default_rng(8)
    occ = spark.createDataFrame([(int(d), f"e{e}", int(s)) for d, e, s in zip(rng.integers(0, 9, 200), rng.integers(0, 8, 200), rng.integers(0, 12, 200))] + [(None, "e1", 1), (1, None, 2)], "doc_key int, entity string, sent_idx int")
    made = lambda n: [(int(d), f"e{h}", ["r", "q", None][r], f"e{t}") for d, h, r, t in zip(rng.integers(0, 10, n), rng.integers(0, 9, n), rng.integers(0, 3, n), rng.integers(0, 9, n))]
    pred, gold = (spark.createDataFrame(made(n) + [(None, "e1", "r", "e2"), (1, None, "r", "e2")], "doc_key int, head string, relation string, tail string") for n in (300, 400))
    for kind in ("intra", "inter"):
        pairs = M.intra_inter(occ).where(f"kind = '{kind}'")
        only = lambda df: df.join(pairs, ["doc_key", "head", "tail"], "left_semi")  # noqa: B023, E731
        got = M.relation_scores_by(pred, gold, occ, kind)
        assert got.collect() == M.relation_scores(only(pred), only(gold)).collect() and got.first()["correct"] > 0
        joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert len(joins) == 2 and all("doc_key" in x and ("head" in x or "tail" in x) for x in joins)


def test_pair_questions_in_pieces(spark, monkeypatch):
    """Partitions of pairs grow with the entities; gold may repeat, and pairs are shuffled once."""
    from lodestone.operators import extraction as X

    monkeypatch.setattr(X, "ENTITIES_A_TASK", 20)
    rng = np.random.default_rng(9)
    ids = {(int(d), int(e)): "AB"[int(t)] for d, e, t in zip(rng.integers(0, 30, 150), rng.integers(0, 9, 150), rng.integers(0, 2, 150))}
    e = spark.createDataFrame([(d, i, f"n{i}", t) for (d, i), t in ids.items()], "doc_key int, e_idx int, name string, entity_type string")
    templates = spark.createDataFrame([("r", "@@@HEAD###-@@@TAIL###"), ("q", "@@@TAIL###")], "relation string, template string")
    gold = [(d, a, "r", b) for d in range(30) for a in range(9) for b in range(9) if (a + b) % 3 == 0] * 2 + [(1, 1, None, 2)]
    out = [(d, a, b) for d in range(30) for a in range(4) for b in range(a) if (a + b) % 2]
    frames = spark.createDataFrame(gold, "doc_key int, arg1 int, relation string, arg2 int"), spark.createDataFrame(out, "doc_key int, arg1 int, arg2 int")
    got = X.pair_questions(e, templates, frames[0], [("A", "B")], frames[1])
    pairs = [(d, a, b) for (d, a), s in ids.items() for (f, b), t in ids.items() if d == f and a != b and (s, t) == ("A", "B") and (d, a, b) not in out and (d, b, a) not in out]
    want = [(d, a, r, b, q, "Yes" if (d, a, r, b) in gold else "No") for d, a, b in pairs for r, q in (("r", f"n{a}-n{b}"), ("q", f"n{b}"))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.rdd.getNumPartitions() == 1 + len(ids) // 20
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "Cross" not in x]
    assert len(joins) == 3


def test_postings_stay_with_their_block(spark, tmp_path):
    """Postings equal those of an aggregation over words, with null and empty passages; all of a block lie in one file, and scores need no shuffle but by block."""
    from pyspark.sql import functions as F

    from lodestone.operators.text_index import TextIndex

    rng = np.random.default_rng(10)
    rows = [(i, [f"w{int(w)}" for w in rng.integers(0, 40, int(rng.integers(0, 30)))]) for i in range(500)] + [(500, None), (501, ["é", None, "é"])]
    df = spark.createDataFrame(rows, "id int, terms array<string>").repartition(3)
    index = TextIndex.build(df, "id", str(tmp_path / "index"))
    assert sorted((r["key"], r["len"]) for r in index.passages().collect()) == sorted((i, len(t or [])) for i, t in rows)
    got = index.postings().select("term", F.inline("entries")).select("term", "key", "tf", "len").collect()
    assert sorted(map(tuple, got)) == sorted((w, i, t.count(w), len(t)) for i, t in rows for w in set(t or []) - {None})
    heads = index.postings().select("n", "most", "shortest", "entries").collect()
    assert all((r["n"], r["most"], r["shortest"]) == (len(r["entries"]), max(e["tf"] for e in r["entries"]), min(e["len"] for e in r["entries"])) for r in heads)
    files = index.postings().select("block", F.input_file_name().alias("f")).distinct().groupBy("block").count()
    assert files.count() > 3 and files.where("count > 1").isEmpty()
    asked = spark.createDataFrame([(1, ["w1", "w2"]), (2, ["w3"])], "q int, terms array<string>")
    blocks = index.postings().select("segment", "block").distinct().crossJoin(asked.select("q"))
    plan = index.scores(index.weights(asked, "q"), blocks, "q")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "key#" in x]


def test_turns_of_leiden(spark, monkeypatch):
    """A small graph's turns are one task's, not tables; over tables, whatever the parts, they give the same rows, and so do ids that clash at first and repeated edges."""
    from pyspark.sql import functions as F

    from lodestone.operators import leiden

    rng = np.random.default_rng(9)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 90, (500, 2))]
    df = spark.createDataFrame(pairs, "a string, b string")
    staged = []
    monkeypatch.setattr(leiden, "stage", lambda df, label, stage=leiden.stage: (staged.append(label), stage(df, label))[1])
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(leiden.hierarchy(df, 10))
    assert len(staged) <= 6  # some hundred before
    assert rows(leiden.hierarchy(df.union(df.select("b", "a")).union(df), 10)) == want
    monkeypatch.setattr(leiden, "EDGES_A_ROW", 50)
    monkeypatch.setattr(leiden, "EDGES_A_PART", 300)
    assert rows(leiden.hierarchy(df, 10, at_once=200)) == want
    assert "leiden-moved" in staged
    clash = lambda node, salt: F.xxhash64(node, F.lit(salt)) if salt > 1 else F.length(node).cast("long")
    names, found = leiden._clustered(df.where("a <> b").withColumn("w", F.lit(1.0)), 1.0, 0, 1 << 17, clash)
    assert names.count() == found.count() == names.select("id").distinct().count() == 90


def test_turns_to_the_end(spark):
    """Over tables to the end: the same sets as in one task, and hashes as Spark's."""
    from pyspark.sql import functions as F

    from lodestone.operators import leiden

    edges = [(f"n{i}", f"n{j}", 1.0) for k in range(0, 12, 4) for i in range(k, k + 4) for j in range(i + 1, k + 4)] + [("n0", "n4", 1.0), ("n9", "n9", 2.0)]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    sets = lambda df, c: {frozenset(r["s"]) for r in df.groupBy(c).agg(F.collect_list("node").alias("s")).collect()}
    a, b = leiden.cluster(df), leiden.cluster(df, at_once=-1)
    assert sets(a, "community") == sets(b, "community") and sets(a, F.col("merged")[1]) == sets(b, F.col("merged")[1])
    x = spark.range(50).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(7)).alias("t")).toPandas()
    assert (leiden._hash(x["h"].to_numpy(), 7) == x["t"].to_numpy()).all()


def test_spans_of_a_document_are_not_shuffled(spark, small):
    """Spans are held against the sentences of their own document's row."""
    from pyspark.sql import functions as F

    from lodestone import catalog
    from lodestone.operators import filters

    plan = catalog.queries()["spans_within_sentences"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    spans = [(0, 1), (1, 3), (2, 12), (3, 14), (2, 2), (13, 15), (-1, 0), (5, 4)]
    sentences = [0, 0, *[1] * 12]
    d = spark.createDataFrame([(spans, sentences)], "s array<struct<begin:int,end:int>>, o array<int>")
    got = d.select(F.inline(filters.within_sentences(F.col("s"), F.col("o")))).collect()
    assert [tuple(r) for r in got] == [(0, 1), (2, 12), (2, 2), (5, 4)]


def test_names_do_not_multiply_triples(spark):
    """Scores without known facts join lists of names: rows are multiplied only once alike triples are one."""
    from pyspark.sql import functions as F

    from lodestone.operators import metrics as M

    names = [(d, e, f"{e}{n}") for d in (1, 2, 3) for e in ("a", "b", "c") for n in range(3)] + [(3, "a", None)]
    n = spark.createDataFrame(names, "doc_key int, entity string, name string")
    g = spark.createDataFrame([(1, "a", "r", "b"), (2, "a", "r", "b"), (2, "b", "s", "c"), (3, "c", "r", "a"), (3, "x", "r", "a"), (None, "a", "r", "b")] * 2, "doc_key int, head string, relation string, tail string")
    facts = spark.createDataFrame([("a2", "r", "b0"), ("a1", "r", "b1"), ("c0", "s", "b0")], "head_name string, relation string, tail_name string")
    r = M.unseen_relation_scores(g, g, n, facts).first()
    assert (r["pred"], r["gold"], r["correct"], r["correct_known"]) == (6, 6, 5, 2)
    assert M.named_facts(g, n).count() == 9 + 9 + 12
    assert M._with_names(g, n, "doc_key").count() == 8  # the rows of triples with named ends, each once
    e = F.array(F.lit(0), F.lit(0), F.lit(1))
    o = M.official_scores(g.withColumn("evidences", e), g.withColumn("evidences", F.array(F.lit(1), F.lit(2))), n, facts).first()
    assert (o["pred"], o["gold"], o["correct"], o["correct_known"]) == (6, 6, 5, 2)
    assert round(o["evidence_f1"], 6) == round(100 * 2 * (5 / 12) * (5 / 12) / (5 / 12 + 5 / 12), 6)
