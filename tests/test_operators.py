import random

from pyspark.sql import functions as F

from lodestone.operators import community, extraction as X, filters, graph, kb, linking, metrics as M, questions, reports, retrieval as R


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (900, 901)] + [(1000, 1000 + i) for i in range(50)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(edges, "head long, tail long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert graph.components(spark.createDataFrame([], "head long, tail long")).count() == 0


def test_graph_build(spark):
    docs = spark.createDataFrame([("A", "r", "B", "d1", 0), ("B", "s", "A", "d1", 1)], "head string, relation string, tail string, doc_key string, pos int")
    extra = spark.createDataFrame([("A", "r", "B", 0)], "head string, relation string, tail string, pos int")
    t = graph.ordered_triples(docs, extra)
    nodes = {r["entity_id"]: r for r in graph.build_nodes(t).collect()}
    assert {k: v["doc_key_list"] for k, v in nodes.items()} == {"A": "ExistingKG|d1", "B": "ExistingKG|d1"}
    assert nodes["A"]["entity_type"] == "UNKNOWN" and nodes["A"]["description"] == "NO DESCRIPTION."
    assert {(r["head"], r["relation"]): r["doc_key_list"] for r in graph.build_edges(t).collect()} == {("A", "r"): "ExistingKG|d1", ("B", "s"): "d1"}


def test_document_triples(spark):
    d = spark.createDataFrame([("d", [("x",), ("y",)], [(1, "r", 0)])], "doc_key string, entities array<struct<entity_id:string>>, relations array<struct<arg1:int,relation:string,arg2:int>>")
    assert [tuple(r) for r in graph.triples_of_documents(d).collect()] == [("y", "r", "x", "d", 0)]


def test_communities(spark):
    e = spark.createDataFrame([("A", "r", "B"), ("C", "s", "A")], "head string, relation string, tail string")
    got = {r["community_id"]: r for r in community.flat_records(community.neighbourhood_members(e)).collect()}
    assert got["Community(A)"]["nodes"] == ["A", "B", "C"] and got["Community(B)"]["nodes"] == ["A", "B"]
    assert got["ROOT"]["nodes"] is None and len(got["ROOT"]["child_community_ids"]) == 3


def test_degrees(spark):
    e = spark.createDataFrame([("A", "r", "B"), ("A", "s", "B"), ("A", "t", "A")], "head string, relation string, tail string")
    assert {r[0]: r[1] for r in graph.degrees(e).collect()} == {"A": 4, "B": 2}


def test_hierarchy(spark):
    rng = random.Random(2)
    pairs = [(f"n{a:02}", f"n{b:02}") for g in range(4) for a in range(g * 12, g * 12 + 12) for b in range(a + 1, g * 12 + 12) if rng.random() < 0.5] + [("n00", "n12"), ("n12", "n24"), ("n24", "n36")]
    e = spark.createDataFrame([(a, "r", b) for a, b in pairs], "head string, relation string, tail string")
    rec = [r for r in community.hierarchical_records(e, 10).collect() if r["community_id"] != "ROOT"]
    parents = {r["parent_community_id"] for r in rec}
    assert all(len(r["nodes"]) <= 10 for r in rec if r["community_id"] not in parents)
    top = [r for r in rec if r["level"] == 0]
    assert sorted(v for r in top for v in r["nodes"]) == sorted({v for p in pairs for v in p})
    by = {r["community_id"]: r for r in rec}
    for r in rec:
        if r["level"]:
            assert set(r["nodes"]) <= set(by[r["parent_community_id"]]["nodes"])


def test_large_communities_are_cut_by_degree(spark):
    e = spark.createDataFrame([("hub", "r", f"x{i:03}") for i in range(150)], "head string, relation string, tail string")
    t = e.selectExpr("*", "'d' AS doc_key", "struct(0 AS part, cast(0 AS bigint) AS pos) AS ingest")
    m = community.neighbourhood_members(e).where("community_id = 'Community(hub)'")
    text = reports.template_reports(m, graph.build_nodes(t), graph.build_edges(t)).first()["text"]
    assert text.count("\n- ") + text.startswith("- ") == 100 + 99 and "- hub | UNKNOWN" in text


def test_parse_report(spark):
    s = spark.range(1)
    good = '{"title": "T", "summary": "S", "findings": [{"summary": "a", "explanation": "b"}]}'
    assert tuple(s.select(reports.parse_report(F.lit("Sure: " + good)).alias("x")).first()[0]) == ("T", "S\n\n[Finding 1] a: b")
    assert tuple(s.select(reports.parse_report(F.lit("plain")).alias("x")).first()[0]) == ("No Title", "plain")


def test_entity_aggregation(spark):
    m = spark.createDataFrame([("d", 0, "a", "P", "x"), ("d", 1, "b", "Q", "y"), ("d", 2, "c", "R", "x")], "doc_key string, m_idx int, name string, entity_type string, entity_id string")
    got = [tuple(r)[1:] for r in linking.aggregate_mentions(m).orderBy("e_idx").collect()]
    assert got == [(0, "x", "P", [0, 2], ["a", "c"]), (1, "y", "Q", [1], ["b"])]


def test_ranked_dedup(spark):
    s = spark.createDataFrame([("q", 0, "A", 3.0), ("q", 1, "A", 2.0), ("q", 2, "B", 1.0), ("q", 3, None, 0.5)], "q string, k int, e string, score double")
    assert [(r["e"], r["score"], r["rank"]) for r in R.ranked(s, "q", "k", 2, group=F.col("e")).orderBy("rank").collect()] == [("A", 3.0, 1), ("B", 1.0, 2)]


def test_bm25_edges(spark):
    p = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["b"])], "id int, terms array<string>")
    q = spark.createDataFrame([("x", ["zz"]), ("y", ["a", "a"])], "q string, terms array<string>")
    got = [tuple(r) for r in R.bm25_search(p, q, "id", "q", 2).orderBy("q", "rank").collect()]
    assert [g[:2] for g in got] == [("x", 1), ("x", 2), ("y", 1), ("y", 2)] and got[0][2] == 0.0 and got[2][2] > 0
    idf = {r["term"]: r["idf"] for r in R.document_frequencies(R.term_frequencies(p, "id", F.col("terms")), 3).collect()}
    assert idf["b"] == 0.0 and idf["a"] > 0


def test_vector_search_blocks_and_recall(spark, small):
    corpus = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    asked = corpus.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q")
    exact = {(r["q"], r["vec_id"]) for r in R.vector_search(corpus, asked, "vec_id", "q", "embedding", 10).collect()}
    assert exact == {(r["q"], r["vec_id"]) for r in R.vector_search(corpus, asked, "vec_id", "q", "embedding", 10, block=3).collect()}
    near = {(r["q"], r["vec_id"]) for r in R.lsh_search(corpus, asked, "vec_id", "q", "embedding", 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_vectors(spark):
    s = spark.range(1)
    v = F.lit([3.0, 4.0])
    assert s.select(R.normalized(v).alias("x")).first()[0] == [0.6, 0.8]
    assert s.select(R.mean_pool(F.array(v, F.lit([1.0, 0.0]))).alias("x")).first()[0] == [2.0, 2.0]
    assert s.select(R.max_similarity(F.array(v), F.array(F.lit([1.0, 0.0]), F.lit([0.0, 1.0]))).alias("x")).first()[0] == 4.0
    assert len(s.select(R.hashed_encoder(F.lit(["a", "b"]), 16).alias("x")).first()[0]) == 16


def test_metrics(spark):
    found = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "q string, d int, rank int")
    queries = spark.createDataFrame([("q",)], "q string")
    gold = spark.createDataFrame([("q", 2), ("q", 3)], "q string, d int")
    assert M.reciprocal_ranks(found, gold, queries, "q", "d").first()["rr"] == 0.5
    assert abs(M.average_precisions(found, gold, queries, "q", "d").first()["ap"] - (1 / 2 + 2 / 3) / 2) < 1e-9
    one = gold.where("d = 2")
    assert abs({r["k"]: r["ndcg"] for r in M.ndcg_at_k(found, one, queries, "q", "d", (2,)).collect()}[2] - 0.63093) < 1e-4
    assert M.average_precisions(found, gold.where("d = 9"), queries, "q", "d").first()["ap"] == 0.0


def test_span_metrics(spark):
    schema = "doc_key string, begin int, end int, entity_type string"
    p = spark.createDataFrame([("d", 1, 2, "T"), ("d", 3, 4, "T")], schema)
    g = spark.createDataFrame([("d", 2, 3, "T"), ("d", 5, 6, "T")], schema)
    r = M.overlap_scores(p, g).first()
    assert (r["precision"], r["recall"]) == (100.0, 50.0)
    empty = M.span_scores(p.where("begin > 9"), g.where("begin > 9")).first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0.0, 0.0, 0.0)


def test_unseen_precision(spark):
    t = lambda rows: spark.createDataFrame(rows, "doc_key string, head string, relation string, tail string")
    pred, gold = t([("d", a, "r", "z") for a in "abcx"]), t([("d", a, "r", "z") for a in "abc"])
    names = spark.createDataFrame([("d", a, a) for a in "abcxz"], "doc_key string, entity string, name string")
    facts = spark.createDataFrame([("a", "r", "z")], "head_name string, relation string, tail_name string")
    r = M.unseen_relation_scores(pred, gold, names, facts).first()
    assert abs(r["precision"] - 200 / 3) < 1e-9 and r["recall"] == 100.0


def test_adaptive_threshold(spark):
    x = lambda v, k=-1: spark.range(1).select(X.adaptive_labels(F.lit(v), k).alias("x")).first()[0]
    assert x([0.5, 0.7, 0.1]) == [0, 1, 0] and x([0.9, 0.7, 0.1]) == [1, 0, 0]
    assert x([0.0, 0.7, 0.6, 0.5], 2) == [0, 1, 1, 0]


def test_bio(spark):
    tags = ["B-PER", "I-PER", "O", "B-LOC", "B-LOC"]
    t = spark.createDataFrame([("d", i, x) for i, x in enumerate(tags)], "doc_key string, idx int, tag string")
    assert [tuple(r)[1:] for r in X.bio_spans(t).orderBy("begin").collect()] == [(0, 1, "PER"), (3, 3, "LOC"), (4, 4, "LOC")]


def greedy(spans, nested):
    out = []
    for s in sorted(spans, key=lambda s: (-s[3], s[0], s[1], s[2])):
        def bad(a):
            if nested:
                return s[0] < a[0] <= s[1] < a[1] or a[0] < s[0] <= a[1] < s[1]
            return a[0] <= s[1] and s[0] <= a[1]
        if not any(bad(a) for a in out):
            out.append(s)
    return sorted(s[:3] for s in out)


def test_span_selection(spark):
    rng = random.Random(1)
    cases = [[(b, b + rng.randrange(4), rng.choice("AB"), rng.random()) for b in (rng.randrange(20) for _ in range(12))] for _ in range(20)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<struct<begin:int,end:int,entity_type:string,score:double>>")
    for nested in (False, True):
        got = {r[0]: [tuple(x) for x in r[1]] for r in df.select("i", X.select_spans(F.col("s"), nested)).collect()}
        assert got == {i: greedy(c, nested) for i, c in enumerate(cases)}


def test_named_mentions(spark):
    d = spark.createDataFrame([("d", ["New York is big.", "New", "York new  york."], "- new york | City\n- NewYork | Town\nbad")], "doc_key string, sentences array<string>, generated_text string")
    got = sorted(tuple(r)[1:] for r in X.mentions_from_answers(d, {"city": "LOC"}).collect())
    assert got == [(0, 1, "New York", "LOC"), (0, 1, "New York", "Town")]


def test_linked_lines(spark):
    g = spark.createDataFrame([("d", [(0, "A b"), (1, "C")], ["x", "y"], "- ab | x\n- C | bad"), ("e", [(0, "A b"), (1, "C")], ["x"], "- a  B | x")], "doc_key string, mentions array<struct<m_idx:int,name:string>>, candidate_ids array<string>, generated_text string")
    assert sorted(tuple(r) for r in X.links_from_answers(g).collect()) == [("d", 0, "x"), ("d", 1, "NO-PRED"), ("e", 0, "x"), ("e", 1, "NO-PRED")]


def test_distant_and_pairs(spark):
    o = spark.createDataFrame([("d", "u", 0), ("d", "v", 0), ("d", "w", 1)], "doc_key string, entity string, sent_idx int")
    facts = spark.createDataFrame([("u", "r1", "v"), ("u", "r2", "v"), ("u", "r1", "w")], "head string, relation string, tail string")
    assert sorted(tuple(r) for r in X.distant_triples(o, facts).collect()) == [("d", "u", "r1", "v"), ("d", "u", "r2", "v")]
    e = spark.createDataFrame([("d", 0, "A"), ("d", 1, "B")], "doc_key string, e_idx int, entity_type string")
    ex = spark.createDataFrame([("d", 1, 0)], "doc_key string, arg1 int, arg2 int")
    assert filters.entity_pairs(e).count() == 2 and filters.entity_pairs(e, [("A", "B")]).count() == 1 and filters.entity_pairs(e, None, ex).count() == 0


def test_relation_mapping(spark):
    t = spark.createDataFrame([("h", "a", "t"), ("h", "b", "t"), ("t", "c", "h")], "head string, relation string, tail string")
    m = spark.createDataFrame([("a", "targets#inverse"), ("b", "x#negative"), ("c", "targets")], "relation string, label string")
    assert [tuple(r) for r in kb.mapped_relations(t, m).collect()] == [("t", "targets", "h")]
    import pytest

    with pytest.raises(Exception, match="no mapping"):
        kb.mapped_relations(t, m.where("relation <> 'a'")).collect()


def test_negatives(spark):
    s = spark.createDataFrame([("q", "g", 1, "g", 0.5), ("q", "g", 2, "a", 0.9), ("q", "g", 3, "b", 0.1), ("q", "g", 4, "a", 0.2)], "q string, gold_id string, vec_id int, entity_id string, score double")
    first = linking.hard_negatives(s, "q", 5)
    assert [tuple(r)[1:] for r in first.orderBy("rank").collect()] == [("a", 1, 1), ("b", 2, 2)]
    pool = spark.createDataFrame([("q", x) for x in "abcd"], "q string, entity_id string")
    assert {r["entity_id"] for r in linking.fill_negatives(first, pool, "q", 4).collect()} == set("abcd")


def test_question_patterns(spark):
    e = spark.createDataFrame([("a", "r", "x"), ("a", "r", "y"), ("a", "r", "a"), ("x", "s", "p"), ("x", "s", "q")], "head string, relation string, tail string")
    got = questions.neighbourhood(e, {"r": "What of {target}?"}).collect()
    assert [(r["node"], r["question"], r["answers"]) for r in got] == [("a", "What of a?", ["x", "y"])]
    two = {(r["node"], r["relation1"], r["relation2"]): r["answers"] for r in questions.two_hop(e).collect()}
    assert two[("a", "r", "s")] == ["p", "q"]


def intersections(edges):
    """All pairs of nodes that share two neighbours or more under a relation, each having others too."""
    near = {}
    for h, r, t in edges:
        if h != t:
            near.setdefault((r, h), set()).add(t)
            near.setdefault((r + "#inverse", t), set()).add(h)
    out = {}
    for (r, a), x in near.items():
        for (s, b), y in near.items():
            k = x & y
            if r == s and a < b and len(k) >= 2 and len(x) > len(k) and len(y) > len(k):
                out[a, b, r] = sorted(k)
    return out


def test_intersections_with_hot_neighbours(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(questions, "NODES_A_TASK", 16)
    edges = [(f"s{rng.randrange(40)}", rng.choice(["r", "q"]), f"p{rng.randrange(60)}") for _ in range(600)] + [(f"s{i}", "r", "hot") for i in range(40)] + [("hot", "r", "hot")]
    got = {(r["node_a"], r["node_b"], r["relation"]): r["answers"] for r in questions.intersection(spark.createDataFrame(edges, "head string, relation string, tail string")).collect()}
    assert got == intersections(edges)


def test_intersections_in_blocks(spark, monkeypatch):
    """Several parts, a few pairs at once, names whose order is not that of their numbers; pairs by shared neighbour are no rows."""
    rng = random.Random(10)
    for name, value in (("PARTS", 3), ("EDGES_MORE", 50), ("EDGES_A_PART", 200), ("PAIRS_AT_ONCE", 30), ("NODES_A_TASK", 4)):
        monkeypatch.setattr(questions, name, value)
    edges = [(f"s{rng.randrange(120)}", rng.choice("rq"), f"é{rng.randrange(90)}") for _ in range(900)] + [("a", None, "b"), ("a", "r", None), ("s1", "t", "s2"), ("s2", "t", "s1")]
    found = questions.intersection(spark.createDataFrame(edges, "head string, relation string, tail string"))
    assert {(r["node_a"], r["node_b"], r["relation"]): r["answers"] for r in found.collect()} == intersections([e for e in edges if None not in e])
    assert "node_a" not in found._jdf.queryExecution().optimizedPlan().children().head().toString()


def test_intersections_of_all_triples(spark, small):
    from lodestone.catalog import queries
    from lodestone.queries.graphs import triples

    want = intersections([tuple(r) for r in triples(spark, small).select("head", "relation", "tail").distinct().collect()])
    got = {(r["node_a"], r["node_b"], r["relation"]): r["answers"] for r in queries()["questions_intersection_whole"](spark, small).collect()}
    assert got == {k: "|".join(v) for k, v in want.items()}


def test_answer_kinds(spark):
    df = spark.createDataFrame([("list", [["a", "b"], ["c"]], "i"), ("summary", None, "i")], "k string, exact array<array<string>>, ideal string")
    got = [[tuple(x) for x in r[0]] for r in df.select(filters.answers_of_type(F.col("k"), F.col("exact"), F.col("ideal"))).collect()]
    assert got == [[("a", "list", 0), ("b", "list", 0), ("c", "list", 1)], [("i", "summary", 0)]]


def test_parts_are_packed():
    """The edges of a part take a few bytes each and come out as they went in."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import questions

    rng = np.random.default_rng(1)
    edges = np.unique(rng.integers(0, [300, 3_000], (60_000, 2)), axis=0)
    rng.shuffle(edges)
    nodes, hubs = pa.array([f"S{a}" for a in edges[:, 0]]), pa.array([f"P{b}" for b in edges[:, 1]])
    part = questions._packed(nodes, hubs, edges[:, 0] % 7)
    assert len(part) < 4 * len(edges)
    names, n, a, held, b = questions._unpacked(part)
    assert sorted(zip(names.take(pa.array(a)).to_pylist(), held.take(pa.array(b)).to_pylist(), strict=True)) == sorted(zip(nodes.to_pylist(), hubs.to_pylist(), strict=True))
    assert all(k == int(s[1:]) % 7 for s, k in zip(names.to_pylist(), n, strict=True))


def test_python_lists(spark):
    assert spark.range(1).select(kb.python_list(F.lit("""['a', "b's", 'c\\'d']""")).alias("x")).first()[0] == ["a", "b's", "c'd"]


def test_scorer(spark):
    def double(batches):
        for b in batches:
            yield b.assign(score=b["x"] * 2.0)

    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert sorted(r["score"] for r in X.scored(df, double, "x int, score double").collect()) == [2.0, 4.0]
    made = X.generated(df, F.concat(F.lit("p"), "x"), lambda p: F.upper(p)).orderBy("x").collect()
    assert [r["generated_text"] for r in made] == ["P1", "P2"]
    assert X.pipeline(df, lambda d: d.where("x > 1")).count() == 1
