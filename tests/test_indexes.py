"""Saved indexes, edit-distance search and Leiden clustering against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import edit_search, leiden, linking, retrieval as R
from lodestone.operators.text_index import TextIndex
from lodestone.operators.vector_index import VectorIndex
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def best(asked, points, k, metric="ip"):
    s = asked @ points.T
    if metric == "l2":
        s = 1 / (1 + ((asked[:, None, :] - points[None]) ** 2).sum(2))
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_vector_index(spark, tmp_path, metric, capsys):
    """Recall at 10 and the share scored exactly, on clustered and on shapeless vectors; load and append."""
    rng = np.random.default_rng(3)
    for kind in ("clustered", "shapeless"):
        base = rng.normal(size=(60, 32))
        points = base[rng.integers(60, size=4000)] + 0.4 * rng.normal(size=(4000, 32)) if kind == "clustered" else rng.normal(size=(4000, 32))
        points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id int, v array<float>")
        where = str(tmp_path / kind)
        VectorIndex.build(df.where("id < 3500"), "id", "v", where, metric=metric)
        index = VectorIndex.load(spark, where)
        for _ in range(2):  # a repeated append changes nothing
            index.append(df.where("id >= 3500"), "id", "v", "more")
        assert index.rows().count() == 4000
        asked = df.where("id % 50 = 0").select(F.col("id").alias("q"), "v")
        want = best(points[::50], points, 10, metric)
        got = {(r["q"], r["id"]) for r in index.search(asked, "q", "v", 10).collect()}
        recall = np.mean([(50 * i, int(j)) in got for i, row in enumerate(want) for j in row])
        most = max(40, math.ceil(index.share * 4000))
        with capsys.disabled():
            print(f"\n{kind} {metric}: recall {recall:.3f}, {index.probes} of {len(index.quantizer.centroids)} lists probed, {most / 4000:.3f} of the rows scored")
        assert recall >= 0.9 and most <= 400
        exact = {(r["q"], r["id"]): r["score"] for r in R.vector_search(df, asked, "id", "q", "v", 10, metric=metric).collect()}
        close = {(r["q"], r["id"]): r["score"] for r in index.search(asked, "q", "v", 10).collect()}
        assert all(abs(exact[p] - s) < 1e-6 for p, s in close.items() if p in exact)


def test_vector_index_odd_rows(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(100, None), (101, [1.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 1.0]), (104, []), (5, [5.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>").withColumn("list", F.lit("clash")).withColumn("key", F.lit(1))
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "i"))
    assert index.rows().count() == 61
    asked = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [float("nan"), 0.0, 0.0])], "q string, v array<float>")
    got = index.search(asked, "q", "v", 3).collect()
    assert {r["q"] for r in got} == {"a"} and len(got) == 3 and {r["id"] for r in got} == {6, 13, 20}
    assert index.search(asked.limit(0), "q", "v", 3).collect() == []
    doubled = index.search(spark.createDataFrame([("e", [5.0, 1.0, 2.0])], "q string, v array<float>"), "q", "v", 61, rerank=200).where("id = 5").collect()
    assert len(doubled) == 2  # rows of one key are rows of their own
    with pytest.raises(ValueError):
        VectorIndex.build(df.limit(0), "id", "v", str(tmp_path / "none"))


def test_exact_vector_search_skips_what_it_cannot_compare(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id int, v array<float>")
    got = R.vector_search(df, df.select(F.col("id").alias("q"), "v"), "id", "q", "v", 5).collect()
    assert sorted((r["q"], r["id"]) for r in got) == [(1, 1), (1, 3), (3, 1), (3, 3)]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    # Neighbouring passages lean to words of their own.
    lean = lambda i: [1 / (k + 1) + (2 if k % 30 == i * 30 // n else 0) for k in range(300)]
    return [(i, rng.choices(words, weights=lean(i), k=rng.choice([0, 3, 10, 60, 200]))) for i in range(n)]


def test_text_index(spark, tmp_path, capsys):
    """The rows of a search without an index, whatever the segments; blocks are passed over; a repeated append changes nothing."""
    df = spark.createDataFrame(corpus(1, 3000) + [(5000, None)], "id int, terms array<string>").withColumn("key", F.lit(0)).withColumn("len", F.lit("x"))
    rng = random.Random(2)
    asked = spark.createDataFrame([(f"q{i}", [f"w{k}" for k in rng.sample([k for k in range(20, 310) if k % 30 == i], min(10, rng.choice([1, 2, 4, 9])))]) for i in range(30)] + [("none", ["zzz"]), ("empty", []), ("null", None)], "q string, terms array<string>")
    where = str(tmp_path / "index")
    TextIndex.build(df.where("id < 1000"), "id", where)
    index = TextIndex(spark, where)
    for _ in range(2):
        index.append(df.where("id >= 1000"), "id", segment="more")
    for fill in (True, False):
        want = [(r["q"], r["id"], round(r["score"], 8), r["rank"]) for r in R.bm25_search(df.withColumn("terms", F.coalesce("terms", F.array())), asked, "id", "q", 10, fill=fill).collect()]
        got = [(r["q"], r["id"], round(r["score"], 8), r["rank"]) for r in index.search(asked, "q", 10, fill=fill).collect()]
        assert sorted(got) == sorted(x for x in want if fill or x[2] > 0)
    _, blocks, _ = index.top_blocks(asked, "q", 10)
    all_, read = blocks.count(), blocks.where("read").count()
    with capsys.disabled():
        print(f"\n{read} of {all_} blocks read")
    assert read < 0.5 * all_


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def names(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(rng.choice(out)) if out and rng.random() < 0.6 else rng.choices("abcdéñ 😀", k=rng.choice([0, 1, 2, 5, 9, 14]))
        for _ in range(rng.choice([0, 1, 2, 4])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice([[], ["a"], ["z"]])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_edit_search(spark, k):
    texts, asked = names(1, 250) + ["a" * 300], names(2, 40) + ["something quite far from all", "a" * 290, ""]
    p = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "id int, t string")
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)] + [(900, None)], "q int, x string")
    steps = []
    out = edit_search.string_search(p, q, "id", "q", "t", "x", k, counted=lambda name, pairs: steps.append((name, pairs.count())))
    got = sorted((r["q"], r["rank"], r["id"]) for r in out.collect())
    want = []
    for i, x in enumerate(asked):
        order = sorted(range(len(texts)), key=lambda j: (edits(x, texts[j]), j))[:k]
        want += [(i, r + 1, j) for r, j in enumerate(order)]
    assert got == sorted(want)
    assert "NestedLoop" not in plan(out) and "CartesianProduct" not in plan(out)
    # The close round meets a small part of all pairs.
    assert dict(steps)["radius 1"] < 0.2 * len(set(texts)) * len(set(asked))


def test_pigeonhole_loses_nothing(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choices("ab", k=rng.randrange(0, 9))) for _ in range(150)})
    t = spark.createDataFrame([(x, 1) for x in texts], "_t string, _held bigint")
    for r in (1, 2, 3):
        met = {(x["_q"], x["_t"]) for x in edit_search.near_candidates(t.select(F.col("_t").alias("_q")), t, r).collect()}
        assert {(a, b) for a in texts for b in texts if edits(a, b) <= r} <= met


def test_string_links_count_entities(spark):
    """The k nearest entities, not names: one with many close names counts once."""
    d = spark.createDataFrame([("E1", "aaaa", ["aaab", "aaac", "aaad"], None), ("E2", "aabb", [], None), ("E3", "zzzzzz", None, None)], "entity_id string, canonical_name string, synonyms array<string>, description string")
    p = linking.dictionary_passages(d).withColumn("passage_id", F.concat("entity_id", F.lit("#"), "name_idx"))
    m = spark.createDataFrame([("d", 0, "AAAA")], "doc_key string, m_idx int, name string")
    got = linking.lexical_candidates(m, p, None, 3, method="levenshtein").orderBy("rank").collect()
    assert [r["entity_id"] for r in got] == ["E1", "E2", "E3"]


def score(pairs, of):
    m, degree, inside = len(pairs), Counter(), 0
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        inside += of[a] == of[b]
    held = Counter()
    for v, d in degree.items():
        held[of[v]] += d
    return inside / m - sum(d * d for d in held.values()) / (4 * m * m)


def greedy(pairs):
    """Local moving on one machine until no move gains."""
    near, degree = {}, Counter()
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
        degree[a] += 1
        degree[b] += 1
    of, two_m = {v: v for v in near}, 2 * len(pairs)
    held, moved = Counter(degree), True
    while moved:
        moved = False
        for v in sorted(near):
            links = Counter(of[u] for u in near[v])
            held[of[v]] -= degree[v]
            to = max(sorted({*links, of[v]}), key=lambda c: links[c] - held[c] * degree[v] / two_m)
            if links[to] - held[to] * degree[v] / two_m > links[of[v]] - held[of[v]] * degree[v] / two_m + 1e-12:
                of[v], moved = to, True
            held[of[v]] += degree[v]
    return of


def graphs():
    rng = random.Random(2)
    planted = [(f"n{a:02}", f"n{b:02}") for g in range(5) for a in range(g * 12, g * 12 + 12) for b in range(a + 1, g * 12 + 12) if rng.random() < 0.5]
    planted += [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30, 60):02}") for _ in range(12)]
    loose = [(f"x{rng.randrange(40):02}", f"x{rng.randrange(40):02}") for _ in range(90)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 24:02}") for i in range(24)]
    star = [("hub", f"s{i:02}") for i in range(25)]
    out = {"planted": planted, "loose": loose, "ring": ring, "star": star}
    return {k: sorted({(min(p), max(p)) for p in v if p[0] != p[1]}) for k, v in out.items()}


@pytest.mark.parametrize("name", ["loose", "planted"])
def test_leiden(spark, name):
    """Connected communities, of at least the modularity of local moving on one machine."""
    pairs = graphs()[name]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, w double")
    got = leiden.cluster(df)
    rows = got.collect()
    of = {r["node"]: r["community"] for r in rows}
    for step in range(len(rows[0]["merged"])):  # merged sets lie within communities, and within each other
        sets = {}
        for r in rows:
            sets.setdefault(r["merged"][step], set()).add((r["community"], *r["merged"][step:]))
        assert all(len(x) == 1 for x in sets.values())
    assert set(of) == {v for p in pairs for v in p}
    near = {v: {u for p in pairs if v in p for u in p if of[u] == of[v]} for v in of}
    for c in set(of.values()):
        inside = {v for v in of if of[v] == c}
        seen, todo = set(), [min(inside)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += near[v]
        assert seen == inside
    assert score(pairs, of) >= score(pairs, greedy(pairs)) - 1e-9
    q = leiden.modularity(df.select("a", "b"), got)
    assert abs(q - score(pairs, of)) < 1e-9


def test_hierarchy_of_parts(spark):
    pairs = [p for k in ("planted", "ring", "star") for p in graphs()[k]] + [("alone", "alone"), ("n00", None)]
    rows = leiden.hierarchy(spark.createDataFrame(pairs, "a string, b string"), 10).collect()
    nodes = {v for p in pairs[:-2] for v in p}
    members = {}
    for r in rows:
        members.setdefault((r["level"], r["community_id"], r["parent_community_id"]), set()).add(r["node"])
    by = {c: vs for (_, c, _), vs in members.items()}
    assert len(by) == len(members)
    top = [vs for (level, _, p), vs in members.items() if p is None]
    assert sorted(v for vs in top for v in vs) == sorted(nodes) and all(level == 0 for (level, _, p) in members if p is None)
    parents = {p for (_, _, p) in members}
    for (level, c, p), vs in members.items():
        assert len(vs) <= 10 or c in parents
        if p is not None:
            assert vs < by[p]
    for p in parents - {None}:
        kids = [vs for (_, _, q), vs in members.items() if q == p]
        assert sorted(v for vs in kids for v in vs) == sorted(by[p])


def test_index_queries(spark):
    from lodestone.queries import indexes

    asked = indexes.vectors(spark, SMALL)[1].count()
    assert indexes.vector_index_topk(spark, SMALL).count() == 10 * asked


def test_late_index(spark, tmp_path, capsys):
    """Recall at 10 against all passages, and the share of passages that was scored."""
    from lodestone.operators.late_index import LateIndex

    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    tokens = base[rng.integers(40, size=(1500, 4))] + 0.5 * rng.normal(size=(1500, 4, 16))
    tokens = (tokens / np.linalg.norm(tokens, axis=2, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(tokens)] + [(9000, None), (9001, []), (9002, [[1.0], None])], "id int, v array<array<float>>")
    LateIndex.build(df.where("id % 2 = 0"), "id", "v", str(tmp_path / "late"), metric="ip")
    index = LateIndex(spark, str(tmp_path / "late"))
    for _ in range(2):
        index.append(df.where("id % 2 = 1"), "id", "v", "odd")
    asked = df.where("id % 50 = 0 AND id < 1500").select(F.col("id").alias("q"), "v")
    full = np.einsum("qid,pjd->qpij", tokens[::50], tokens).max(3).sum(2)
    want = np.argsort(-full, axis=1, kind="stable")[:, :10]
    rows = index.search(asked, "q", "v", 10).collect()
    got = {(r["q"], r["key"]) for r in rows}
    recall = np.mean([(50 * i, int(j)) in got for i, row in enumerate(want) for j in row])
    share = index.candidates(asked, "q", "v", 256, 100).count() / (len(want) * 1500)
    with capsys.disabled():
        print(f"\nlate interaction: recall {recall:.3f}, {share:.3f} of the passages scored")
    assert recall >= 0.9 and share < 0.1
    assert all(abs(full[r["q"] // 50, r["key"]] - r["score"]) < 1e-4 for r in rows)
