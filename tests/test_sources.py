import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import corpora, graphml, readers, sinks
from lodestone.sources.graph_store import GraphStore
from lodestone.sources.parts import in_file_order, numbered


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_and_lines(spark, tmp_path):
    p = put(tmp_path / "a.json", json.dumps([{"title": "t", "text": "x"}, {"text": "y"}], indent=4))
    assert sorted((r["title"] or "", r["text"]) for r in readers.read_json(spark, p, readers.PASSAGE).collect()) == [("", "y"), ("t", "x")]
    p = put(tmp_path / "b.txt", " a \nb\n")
    assert [r[0] for r in readers.read_lines(spark, p).collect()] == ["a", "b"]
    rows = [(k, f"é\n{k}" if k % 3 else None) for k in range(50, 0, -1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for of, some in (("many", rows), ("one", rows[:1]), ("none", [])):
        sinks.write_json_array(spark.createDataFrame(some, "k int, v string").repartition(3), str(tmp_path / of), ["k"])
        parts = [json.loads(p.read_text(encoding="utf-8")) for p in sorted((tmp_path / of).glob("part-*")) if p.stat().st_size]
        assert [x for p in parts for x in p] == [{"k": k, "v": v} for k, v in sorted(some)]
        assert len(parts) > 1 or of != "many"
        assert sorted(tuple(r) for r in readers.read_json(spark, str(tmp_path / of), "k int, v string").collect()) == sorted(some)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_vocabulary(spark, tmp_path):
    v = readers.vocabulary(spark.createDataFrame([("b",), ("a",), ("b",)], "w string"), "w", "NONE")
    assert [tuple(r) for r in v.orderBy("id").collect()] == [("NONE", 0), ("a", 1), ("b", 2)]
    sinks.write_vocabulary(v, str(tmp_path / "v"))
    assert {r["word"]: r["id"] for r in readers.read_vocabulary(spark, str(tmp_path / "v")).collect()} == {"NONE": 0, "a": 1, "b": 2}
    with pytest.raises(Exception, match="fields"):
        readers.read_vocabulary(spark, put(tmp_path / "bad", "a\n")).collect()


def test_tables(spark, tmp_path):
    p = put(tmp_path / "x.rrf", 'C1|a "q|\nC2||\n')
    assert [tuple(r) for r in readers.read_rrf(spark, p, ["CUI", "STR"]).collect()] == [("C1", 'a "q'), ("C2", None)]
    p = put(tmp_path / "x.tsv", "id\ttext\ttitle\n1\tabc\tT\n")
    assert tuple(readers.read_wiki_passages(spark, p).first()) == ("1", "abc", "T")
    p = put(tmp_path / "y.tsv", "q\t['a', 'b']\n")
    assert readers.read_python_lists(spark, p, ["q", "answers"], ["answers"]).first()["answers"] == ["a", "b"]
    (tmp_path / "t" / "AA").mkdir(parents=True)
    put(tmp_path / "t" / "AA" / "w_00", '{"id": "1", "title": "T", "text": "x"}\n')
    r = readers.read_article_tree(spark, str(tmp_path / "t")).first()
    assert r["title"] == "T" and r["source_file"].endswith("w_00")


def test_questions(spark, tmp_path):
    p = put(tmp_path / "q.json", json.dumps([{"question_key": "k", "question": "?", "answers": [{"answer": "a", "answer_type": "list", "answer_index": 3}]}]))
    assert readers.read_questions(spark, p).first()["answers"][0]["list_index"] == 3


def test_templates(spark, tmp_path):
    assert "{test_case_prompt}" in readers.prompt_template("question")
    assert readers.prompt_template(put(tmp_path / "t.txt", "a\nb"), spark) == "a\nb"


def test_graphml(spark, tmp_path):
    """A round trip over several parts, each a document of its own; odd characters, nulls, an empty graph."""
    from xml.etree import ElementTree

    nodes = spark.createDataFrame([("A", "T", 'a < b & "c"', "d\n\te", "k1|k2"), ("B", "T", "b", None, "k1")] + [(f"n{i}", "T", f"é{i}", "", "k") for i in range(40)], graphml.NODE)
    edges = spark.createDataFrame([("A", "r", "B", "k1"), ("A", "s>", "B", "k2")], "head string, relation string, tail string, doc_key_list string")
    p = str(tmp_path / "g")
    for _ in range(2):  # written again, it is the same
        graphml.write_graphml(nodes.repartition(3), edges, p)
    parts = sorted((tmp_path / "g").glob("part-*"))
    assert len(parts) > 2 and all(ElementTree.parse(x).getroot().tag.endswith("graphml") for x in parts)
    n, e = graphml.read_graphml(spark, p)
    assert sorted((r[0], r[2]) for r in n.collect()) == sorted((r[0], r[2]) for r in nodes.collect())
    assert sorted((r[0], r[3] or "") for r in n.collect()) == sorted((r[0], r[3] or "") for r in nodes.collect())
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.collect()))
    graphml.write_graphml(nodes.limit(0), edges.limit(0), str(tmp_path / "none"))
    assert [x.count() for x in graphml.read_graphml(spark, str(tmp_path / "none"))] == [0, 0]


def test_numbers_in_order(spark, tmp_path):
    """Lines of many splits, and values of many ranges, are numbered without a gap."""
    lines = [f"line {i} " + "x" * (i % 90) for i in range(3000)]
    put(tmp_path / "b.txt", "\n".join(lines[1000:]) + "\n")
    put(tmp_path / "a.txt", "\n".join(lines[:1000]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = in_file_order(spark.read.text(str(tmp_path / "[ab].txt")))
        assert spark.read.text(str(tmp_path / "[ab].txt")).rdd.getNumPartitions() > 4
        assert [r["value"] for r in rows.orderBy("n").collect()] == lines
        odd = in_file_order(spark.read.text(str(tmp_path / "[ab].txt")), F.col("value").contains("7"))
        assert [r["n"] for r in odd.orderBy("n").collect()] == list(range(sum("7" in x for x in lines)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = numbered(spark.createDataFrame([(w,) for w in lines], "w string").repartition(5), "w").collect()
    assert [r["w"] for r in sorted(got, key=lambda r: r["n"])] == sorted(lines)


def test_graph_store(spark, tmp_path):
    """Merges that run again change nothing, later ones win, deletion leaves an empty graph."""
    store = GraphStore(spark, str(tmp_path / "store"))
    assert store.commits() == [] and store.nodes().count() == 0 and store.listing().count() == 0
    nodes = spark.createDataFrame([("A", "T", "a"), ("A", "T", "a"), ("B", None, "b"), (None, "T", "x")], "entity_id string, entity_type string, name string")
    edges = spark.createDataFrame([("A", "r", "B", "d"), ("A", "r", "gone", "d"), ("A", None, "B", "d")], "head string, relation string, tail string, doc_key_list string")
    for _ in range(2):
        store.merge(nodes, edges, "1")
    assert sorted(map(tuple, store.nodes().collect())) == [("A", "T", "a"), ("B", None, "b")]
    assert [tuple(r) for r in store.edges().collect()] == [("A", "r", "B", "d")]
    store.merge(spark.createDataFrame([("B", "U", "bb"), ("C", "U", "c")], "entity_id string, entity_type string, name string"), spark.createDataFrame([("C", "r", "B", "e")], "head string, relation string, tail string, doc_key_list string"), "2")
    assert sorted(map(tuple, store.nodes().collect())) == [("A", "T", "a"), ("B", "U", "bb"), ("C", "U", "c")]
    assert sorted(map(tuple, store.listing().collect())) == [("edge", "r", 2), ("node", "T", 1), ("node", "U", 2)]
    (tmp_path / "store" / "edges" / "commit=2" / "_SUCCESS").unlink()  # a commit that was not finished
    assert store.commits() == ["1"] and store.nodes().count() == 2
    with pytest.raises(ValueError):
        store.merge(nodes, edges, "a/b")
    for _ in range(2):
        store.delete_all()
    assert store.commits() == [] and store.edges().count() == 0


def test_pubtator(spark, tmp_path):
    text = "1|t|Aspirin helps\n1|a|It is aspirin.\n1\t0\t7\tAspirin\tT1\tUMLS:C1\n\n2|t|X\n2|a|Y\n"
    got = {r["doc_key"]: r for r in corpora.read_pubtator(spark, put(tmp_path / "p", text), {"T1": "Drug"}).collect()}
    m = got["1"]["mentions"][0]
    assert (m["span"], m["name"], m["entity_type"], m["entity_id"]) == ([0, 6], "Aspirin", "Drug", "C1")
    assert got["2"]["title"] == "X" and got["2"]["mentions"] == []
    with pytest.raises(Exception, match="no such mention"):
        corpora.read_pubtator(spark, put(tmp_path / "bad", "1|t|Abc\n1|a|d\n1\t0\t3\tXyz\tT\tUMLS:C\n")).collect()


def test_conll(spark, tmp_path):
    text = "-DOCSTART- -X- O O\n\nEU NNP B-NP B-ORG\nsays VB B-VP O\n\nHi UH B O\n\n-DOCSTART- -X- O O\n\nBye UH B O\n"
    got = [tuple(r) for r in corpora.read_conll(spark, put(tmp_path / "c", text)).orderBy("doc_key", "idx").collect()]
    assert got == [("ID0", 0, 0, "EU", "B-ORG"), ("ID0", 0, 1, "says", "O"), ("ID0", 1, 2, "Hi", "O"), ("ID1", 0, 0, "Bye", "O")]


def test_pairs(spark, tmp_path):
    group = ["1:CID:2", "L2R", "CROSS", "0", "1", "D1", "a|b", "Chemical", "0:5", "1:6", "0:1", "D2", "c", "Disease", "3", "4", "0"]
    r = corpora.read_pairs(spark, put(tmp_path / "x", "\t".join(["9", "some text", *group, *group]) + "\n")).collect()
    assert len(r) == 2 and r[0]["relation"] == "CID" and r[0]["arg1_mentions"] == ["a", "b"] and r[0]["arg1_begins"] == [0, 5] and r[0]["arg2_entity_id"] == "D2"


def test_tables_of_pairs(spark, tmp_path):
    group = ["1:CID:2", "L2R", "CROSS", "0", "1", "D1", "a|b", "Chemical", "0:5", "1:6", "0:1", "D2", "c", "Disease", "3", "4", "0"]
    other = ["not_include", *group[1:11], "D3", *group[12:]]
    t = corpora.tables_of_pairs(corpora.read_pairs(spark, put(tmp_path / "x", "\t".join(["9", "some text", *group, *group, *other]) + "\n")))
    assert [(r["m_idx"], r["begin"], r["end"], r["name"], r["entity_id"]) for r in t["mentions"].orderBy("m_idx").collect()] == [(0, 0, 0, "a", "D1"), (1, 3, 3, "c", "D2"), (2, 5, 5, "b", "D1")]
    assert [(r["entity_id"], r["mention_indices"]) for r in t["entities"].orderBy("entity_id").collect()] == [("D1", [0, 2]), ("D2", [1]), ("D3", [1])]
    assert [tuple(r) for r in t["relations"].collect()] == [("9", "D1", "CID", "D2")] and [tuple(r) for r in t["excluded"].collect()] == [("9", "D1", "D3")]


def test_abstracts(spark, tmp_path):
    text = '# c\n<http://dbpedia.org/resource/New_York> <http://x> "A \\"big\\" city"@en .\n<http://dbpedia.org/resource/X> <http://x> "y"@de .\n'
    assert [tuple(r) for r in corpora.read_abstracts(spark, put(tmp_path / "n", text)).collect()] == [("New_York", "New York", 'A "big" city')]


def test_subject_headings(spark, tmp_path):
    record = {
        "DescriptorUI": "D1", "DescriptorName": {"String": "Aspirin"}, "Annotation": "note",
        "ConceptList": {"Concept": [{"@PreferredConceptYN": "Y", "ScopeNote": "scope", "TermList": {"Term": [{"@ConceptPreferredTermYN": "Y", "String": "Aspirin"}, {"@ConceptPreferredTermYN": "N", "String": "ASA"}]}}]},
        "TreeNumberList": {"TreeNumber": "D02.1"},
    }
    p = put(tmp_path / "m.json", json.dumps({"DescriptorRecordSet": {"@LanguageCode": "eng", "DescriptorRecord": [record]}}))
    assert tuple(corpora.read_subject_headings(spark, p).first()) == ("D1", "Chemical", "Aspirin", ["ASA"], "note scope", ["D02.1"])


def test_vertices(spark):
    schema = "title string, sents array<array<string>>, vertexSet array<array<struct<sent_id:int,pos:array<int>,name:string,type:string>>>, labels array<struct<h:int,t:int,r:string,evidence:array<int>>>"
    df = spark.createDataFrame([("t", [["a", " ", "b"], ["c", "d"]], [[(0, [2, 3], "b", "X")], [(1, [1, 2], "d", "Y")]], [(0, 1, "r", [0])])], schema)
    r = corpora.documents_of_vertices(df).first()
    assert r["sentences"] == ["a b", "c d"] and [m["span"] for m in r["mentions"]] == [[1, 1], [3, 3]] and r["relations"][0]["arg2"] == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "i int, v string")
    sinks.write_grouped(df, str(tmp_path / "g"), "i", 2)
    assert spark.read.json(str(tmp_path / "g")).where("group = 1").count() == 2
    sinks.save_snapshot(str(tmp_path / "s"), spark, {"k": 1}, rows=df)
    config, tables = sinks.load_snapshot(str(tmp_path / "s"), spark, "rows")
    assert config == {"k": 1} and tables["rows"].count() == 5
    sinks.save_vectors(df, str(tmp_path / "v"))
    assert sinks.load_vectors(spark, str(tmp_path / "v")).count() == 5
    out = str(tmp_path / "merged")

    def connect():
        def send(kind, rows):
            with open(out, "a") as f:
                f.writelines(f"{kind} {r['entity_id'] if kind == 'node' else r['relation']}\n" for r in rows)

        return send

    nodes = spark.createDataFrame([("A",), ("A",), ("B",)], "entity_id string")
    edges = spark.createDataFrame([("A", "r", "B")], "head string, relation string, tail string")
    sinks.write_property_graph(nodes, edges, connect)
    assert sorted(open(out).read().split("\n")[:-1]) == ["edge r", "node A", "node B"]


TRIPLES = "head string, relation string, tail string, doc_key string, head_type string, ingest struct<part:int,pos:bigint>"


@pytest.mark.parametrize("batches,seed", [(1, 1), (3, 2), (6, 3)])
def test_graph_of_a_stream(spark, tmp_path, batches, seed):
    """Any split of the triples into batches, in any order, gives the graph of all of them; a restart goes on."""
    import random

    from lodestone.operators import graph
    from lodestone.streaming import graph_upsert as U

    rng = random.Random(seed)
    rows = [(f"e{rng.randrange(8)}", f"r{rng.randrange(3)}", f"e{rng.randrange(8)}", rng.choice(["d1", "d2", "d3", None]), rng.choice([None, "", "T1", "T2"]), (1, i)) for i in range(120)]
    known = [("e0", "r0", "e1", "ExistingKG", "K", (0, 0)), ("new", "r0", "e1", "ExistingKG", None, (0, 1))]
    rng.shuffle(rows)
    src, out = str(tmp_path / "in"), str(tmp_path / "graph")
    for k in range(batches):
        part = rows[k * len(rows) // batches : (k + 1) * len(rows) // batches]
        spark.createDataFrame(part, TRIPLES).coalesce(1).write.mode("append").parquet(src)
        if k % 2 == 0 or k == batches - 1:  # some starts find several files, taken one a batch
            stream = spark.readStream.schema(TRIPLES).option("maxFilesPerTrigger", 1).parquet(src)
            for q in U.start_upserts(stream, out, spark.createDataFrame(known, TRIPLES)):
                q.awaitTermination()
    whole = spark.createDataFrame(rows + known, TRIPLES)
    assert sorted(map(str, U.nodes_now(spark, out).collect())) == sorted(map(str, graph.build_nodes(whole).collect()))
    assert sorted(map(str, U.edges_now(spark, out).collect())) == sorted(map(str, graph.build_edges(whole).collect()))
    # State passes on only what is new.
    written = spark.read.parquet(f"{out}/nodes/stream").count()
    assert written < 2 * len(rows)


def test_query_stream(spark, tmp_path):
    """Queries that arrive in several batches get what a search of all of them gets; the index grows between starts."""
    from lodestone.operators import retrieval as R
    from lodestone.operators.text_index import TextIndex
    from lodestone.streaming import operators as S

    p = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c"]), (4, ["d", "d", "e"]), (5, ["e"]), (6, []), (7, ["f"])], "id int, terms array<string>")
    index = TextIndex.build(p.where("id < 5"), "id", str(tmp_path / "index"))
    index.append(p.where("id >= 5"), "id")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "q string, terms array<string>"
    asked = [("x", ["a", "c"]), ("y", ["d"]), ("z", ["nothing"])]
    for row in asked:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
    S.query_stream(stream, index, "q", 3, out, str(tmp_path / "check")).awaitTermination()
    got = [(r["q"], r["id"], round(r["score"], 9), r["rank"]) for r in spark.read.parquet(out).collect()]
    want = [(r["q"], r["id"], round(r["score"], 9), r["rank"]) for r in R.bm25_search(p, spark.createDataFrame(asked, schema), "id", "q", 3).collect()]
    assert sorted(got) == sorted(want) and len(list((tmp_path / "out").glob("batch=*"))) > 1
