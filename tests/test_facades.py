"""Tasks and the flow from documents to triples, with stand-ins for models."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import facades


def test_documents_to_triples(spark):
    docs = spark.createDataFrame([("a", "Oslo lies in Norway"), ("b", "nothing here"), ("c", "Oslo Oslo"), ("d", None)], "doc_key string, text string")
    names = spark.createDataFrame([("Oslo", "CITY"), ("Norway", "COUNTRY")], "name string, entity_type string")
    entities = spark.createDataFrame([("Oslo", "Q2"), ("Oslo", "Q1"), ("Norway", "Q3")], "name string, entity_id string")
    pair = facades.relations.using(
        pairs=lambda df: df.where(F.size("entities") > 1).select("doc_key", F.col("entities")[0]["entity_id"].alias("head"), F.lit("in").alias("relation"), F.col("entities")[1]["entity_id"].alias("tail"))
    )
    steps = {
        "recognize": lambda df: facades.ner(df, "dictionary", dictionary=names),
        "search": lambda df: facades.entity_search(df, "names", dictionary=entities, k=5),
        "relate": lambda df: pair(df, "pairs"),
    }
    got = facades.extract_triples(docs, rerank=lambda df: facades.reranking(df, "identity"), **steps).collect()
    assert [tuple(r) for r in got] == [("a", "Q1", "in", "Q3")]
    other = facades.extract_triples(docs, rerank=lambda df: facades.reranking(df, "score", score=F.col("entity_id") == "Q2"), **steps).collect()
    assert [tuple(r) for r in other] == [("a", "Q2", "in", "Q3")]
    held = facades.extract_triples(docs, rerank=facades.unchanged, **(steps | {"relate": lambda df: df})).collect()
    assert {r["doc_key"]: [(e["entity_id"], e["mentions"]) for e in r["entities"]] for r in held} == {"a": [("Q1", [0]), ("Q3", [1])], "b": [], "c": [("Q1", [0, 1])], "d": []}


def test_tasks_name_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1)], "doc_key string, m_idx int")
    with pytest.raises(KeyError):
        facades.ner(df, "neural")
    with pytest.raises(ValueError, match="text"):
        facades.ner(df, "dictionary", dictionary=df)
    with pytest.raises(ValueError, match="must give"):
        facades.ner.using(bad=lambda d: d)(df.withColumn("text", F.lit("x")), "bad")


def test_answers(spark):
    asked = spark.createDataFrame([(1, "Who?"), (2, "Where?")], "question_key int, question string")
    contexts = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "question_key int, rank int, text string")
    got = facades.answers(asked, "C: {contexts}\nQ: {question}", lambda p: F.concat(F.lit("  "), F.upper(p)), contexts=contexts).orderBy("question_key").collect()
    assert [r["prompt"] for r in got] == ["C: first\nsecond\nQ: Who?", "C: \nQ: Where?"]
    assert got[0]["answer"] == "C: FIRST\nSECOND\nQ: WHO?"
    assert facades.answers(asked, "{question}", lambda p: p).count() == 2


def test_known_relations(spark):
    docs = spark.createDataFrame([("a", "", [("X",), ("Y",), ("Z",)]), ("b", "", [("X",)]), ("c", "", [])], "doc_key string, text string, entities array<struct<entity_id:string>>")
    facts = spark.createDataFrame([("X", "r", "Y"), ("X", "r", "Y"), ("Y", "s", "X"), ("X", "r", "W"), ("Z", "t", "Z")], "head string, relation string, tail string")
    got = facades.relations(docs, "known", facts=facts).collect()
    assert sorted(map(tuple, got)) == [("a", "X", "r", "Y"), ("a", "Y", "s", "X")]


def test_texts_are_encoded_once(spark, tmp_path):
    """A second run, and other rows of the same texts, encode nothing; another model starts anew; a broken run leaves nothing."""
    from lodestone.functions import text as T
    from lodestone.operators import retrieval, vector_store as V

    encoder = V.by_column(lambda c: retrieval.hashed_encoder(T.words(c), 16))
    broken = V.by_column(lambda c: F.raise_error(F.lit("encoded again")).cast("array<double>"))
    rows = spark.createDataFrame([(1, "red car"), (2, "blue car"), (3, "red car"), (4, None), (5, "")], "id int, t string")
    store = V.VectorStore(spark, str(tmp_path), "m-1")
    assert store.vectors().count() == 0 and store.missing(rows, "t").count() == 3
    first = {r["id"]: r["vector"] for r in store.encode(rows, "t", encoder, "id").collect()}
    assert first[1] == first[3] != first[2] and first[4] is None and len(first) == 5
    again = V.VectorStore(spark, str(tmp_path), "m-1")
    assert {r["id"]: r["vector"] for r in again.encode(rows, "t", broken, "id").collect()} == first
    more = rows.unionByName(spark.createDataFrame([(6, "green car")], "id int, t string"))
    with pytest.raises(Exception, match="encoded again"):
        again.encode(more, "t", broken, "id")
    assert again.vectors().count() == 3 and [r["text"] for r in again.missing(more, "t").collect()] == ["green car"]
    assert V.VectorStore(spark, str(tmp_path), "m-2").missing(rows, "t").count() == 3
    index = V.refreshed_index(again, more, "id", "t", encoder, str(tmp_path / "index"))
    m = spark.createDataFrame([("d", 0, "GREEN CAR"), ("d", 1, None), ("d", 2, "blue car")], "doc_key string, m_idx int, name string")
    got = V.dense_candidates(m, index, again, encoder, 1).orderBy("m_idx").collect()
    assert [(r["m_idx"], r["id"], round(r["score"], 6)) for r in got] == [(0, 6, 1.0), (2, 2, 1.0)]
