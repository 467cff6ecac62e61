from pyspark.sql import functions as F

from lodestone.functions import parsing, text as T
from lodestone.operators import chunking


def one(spark, col, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(col.alias("x")).first()[0]


def chunks(spark, sentences, window):
    return one(spark, T.pack_chunks(F.lit(sentences), window))


def test_packing(spark):
    assert chunks(spark, ["a b", "c d", "e"], 3) == ["a b c d", "e"]
    assert chunks(spark, ["a  b"], 3) == ["a  b"]
    assert chunks(spark, ["a b c d e", "f"], 3) == ["a b c d e", "f"]
    assert one(spark, T.pack_chunks(F.array().cast("array<string>"), 3)) == []


def test_passage_text(spark):
    s = F.lit(None).cast("string")
    assert one(spark, T.passage_text(F.lit("T"), F.lit(" "), " : ")) == "T"
    assert one(spark, T.passage_text(s, F.lit("x"), " : ")) == "x"
    assert one(spark, T.passage_text(F.lit("T"), F.lit("x"), " : ")) == "T : x"


def test_sentences_and_paragraphs(spark):
    assert one(spark, T.sentences(F.lit("A b. C!\n \nD"))) == ["A b.", " C!", "D"]
    assert one(spark, T.sentences(F.lit(None).cast("string"))) == []
    assert one(spark, T.paragraphs(F.lit("a\n\nb\nc"))) == ["a\n\n", "b\n", "c"]
    assert one(spark, T.tokens(F.lit("it's 3.5 x_y"))) == ["it", "'", "s", "3", ".", "5", "x_y"]


def test_numbered_contexts(spark):
    assert one(spark, T.numbered(F.lit(["a "]))) == "a"
    assert one(spark, T.numbered(F.lit(["a", "b"]))) == "[1] a \n\n[2] b"
    assert one(spark, T.numbered(F.array().cast("array<string>"))) == ""


def test_edit_similarity(spark):
    assert one(spark, T.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == 0.25


def test_lenient_json(spark):
    assert one(spark, T.json_part(F.lit('said: {"a": 1} done'), "a int"))["a"] == 1
    assert one(spark, T.json_part(F.lit("no json"), "a int")) is None
    assert one(spark, T.json_part(F.lit("{broken"), "a int")) is None
    assert one(spark, T.json_part(F.lit("} x {"), "a int")) is None
    assert one(spark, T.json_part(F.lit("x [1, 2] y"), "array<int>", a_list=True)) == [1, 2]


def test_line_parsers(spark):
    two = lambda s: one(spark, parsing.two_fields(F.lit(s)))
    assert tuple(two("- breast cancer | Disease")) == ("breast cancer", "Disease")
    assert tuple(two("Aspirin | Chemical")) == ("spirin", "Chemical")
    assert two("no fields here") is None
    assert tuple(one(spark, parsing.three_fields(F.lit("- Entity0 | treats | Entity1")))) == ("Entity0", "treats", "Entity1")


def test_scores(spark):
    for text, value in (("Score: 85%", 0.85), ("Score: 0.7", 0.7), ("Score: n/a", 0.0), ("", 0.0), ("Score: 1.2.3", 0.0)):
        assert one(spark, parsing.score(F.lit(text))) == value


def test_answer_parts(spark):
    got = one(spark, parsing.answer_parts(F.lit("Answer: a\nRationale: r\nAnswer: b\nScore: 50%")))
    assert tuple(got) == ("b", "r", 0.5)
    assert tuple(one(spark, parsing.answer_parts(F.lit("just text")))) == ("just text", "", 0.0)


def test_documents(spark):
    df = spark.createDataFrame([(1, "T  x", "A b.\tC d."), (2, None, "E.")], "id int, title string, text string")
    got = {r[0]: r[1] for r in chunking.documents_from_passages(chunking.passage_keys(df, "id"), F.col("doc_key"), title_col="title").collect()}
    assert got == {"Passage#0": ["T x", "A b.", "C d."], "Passage#1": ["E."]}


def test_mentions_in_text(spark):
    m = F.array(F.struct(F.lit(0).alias("begin"), F.lit(1).alias("end"), F.lit("X").alias("entity_type")), F.struct(F.lit(1).alias("begin"), F.lit(1).alias("end"), F.lit("Y").alias("entity_type")))
    assert one(spark, chunking.mark_mentions(F.lit(["a", "b", "c"]), m)) == "{a {b:Y}:X} c"
    m = F.array(F.struct(F.lit(1).alias("begin"), F.lit(3).alias("end")))
    assert one(spark, chunking.space_mentions(F.lit("xaby(c)"), m)) == "x ab y ( c ) "
    assert tuple(one(spark, chunking.align_characters(F.lit(["ab", "c", "de"]), F.lit(2), F.lit(5)))) == (1, 2)


def test_merged_sentences(spark):
    s = spark.createDataFrame([("d", 0, "a b"), ("d", 1, "c d"), ("d", 2, "e")], "doc_key string, sent_idx int, sentence string")
    m = spark.createDataFrame([("d", 1, 2)], "doc_key string, begin int, end int")
    got = [tuple(r) for r in chunking.merge_crossed_sentences(s, m).orderBy("sent_idx").select("sent_idx", "sentence").collect()]
    assert got == [(0, "a b c d"), (1, "e")]


def test_blank_tokens(spark):
    t = spark.createDataFrame([("d", i, w) for i, w in enumerate(["a", " ", "b"])], "doc_key string, idx int, token string")
    assert [tuple(r)[1:] for r in chunking.drop_blank_tokens(t).orderBy("new_idx").collect()] == [(0, 0, "a"), (2, 1, "b")]
