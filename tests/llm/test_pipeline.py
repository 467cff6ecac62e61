"""The pipeline's stages against brute force, on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_brute import jaccard_brute


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, items = docs.columns, spark.read.parquet(f"{small}/benchmark.parquet").collect()
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = step(spark, docs, small)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns and set(after) <= set(before)
        if name == "n-gram Jaccard join":
            best = jaccard_brute([tuple(r) for r in before], 5, 80)
            assert {r["doc_id"] for r in after} == {i for i, (_, c) in best.items() if c == i}
        if name == "benchmark decontamination":
            leaked = {r["doc_id"] for r in before if any(i["text"] in r["text"] for i in items)}
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert leaked <= gone and len(gone) <= len(leaked) + 3
        if name == "mixing sources":
            assert set(after) == set(before)
        if name == "sharding":
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
            # Shards are runs of the mixed order, in which the files before hold the rows.
            mixed = spark.read.parquet(str(tmp_path / str(k - 1))).select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
            mixed.sort(key=lambda r: (int(r["file_name"].split("-")[1]), r["row_index"]))
            assert [r["doc_id"] for r in sorted(after, key=lambda r: (r["shard"], r["slot"]))] == [r["doc_id"] for r in mixed]


def test_run(spark, small):
    got = corpus_pipeline.run(spark, small).collect()
    assert len(got) > 100 and len({r["doc_id"] for r in got}) == len(got)


def test_stages_on_odd_rows(spark, small):
    """Clashing names, maps, nulls, empty and long texts and repeated rows pass every stage; an empty table stays empty."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(20_000))
    item = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    good = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(6).collect()]
    rows = [(1, good[0], "a"), (1, good[0], "a"), (2, None, "a"), (3, "", None), (None, good[1], None), (4, long, "b"), (5, good[2] + " " + item, "b"), (6, good[3], "b")]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    clash = ("kept", "leak", "place", "mixed", "_kept", "_leak", "_d", "_p", "score", "predicted", "c0", "c1", "component_id", "shard", "slot", "size")
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.monotonically_increasing_id())).select("*", *(F.lit(c).alias(c) for c in clash))
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, small)
        got = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if k == 1:  # both rows of document 1 differ in their map
            assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 1, 2, 3, 4, 5, 6]
            assert len(step(spark, docs.withColumn("tags", F.create_map(F.lit("k"), F.lit(1), F.lit("j"), F.lit(2))), small).collect()) == 7
        if k == 2:
            assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 1, 2, 3, 4, 6]
        if k in (3, 4):
            assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 1, 2, 3, 4, 5, 6]
        assert step(spark, docs.limit(0), small).collect() == []
