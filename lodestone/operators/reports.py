"""Communities written out as reports, from templates or through a generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.graph import degrees, induced, rank_within
from lodestone.plans.staging import stage

#: How a template report's title begins (fixed value).
TITLE = "The primary nodes in this community are: "


def _line(value: Column, key: str) -> Column:
    clean = T.sanitize(F.coalesce(value, F.lit("")))
    return F.when(clean == "", F.lit("N/A")).otherwise(clean) if key == "description" else clean


def primary_members(members: DataFrame, edges: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Members (community_id, node, degree) cut to the ``most`` of highest degree, and the edges among them.

    Degrees count within the community; ties go to the smaller node.
    """
    inside = induced(edges, members)
    degree = inside.select("community_id", F.explode(F.array("head", "tail")).alias("node")).groupBy("community_id", "node").agg(F.count(F.lit(1)).alias("degree"))
    full = members.join(degree, ["community_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = rank_within(full, "community_id", [F.desc("degree"), F.col("node")], most).drop("rank")
    return kept, induced(edges, kept.select("community_id", "node"))


def template_reports(
    members: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    node_keys: tuple[str, ...] = ("name", "entity_type", "description"),
    edge_keys: tuple[str, ...] = ("relation",),
    relation_names: dict[str, str] | None = None,
    most: int = 100,
) -> DataFrame:
    """community_id, title, text: the three nodes of highest degree, then node lines and relationship lines.

    Nodes beyond ``most`` are left out by degree before any text is built.
    Lines stand in the order of node ids (edges: head, tail, relation).
    """
    kept, inside = primary_members(members, edges, most)
    named = kept.join(nodes, kept["node"] == nodes["entity_id"])
    first = F.col(node_keys[0])
    line = F.concat(F.lit("- "), F.concat_ws(" | ", *(_line(F.col(k), k) for k in node_keys)))
    by_node = F.array_sort(F.collect_list(F.struct(F.col("node").alias("k"), line.alias("line"))))
    by_degree = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), F.col("node").alias("k"), _line(first, node_keys[0]).alias("n")))), 1, 3)
    parts = named.groupBy("community_id").agg(by_node.alias("_n"), by_degree.alias("_top"))

    # Inner graphs are small after the cut, so edges take their ends' names by join.
    name = nodes.select("entity_id", _line(first, node_keys[0]).alias("_name"))
    ends = inside.join(name.toDF("head", "_h"), "head").join(name.toDF("tail", "_t"), "tail")
    relation = F.col(edge_keys[0])
    if relation_names:
        relation = F.coalesce(F.create_map(*(F.lit(x) for kv in relation_names.items() for x in kv))[relation], relation)
    line = F.concat(F.lit("- "), F.concat_ws(" | ", "_h", T.sanitize(relation), "_t", *(T.sanitize(F.col(k)) for k in edge_keys[1:])))
    by_edge = F.array_sort(F.collect_list(F.struct("head", "tail", F.col(edge_keys[0]).alias("r"), line.alias("line"))))
    rel = ends.groupBy("community_id").agg(by_edge.alias("_e"))

    lines = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    body = F.concat_ws("\n\n", F.concat(F.lit("Nodes:\n"), lines("_n")), F.concat(F.lit("Relationships:\n"), lines("_e")))
    title = F.concat(F.lit(TITLE), F.array_join(F.transform("_top", lambda x: x["n"]), ", "))
    return parts.join(rel, "community_id", "left").select("community_id", title.alias("title"), F.trim(body).alias("text"))


def parse_report(text: Column) -> Column:
    """(title, text) of a generated report: a JSON object's title, summary and numbered findings, else the raw text."""
    got = T.json_part(text, "title string, summary string, findings array<struct<summary: string, explanation: string>>")
    findings = F.transform(F.coalesce(got["findings"], F.array().cast("array<struct<summary: string, explanation: string>>")), lambda f, i: F.concat(F.lit("[Finding "), (i + 1).cast("string"), F.lit("] "), f["summary"], F.lit(": "), f["explanation"]))
    body = F.concat_ws("\n\n", F.array(got["summary"]), findings)
    good = got.isNotNull() & got["title"].isNotNull()
    return F.struct(F.when(good, got["title"]).otherwise(F.lit("No Title")).alias("title"), F.when(good, body).otherwise(text).alias("text"))


def report_prompts(records: DataFrame, members: DataFrame, nodes: DataFrame, edges: DataFrame, done: DataFrame | None = None, most: int = 100) -> DataFrame:
    """community_id, prompt: nodes and edges that no sub-community's report covers, then those reports.

    ``done``: community_id, parent_community_id, title, text, nodes of
    finished reports.
    """
    direct = members
    if done is not None:
        covered = done.select(F.col("parent_community_id").alias("community_id"), F.explode("nodes").alias("node")).distinct()
        direct = members.join(covered, ["community_id", "node"], "left_anti")
    base = template_reports(direct, nodes, edges, most=most).select("community_id", "text")
    out = records.select("community_id").join(base, "community_id", "left")
    if done is not None:
        sub = done.select(F.col("parent_community_id").alias("community_id"), F.struct(F.col("community_id").alias("k"), F.concat(F.lit("## "), "title", F.lit("\n"), "text").alias("t")).alias("s"))
        subs = sub.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n\n").alias("subs"))
        out = out.join(subs, "community_id", "left")
    else:
        out = out.withColumn("subs", F.lit(None).cast("string"))
    return out.select("community_id", F.concat_ws("\n\n", "text", F.concat(F.lit("Sub-Communities' Reports:\n"), F.col("subs"))).alias("prompt"))


def reports_bottom_up(records: DataFrame, nodes: DataFrame, edges: DataFrame, generate: Callable[[Column], Column]) -> DataFrame:
    """Reports of a whole hierarchy, deepest level first, so that each prompt holds its sub-communities' reports.

    ``generate`` maps a prompt Column to generated text. The loop runs once
    per level, of which there are few.
    """
    real = stage(records.where("nodes IS NOT NULL"), "report-records")
    levels = sorted((r[0] for r in real.select("level").distinct().collect()), reverse=True)
    done: DataFrame | None = None
    for level in levels:
        here = real.where(F.col("level") == level)
        members = here.select("community_id", F.explode("nodes").alias("node"))
        below = done.join(here.select(F.col("community_id").alias("parent_community_id")), "parent_community_id", "left_semi") if done is not None else None
        made = report_prompts(here, members, nodes, edges, below).withColumn("_r", parse_report(generate(F.col("prompt"))))
        full = stage(here.join(made, "community_id").select("community_id", "parent_community_id", "level", "nodes", F.col("_r.title").alias("title"), F.col("_r.text").alias("text")), "reports")
        done = full if done is None else done.unionByName(full)
    return done if done is not None else real.select("community_id", "parent_community_id", "level", "nodes", F.lit("").alias("title"), F.lit("").alias("text"))


def primary_nodes(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nodes of highest degree of the whole graph (ties: smaller node)."""
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)
