"""Scores of extraction, linking, retrieval and question answering. Percentages unless said otherwise; 0 for 0 / 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import stage

#: The cut-offs of ranking metrics (fixed values).
K_GRID = (1, 2, 4, 5, 8, 10, 16, 20, 30, 32, 50, 64, 100, 128)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _prf(counts: DataFrame, correct_pred: str = "correct", correct_gold: str = "correct", names: tuple[str, str, str] = ("precision", "recall", "f1")) -> DataFrame:
    p, r = share(F.col(correct_pred), F.col("pred")), share(F.col(correct_gold), F.col("gold"))
    out = counts.withColumn("_p", p).withColumn("_r", r)
    f = share(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))
    return out.select("*", (F.col("_p") * 100).alias(names[0]), (F.col("_r") * 100).alias(names[1]), (f * 100).alias(names[2])).drop("_p", "_r")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def set_scores(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: pred, gold, correct, precision, recall, f1 over distinct keys.

    Both sides go through one aggregation by key, so each is shuffled once.
    """
    return _side_scores(_sides(pred, gold, keys))


def _sides(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys, with whether (0 or 1) they are predicted and gold."""
    sides = pred.select(*keys, F.lit(1).alias("_p"), F.lit(0).alias("_g")).union(gold.select(*keys, F.lit(0), F.lit(1)))
    return sides.groupBy(*keys).agg(F.max("_p").alias("_p"), F.max("_g").alias("_g"))


def _side_scores(each: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return _prf(each.agg(total("_p").alias("pred"), total("_g").alias("gold"), total(F.col("_p") * F.col("_g")).alias("correct")))


def span_scores(pred: DataFrame, gold: DataFrame, key: str = "doc_key") -> DataFrame:
    """Exact span and type: key, begin, end, entity_type."""
    return set_scores(pred, gold, [key, "begin", "end", "entity_type"])


def span_only_scores(pred: DataFrame, gold: DataFrame, key: str = "doc_key") -> DataFrame:
    return set_scores(pred, gold, [key, "begin", "end"])


def overlap_scores(pred: DataFrame, gold: DataFrame, key: str = "doc_key") -> DataFrame:
    """Spans that overlap one of the same type on the other side; counted from each side. Ends are inclusive."""
    cols = [key, "begin", "end", "entity_type"]
    p, g = pred.select(*cols).distinct(), gold.select(*cols).distinct()

    def touched(a: DataFrame, b: DataFrame) -> DataFrame:
        """Spans of ``a`` for which some span of ``b`` begins by their end and ends no sooner than they begin: one sweep over each document's ends."""
        others = b.select(key, "entity_type", F.col("begin").alias("_at"), F.lit(0).alias("_side"), F.col("end").alias("_reach"), F.lit(None).cast("bigint").alias("begin"))
        mine = a.select(key, "entity_type", F.col("end").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_reach"), "begin")
        sofar = Window.partitionBy(key, "entity_type").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
        swept = others.unionByName(mine).where(F.col(key).isNotNull() & F.col("entity_type").isNotNull())
        return swept.withColumn("_far", F.max("_reach").over(sofar)).where((F.col("_side") == 1) & (F.col("_far") >= F.col("begin")))

    one = _count(p, "pred").crossJoin(_count(g, "gold")).crossJoin(_count(touched(p, g), "correct_pred")).crossJoin(_count(touched(g, p), "correct_gold"))  # one row each
    return _prf(one, "correct_pred", "correct_gold")


def linking_accuracy(pred: DataFrame, gold: DataFrame, key: str = "doc_key") -> DataFrame:
    """Accuracy over mentions in the knowledge base, and over those whose gold is among the candidates (normalized).

    ``gold``: key, m_idx, entity_id, in_kb, in_cand; ``pred``: key, m_idx, entity_id.
    """
    p = pred.select(key, "m_idx", F.col("entity_id").alias("_pred"))
    j = gold.where("in_kb").join(p, [key, "m_idx"], "left").withColumn("_ok", F.coalesce(F.col("_pred") == F.col("entity_id"), F.lit(False)).cast("int"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    cand = F.col("in_cand").cast("int")
    out = j.agg(F.count(F.lit(1)).alias("mentions"), total("_ok").alias("correct"), total(cand).alias("mentions_in_cand"), total(F.col("_ok") * cand).alias("correct_in_cand"))
    return out.select("*", (share(F.col("correct"), F.col("mentions")) * 100).alias("accuracy"), (share(F.col("correct_in_cand"), F.col("mentions_in_cand")) * 100).alias("normalized_accuracy"))


def linking_scores(pred: DataFrame, gold: DataFrame, key: str = "doc_key") -> DataFrame:
    """Mention level: spans with their entity, predictions of nothing left out."""
    return set_scores(pred.where("entity_id <> 'NO-PRED'"), gold, [key, "begin", "end", "entity_id"])


def entity_scores(pred: DataFrame, gold: DataFrame, key: str = "doc_key", ignored_types: tuple[str, ...] = (), ignored_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Entity level: distinct ids a document; types are ignored on both sides, id prefixes in gold only."""
    g = gold
    if ignored_types:
        pred, g = pred.where(~F.col("entity_type").isin(*ignored_types)), g.where(~F.col("entity_type").isin(*ignored_types))
    for prefix in ignored_prefixes:
        g = g.where(~F.startswith("entity_id", F.lit(prefix)))
    return set_scores(pred, g, [key, "entity_id"])


def candidate_recall(candidates: DataFrame, gold: DataFrame, keys: list[str], grid: tuple[int, ...] = K_GRID) -> DataFrame:
    """(k, recall): the share of gold rows whose entity is among the first k candidates. ``candidates``: keys, rank (from 1), entity_id."""
    first = candidates.groupBy(*keys, "entity_id").agg(F.min("rank").alias("_rank"))
    j = gold.select(*keys, "entity_id").join(first, [*keys, "entity_id"], "left")
    each = j.select("_rank", F.explode(F.lit(list(grid))).alias("k"))
    return each.groupBy("k").agg((F.avg(F.coalesce((F.col("_rank") <= F.col("k")).cast("int"), F.lit(0))) * 100).alias("recall"))


def relation_scores(pred: DataFrame, gold: DataFrame, key: str = "doc_key") -> DataFrame:
    return set_scores(pred, gold, [key, "head", "relation", "tail"])


def relation_scores_by(pred: DataFrame, gold: DataFrame, occurrences: DataFrame, kind: str, key: str = "doc_key") -> DataFrame:
    """Scores of the triples whose pair of entities is of the kind ``intra`` or ``inter``, as ``intra_inter`` has it. ``occurrences``: key, entity, sent_idx.

    Only pairs that a triple names are judged; the others of a document are not made.
    """
    keys = [key, "head", "relation", "tail"]
    sets = occurrences.groupBy(key, "entity").agg(F.collect_set("sent_idx").alias("_s"))
    end = lambda c: sets.toDF(key, c, f"_{c}")
    of = _sides(pred, gold, keys).where("head <> tail").join(end("head"), [key, "head"]).join(end("tail"), [key, "tail"])
    return _side_scores(of.where(_kind("_head", "_tail") == kind))


def _kind(a: str, b: str) -> Column:
    return F.when(F.arrays_overlap(a, b), "intra").otherwise("inter")


def intra_inter(occurrences: DataFrame, key: str = "doc_key") -> DataFrame:
    """(key, head, tail, kind): ordered pairs of entities of a document, intra where they share a sentence. ``occurrences``: key, entity, sent_idx."""
    sets = occurrences.groupBy(key, "entity").agg(F.collect_set("sent_idx").alias("s"))
    a, b = sets.toDF(key, "head", "s1"), sets.toDF(key, "tail", "s2")
    return a.join(b, key).where("head <> tail").select(key, "head", "tail", _kind("s1", "s2").alias("kind"))


def seen_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (head, tail) with whether ``known`` has them in either direction."""
    both = known.select("head", "tail").union(known.select(F.col("tail"), F.col("head"))).distinct().withColumn("_s", F.lit(True))
    return pairs.join(both, ["head", "tail"], "left").withColumn("seen", F.coalesce("_s", F.lit(False))).drop("_s")


def named_facts(triples: DataFrame, names: DataFrame, key: str = "doc_key") -> DataFrame:
    """Distinct (head_name, relation, tail_name) over all names of the ends. ``names``: key, entity, name."""
    each = _with_names(triples.select(key, "head", "relation", "tail"), names, key).select("relation", "_h", F.inline("_t").alias("tail_name"))
    return each.select(F.inline("_h").alias("head_name"), "relation", "tail_name").distinct()


def _with_names(triples: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Triples whose ends have names, with these as sorted lists (_h, _t: arrays of struct name): rows are not multiplied."""
    lists = names.groupBy(key, "entity").agg(F.sort_array(F.collect_set(F.struct("name"))).alias("_n"))
    return triples.join(lists.toDF(key, "head", "_h"), [key, "head"]).join(lists.toDF(key, "tail", "_t"), [key, "tail"])


def _count_known(right: DataFrame, names: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """One row, correct_known: how many of the different triples have a pair of names among the facts.

    Triples whose ends are named alike are counted as one, and only these are
    multiplied by their names. Steps are staged, so that the disk holds the
    shuffle of one at a time.
    """
    alike = _with_names(right, names, key).groupBy("_h", "relation", "_t").agg(F.count(F.lit(1)).alias("_n"))
    alike = stage(alike.withColumn("_id", F.monotonically_increasing_id()), "alike")
    facts = stage(facts, "facts")
    each = alike.select("_id", "_n", "relation", "_h", F.inline("_t").alias("tail_name")).select("_id", "_n", "relation", F.inline("_h").alias("head_name"), "tail_name")
    met = each.join(facts, ["head_name", "relation", "tail_name"], "left_semi").groupBy("_id").agg(F.first("_n").alias("_n"))
    return met.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("correct_known"))


def unseen_relation_scores(pred: DataFrame, gold: DataFrame, names: DataFrame, facts: DataFrame, key: str = "doc_key") -> DataFrame:
    """Scores whose precision leaves out correct triples that some pair of names has among the training facts.

    They go from numerator and denominator; recall is as it is.
    """
    cols = [key, "head", "relation", "tail"]
    sides = stage(_sides(pred, gold, cols), "sides")
    right = sides.where("_p = 1 AND _g = 1").dropna(subset=cols)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    one = sides.agg(total("_p").alias("pred"), total("_g").alias("gold")).crossJoin(_count(right, "correct")).crossJoin(_count_known(right.select(*cols), names, facts, key))  # one row each
    one = one.withColumn("_p", share(F.col("correct") - F.col("correct_known"), F.col("pred") - F.col("correct_known"))).withColumn("_r", share(F.col("correct"), F.col("gold")))
    f = share(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))
    return one.select("pred", "gold", "correct", "correct_known", (F.col("_p") * 100).alias("precision"), (F.col("_r") * 100).alias("recall"), (f * 100).alias("f1"))


def official_rows(triples: DataFrame, key: str = "doc_key") -> DataFrame:
    """The exchange format: title, h_idx, t_idx, r, one row per triple."""
    return triples.select(F.col(key).alias("title"), F.col("arg1").alias("h_idx"), F.col("arg2").alias("t_idx"), F.col("relation").alias("r")).dropDuplicates()


# Retrieval. ``found``: query, key, rank (from 1); ``gold``: query, key.


def _hits(found: DataFrame, gold: DataFrame, query: str, key: str) -> DataFrame:
    rel = gold.select(query, key).distinct().withColumn("_rel", F.lit(1))
    return found.join(rel, [query, key], "left").withColumn("_rel", F.coalesce("_rel", F.lit(0)))


def without_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys one: what is left of a sorted list when each row that equals the one before is passed over."""
    return rows.dropDuplicates(keys)


def identified(rows: DataFrame, passages: DataFrame, key: str, identity: Column, name: str = "identity") -> DataFrame:
    """``rows`` with what their passages count as (an expression over ``passages``) in place of the passages' key: equal texts, say, as one."""
    return rows.join(passages.select(key, identity.alias(name)), key).drop(key)


def precision_recall_at_k(found: DataFrame, gold: DataFrame, query: str, key: str, grid: tuple[int, ...] = K_GRID) -> DataFrame:
    """(k, precision, recall) with counts summed over queries; a passage counts once a query."""
    first = _hits(found, gold, query, key).groupBy(query, key).agg(F.min("rank").alias("rank"), F.max("_rel").alias("_rel"))
    total = gold.join(found.select(query).distinct(), query, "left_semi").select(query, key).distinct().agg(F.count(F.lit(1)).alias("gold"))
    each = first.select("rank", "_rel", F.explode(F.lit(list(grid))).alias("k")).where("rank <= k")
    out = each.groupBy("k").agg(F.count(F.lit(1)).alias("pred"), F.sum("_rel").alias("correct")).crossJoin(F.broadcast(total))  # one row
    return out.select("k", (share(F.col("correct"), F.col("pred")) * 100).alias("precision"), (share(F.col("correct"), F.col("gold")) * 100).alias("recall"))


def ndcg_at_k(found: DataFrame, gold: DataFrame, queries: DataFrame, query: str, key: str, grid: tuple[int, ...] = K_GRID) -> DataFrame:
    """(k, ndcg) with binary gains, the mean over ``queries``; the ideal has min(k, number of gold) hits."""
    gain = lambda r: 1 / F.log2(r + 1)
    hits = _hits(found, gold, query, key).where("_rel = 1").select(query, "rank", F.explode(F.lit(list(grid))).alias("k")).where("rank <= k")
    dcg = hits.groupBy(query, "k").agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    n = gold.select(query, key).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    ideal = n.select(query, F.explode(F.lit(list(grid))).alias("k"), "n")
    ideal = ideal.withColumn("ideal", F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.col("k")).cast("int")), F.lit(0.0), lambda s, r: s + gain(r)))
    all_k = queries.select(query).select(query, F.explode(F.lit(list(grid))).alias("k"))
    j = all_k.join(ideal, [query, "k"], "left").join(dcg, [query, "k"], "left")
    return j.groupBy("k").agg((F.avg(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)))).alias("ndcg"))


def reciprocal_ranks(found: DataFrame, gold: DataFrame, queries: DataFrame, query: str, key: str) -> DataFrame:
    """(query, rr): the reciprocal of the first hit's rank, 0 without one."""
    first = _hits(found, gold, query, key).where("_rel = 1").groupBy(query).agg(F.min("rank").alias("r"))
    return queries.select(query).join(first, query, "left").select(query, F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))


def average_precisions(found: DataFrame, gold: DataFrame, queries: DataFrame, query: str, key: str) -> DataFrame:
    """(query, ap): precision at each hit summed over the number of gold passages; 0 without any."""
    run = F.sum("_rel").over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = _hits(found, gold, query, key).withColumn("_h", run).where("_rel = 1").groupBy(query).agg(F.sum(F.col("_h") / F.col("rank")).alias("s"))
    n = gold.select(query, key).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    return queries.select(query).join(hits, query, "left").join(n, query, "left").select(query, F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("ap"))


# Question answering. ``outputs``: question_key, output_answer; ``answers``: question_key, list_index, answer.


def matches(output: Column, answer: Column, exact: bool = False) -> Column:
    a, b = F.lower(output), F.lower(answer)
    return a == b if exact else F.contains(a, b) | F.contains(b, a)


def answer_accuracy(outputs: DataFrame, answers: DataFrame, exact: bool = False, key: str = "question_key") -> DataFrame:
    """questions, correct, accuracy: the output matches (is, or contains or is contained in) some answer."""
    ok = outputs.join(answers.select(key, "answer"), key).where(matches(F.col("output_answer"), F.col("answer"), exact)).select(key).distinct()
    one = _count(outputs, "questions").crossJoin(_count(ok, "correct"))  # one row each
    return one.select("questions", "correct", (share(F.col("correct"), F.col("questions")) * 100).alias("accuracy"))


def answer_recall(outputs: DataFrame, answers: DataFrame, exact: bool = False, key: str = "question_key") -> DataFrame:
    """items, correct, recall: list items of which some synonym matches the output."""
    j = outputs.join(answers, key).groupBy(key, "list_index").agg(F.max(matches(F.col("output_answer"), F.col("answer"), exact).cast("int")).alias("_ok"))
    one = j.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("_ok"), F.lit(0)).cast("bigint").alias("correct"))
    return one.select("items", "correct", (share(F.col("correct"), F.col("items")) * 100).alias("recall"))


def graded(outputs: DataFrame, response: str = "response") -> DataFrame:
    """The mean of the scores in graders' responses."""
    from lodestone.functions.parsing import score

    return outputs.agg(F.count(F.lit(1)).alias("questions"), F.avg(score(F.col(response))).alias("mean_score"))


def official_scores(pred: DataFrame, gold: DataFrame, names: DataFrame, facts: DataFrame, key: str = "doc_key") -> DataFrame:
    """The exchange format's evaluation: standard scores, those without training facts (denominator + 1e-5), and evidence.

    ``pred`` and ``gold``: key, head, relation, tail, evidences (array). Equal
    predictions count once; without any the scores are 0.
    """
    cols = [key, "head", "relation", "tail"]
    none = F.array().cast("array<int>")
    said = lambda df, p, g: df.select(*cols, F.coalesce("evidences", none).alias("_e")).select(*cols, (F.col("_e") if p else F.lit(None)).alias("_e"), (F.col("_e") if g else F.lit(None)).alias("_s"))
    both = said(pred, True, False).union(said(gold, False, True)).groupBy(*cols)
    both = both.agg(F.first("_e", ignorenulls=True).alias("_e"), F.array_distinct(F.flatten(F.collect_list("_s"))).alias("_s"), F.count("_s").alias("_g"))
    met = F.when(F.col("_e").isNotNull(), F.size(F.array_intersect("_e", "_s"))).otherwise(0)
    is_p, is_g = F.col("_e").isNotNull().cast("int").alias("_p"), (F.col("_g") > 0).cast("int").alias("_g")
    sides = stage(both.select(*cols, is_p, is_g, F.when(F.col("_e").isNotNull(), F.size(F.array_distinct("_e"))).otherwise(0).alias("_pe"), F.size("_s").alias("_ge"), met.alias("_ce")), "sides")
    right = sides.where("_p = 1 AND _g = 1").dropna(subset=cols)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    two = sides.agg(total("_p").alias("pred"), total("_pe").alias("pred_evidence"), total("_g").alias("gold"), total("_ge").alias("gold_evidence"))
    three = right.agg(F.count(F.lit(1)).alias("correct"), total("_ce").alias("correct_evidence"))
    c = two.crossJoin(three).crossJoin(_count_known(right.select(*cols), names, facts, key))  # one row each
    p, r = share(F.col("correct"), F.col("pred")), share(F.col("correct"), F.col("gold"))
    ip = (F.col("correct") - F.col("correct_known")) / (F.col("pred") - F.col("correct_known") + 1e-5)
    ep, er = share(F.col("correct_evidence"), F.col("pred_evidence")), share(F.col("correct_evidence"), F.col("gold_evidence"))
    f = lambda a, b: share(2 * a * b, a + b) * 100
    return c.select(
        "pred", "gold", "correct", "correct_known", (p * 100).alias("precision"), (r * 100).alias("recall"), f(p, r).alias("f1"), (ip * 100).alias("ign_precision"), f(ip, r).alias("ign_f1"), f(ep, er).alias("evidence_f1")
    )
