"""URL filters by rules and by trust along the graph of hosts (DataFrame operations only).

Rules of a host (or a domain above it) and a path prefix judge what they fit.
Hosts that hold allowed pages are seeds of trust, hosts that hold blocked ones
seeds of distrust. Trust flows along links by personalised PageRank; distrust
flows against them, to whoever links to a blocked host. Each host's two masses
decide about its pages that no rule fits.

Masses are whole numbers, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.staging import stage, unstage

#: Host and path prefix of a rule, and what it says.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Mass of a host all of whose pages are seeds.
WHOLE = 10**9
#: Parts that the rows of a host are dealt to where they meet what is known about the host.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute or protocol-relative hyperlink.
HYPERLINK = """<[aA][ \\t\\r\\n\\f/](?:[^<>]*?[ \\t\\r\\n\\f"'/])?[hH][rR][eE][fF][ \\t\\r\\n\\f]*=[ \\t\\r\\n\\f]*["']?[ \\t\\r\\n\\f]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"' \\t\\r\\n\\f<>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table (rule_host, rule_path, rule_verdict)."""
    one = lambda r: F.struct(*(F.lit(v).alias(c) for c, v in zip(("rule_host", "rule_path", "rule_verdict"), r, strict=True)))
    return spark.range(1).select(F.inline(F.array(*(one(r) for r in rules))))


def _salted(rows: DataFrame, about: DataFrame, host: str, *spread: str) -> DataFrame:
    """``rows`` left-joined with ``about`` (one row a host, under _h), the rows of a host dealt to SALTS tasks."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    many = about.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(many, (F.col(host) == F.col("_h")) & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_s", "_h")


def fit_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (_host, _path, ...) with rule and _says of the longest rule that fits, else null.

    The rules of each distinct host are found by its domains and sorted, the
    longest first (of equally long ones the one with the longer host, then
    block); a page takes the first one that its path starts with.
    """
    hosts = urls.select(F.col("_host").alias("_h")).distinct()
    name = F.concat("rule_host", "rule_path")
    order = F.struct((-F.length(name)).alias("a"), (-F.length("rule_host")).alias("b"), F.when(F.col("rule_verdict") == "block", 0).otherwise(1).alias("c"), F.col("rule_path").alias("path"), name.alias("rule"), F.col("rule_verdict").alias("says"))
    known = hosts.select("_h", F.explode(domains(F.col("_h"))).alias("rule_host")).join(rules, "rule_host")
    known = known.groupBy("_h").agg(F.array_sort(F.collect_set(order)).alias("_rules"))
    met = _salted(urls, known, "_host", *urls.columns)
    first = F.get(F.filter("_rules", lambda r: F.col("_path").startswith(r["path"])), F.lit(0))
    return met.withColumn("_first", first).select(*urls.columns, F.col("_first.rule").alias("rule"), F.col("_first.says").alias("_says"))


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n) of the hyperlinks from one host to another in whole pages."""
    html = F.when(F.contains(pages[html_col], F.lit("//")), pages[html_col])
    found = pages.select(host_of(pages[url_col]).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(HYPERLINK), F.lit(1))).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' AND src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, n) both ways between each host and the nearest domain above it that is a host too: one owner stands for both."""
    above = hosts.select("host", F.posexplode(domains(F.col("host"))).alias("at", "domain")).where("at > 0")
    above = above.join(hosts.select(F.col("host").alias("domain")), "domain", "left_semi")
    near = above.groupBy("host").agg(F.min_by("domain", "at").alias("domain"))
    return near.select(F.col("host").alias("src"), F.col("domain").alias("dst"), F.lit(1).alias("n")).unionByName(near.select(F.col("domain").alias("src"), F.col("host").alias("dst"), F.lit(1).alias("n")))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds of personalised PageRank, or as soon as no mass changes.

    seeds: host, trust, distrust (whole parts of WHOLE). links: src, dst, n.
    Trust leaves a host along its links, distrust against them, in proportion
    to n; a host without such links keeps to itself what would leave. Each
    round is a table in the shared folder.
    """
    rest = F.lit(1 - damping)
    forward = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    ways = forward.unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    ways = ways.groupBy("kind", "host", "to").agg(F.sum("n").alias("n"))
    total = ways.groupBy("kind", "host").agg(F.sum("n").alias("_all"))
    ways = stage(ways.join(total, ["kind", "host"]).select("kind", "host", "to", (F.lit(damping) * F.col("n") / F.col("_all")).alias("share")), "host-ways")
    nodes = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    given = nodes.join(seeds, "host", "left").select("host", F.explode(F.create_map(F.lit("trust"), F.coalesce("trust", F.lit(0)), F.lit("distrust"), F.coalesce("distrust", F.lit(0)))).alias("kind", "seed"))
    mass = stage(given.withColumn("own", F.floor(F.col("seed") * rest).cast("bigint")).withColumn("mass", F.col("own")).drop("seed"), "host-mass")
    for _ in range(rounds):
        sent = mass.where("mass > 0").join(ways, ["kind", "host"])
        sent = sent.groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.floor(F.col("mass") * F.col("share")).cast("bigint")).alias("_in"))
        after = mass.join(sent, ["kind", "host"], "left").select("host", "kind", "own", F.col("mass").alias("_before"), (F.col("own") + F.coalesce("_in", F.lit(0))).alias("mass"))
        after = stage(after, "host-mass")
        unstage(mass)
        mass = after.drop("_before")
        if after.where("mass <> _before").isEmpty():
            break

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0)).alias(kind)

    return mass.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    rounds: int = 20,
    least_percent: int = 50,
) -> DataFrame:
    """A verdict on every url: id, host, path, rule, verdict, trust, distrust (the masses of its host).

    The longest rule that fits decides. Where none fits, a page is blocked if
    its host's distrust exceeds its trust and is at least what a host gets of
    whose pages ``least_percent`` percent are blocked. Seeds are the shares of
    a host's pages that rules allow or block. Links between hosts come from
    the pages' hyperlinks and from domains (``domain_links``).

    A null url, or one without ``://``, has an empty host and path, fits no
    rule, is no node of the graph and is allowed; a null html has no links;
    repeated rows each get their verdict and count as pages; texts are read
    whole; an empty table gives an empty result.
    """
    known = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL")
    urls = pages.select(pages[id_col].alias("_id"), host_of(pages[url_col]).alias("_host"), path_of(pages[url_col]).alias("_path"))
    told = stage(fit_rules(urls, known), "url-rules")
    hosts = told.where("_host <> ''").groupBy(F.col("_host").alias("host")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("_says") == "allow", 1)).alias("_allowed"),
        F.count(F.when(F.col("_says") == "block", 1)).alias("_blocked"),
    )
    part = lambda c: F.floor(F.col(c) * F.lit(float(WHOLE)) / F.col("_n")).cast("bigint")
    seeds = stage(hosts.select("host", part("_allowed").alias("trust"), part("_blocked").alias("distrust")), "host-seeds")
    links = stage(host_links(pages, url_col, html_col), "host-links")
    named = seeds.select("host").union(links.select("dst")).distinct()
    masses = propagate(seeds, links.unionByName(domain_links(named)), damping, rounds)
    least = int((1 - damping) * WHOLE * least_percent) // 100
    masses = stage(masses.select(F.col("host").alias("_h"), "trust", "distrust"), "host-masses")
    out = _salted(told, masses, "_host", "_id", "_path")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)
    verdict = F.coalesce("_says", F.when(bad, "block").otherwise("allow"))
    zero = F.lit(0)
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", verdict.alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
