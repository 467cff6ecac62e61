"""Spelling variants, url filters and importance resampling against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import importance, spelling, url_filter

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGE = "page_id bigint, url string, html string"
LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_brute(rows, divisor=199, min_length=6, min_count=5, ratio=5):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % divisor == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * c else None
    out = set()
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, c, len(near[w]), words[form[w]] if form[w] else None))
    return out


def misspelt(seed, n, letters="abcÀÉéxÿ\u00d7"):
    """Texts over a few stems, their one- and two-edit variants and long runs."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices(letters, k=rng.randrange(5, 10))) for _ in range(12)] + ["Letter", "lettErs", "a" * 40]
    bag = []
    for s in stems:
        bag += [s] * rng.choice([2, 6, 30])
        for _ in range(8):
            v = list(s)
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(v))
                kind = rng.randrange(3)
                v[at : at + (kind > 0)] = [rng.choice(letters)] if kind < 2 else []
            bag += ["".join(v)] * rng.choice([1, 2, 6])
    return [(i, " ".join(rng.choices(bag, k=60)) + rng.choice(["", "!", "\n7 "]), None, None, None) for i in range(n)]


@pytest.mark.parametrize("seed,divisor", [(1, 199), (2, 3), (3, 1)])
def test_spelling(spark, seed, divisor):
    chain = ["chainaaa"] * 6 + ["chainaab"] * 14 + ["chainabb"] * 30 + ["chainbbb"] * 70 + ["chbinbbb"] * 160
    rows = misspelt(seed, 60) + [(99, " ".join(chain), None, None, None)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, DOC).repartition(3), divisor=divisor, ratio=2).collect()
    assert {tuple(r) for r in got} == spelling_brute(rows, divisor, ratio=2) and len(got) > 20
    if divisor == 199:
        assert {(r["word"], r["root"]) for r in got} >= {(w, "chbinbbb") for w in set(chain)}  # a chain of forms


def test_spelling_pairs_are_whole(spark):
    """All pairs at distance 1 of a random vocabulary, each once; few candidates beyond them."""
    rng = random.Random(7)
    vocab = sorted({"".join(rng.choices("abcd\u00e9", k=rng.randrange(6, 9))) for _ in range(900)})
    words = spark.createDataFrame([(w, 9) for w in vocab], "word string, n bigint").withColumn("mask", spelling.parity_mask(F.col("word")))
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(words).collect())
    assert got == sorted((a, b) for k, a in enumerate(vocab) for b in vocab[k + 1 :] if one_edit(a, b))


def test_spelling_odd_rows(spark):
    word, long = "spelling", "z" * 30_000
    rows = [(None, word, None, None, None)] * 3 + [(4, f"{word} {word}", None, None, None)] * 3 + [(5, None, None, None, None), (6, "", None, None, None), (7, " ".join([long] * 5 + ["spellings"] * 5), None, None, None)]
    df = spark.createDataFrame(rows, DOC)
    want = spelling_brute(rows, ratio=1)
    assert {tuple(r) for r in spelling.spelling_variants(df, ratio=1).collect()} == want and len(want) == 3
    wide = df.select("*", *(F.lit(1).alias(c) for c in ("_id", "word", "n", "mask", "form", "base", "half", "_run")))
    assert {tuple(r) for r in spelling.spelling_variants(wide, ratio=1).collect()} == want
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def judged(pages, rules, damping=0.85, rounds=20, least_percent=50):
    """Verdicts by loops over rows; masses in whole numbers as the operator has them."""
    split = []
    for i, url, html in pages:
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
        split.append((i, m[2].translate(LOWER) if m else "", m[3] if m else "", html or ""))
    seeds, links, out = defaultdict(lambda: [0, 0, 0]), Counter(), []
    for i, host, path, html in split:
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else None
        out.append([i, host, path, best[3] if best else None, best[4] if best else None])
        if host:
            s = seeds[host]
            s[0] += 1
            s[1] += bool(best) and best[4] == "allow"
            s[2] += bool(best) and best[4] == "block"
            for to in re.findall(url_filter.HYPERLINK, html):
                if to.translate(LOWER) != host:
                    links[host, to.translate(LOWER)] += 1
    names = set(seeds) | {b for _, b in links}
    for h in sorted(names):
        above = [h[k + 1 :] for k, c in enumerate(h) if c == "." and h[k + 1 :] in names]
        if above:
            links[h, above[0]] += 1
            links[above[0], h] += 1
    masses = []
    for side, ways in ((1, links), (2, {(b, a): n for (a, b), n in links.items()})):
        total = Counter()
        for (a, _), n in ways.items():
            total[a] += n
        own = {h: math.floor(math.floor(seeds[h][side] * 1e9 / seeds[h][0]) * (1 - damping)) if h in seeds else 0 for h in names}
        mass = dict(own)
        for _ in range(rounds):
            new = dict(own)
            for (a, b), n in ways.items():
                new[b] += math.floor(mass[a] * (damping * n / total[a]))
            mass = new
        masses.append(mass)
    for r in out:
        if r[4] is None:
            t, d = masses[0].get(r[1], 0), masses[1].get(r[1], 0)
            r[4] = "block" if d > t and d >= int((1 - damping) * 1e9 * least_percent) // 100 else "allow"
    return sorted(map(str, out))


def web(seed, n):
    rng = random.Random(seed)
    hosts = [f"{s}h{k}.{t}" for k in range(14) for s, t in [(rng.choice(["", "www.", "m.www."]), rng.choice(["com", "net", "org", "example.com"]))]] + ["www.example.com", "example.com", "a.b.example.com"]
    rows = []
    for i in range(n):
        h = hosts[0] if rng.random() < 0.3 else rng.choice(hosts)
        links = "".join(f'<p><a class=x {rng.choice(["HREF", "href"])} = {q}{rng.choice(["http://", "//", "https://"])}{rng.choice(hosts).title()}{rng.choice(["", "/x", "?q", "#"])}{q}>t</a><a href="/own">o</a>' for q in rng.choices(["'", '"', ""], k=rng.randrange(3)))
        path = rng.choice(["", "/", "/en", "/en/1", "/es/2?x=/fr/", "/fr/#a", "/de/3"])
        rows.append((i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice([h, h.upper()])}{path}", f"<body>{links}</body>"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_urls(spark, seed):
    rows = web(seed, 150)
    got = url_filter.judge_urls(spark.createDataFrame(rows, PAGE).repartition(3), url_filter.rules_table(spark)).drop("trust", "distrust").collect()
    assert sorted(str(list(r)) for r in got) == judged(rows, url_filter.RULES)


def test_distrust_flows_to_who_links_to_blocked_hosts(spark):
    spam = [(k, f"http://spam.bad/{k}", "") for k in range(8)]
    farm = [(20 + k, f"http://farm.org/{k}", "<a href=http://spam.bad/>x</a><a href='//spam.bad/2'>y</a>") for k in range(4)]
    good = [(40 + k, f"http://good.org/{k}", "<a href='http://news.org/'>n</a>") for k in range(4)]
    news = [(60, "http://news.org/a", ""), (61, "http://mixed.org/", "<a href=http://spam.bad/>x</a>")] + [(70 + k, "http://trusted.ok/", "<a href=http://mixed.org/>x</a>") for k in range(3)]
    rules = url_filter.rules_table(spark, [("bad", "/", "block"), ("ok", "/", "allow")])
    rows = spam + farm + good + news
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGE), rules).collect()}
    assert all(got[i]["verdict"] == "block" and got[i]["rule"] is None for i in (20, 21, 22, 23))
    assert all(got[i]["verdict"] == "allow" for i in (40, 41, 60, 61))  # 61 links to spam, but trusted pages link to it
    assert got[61]["trust"] > got[61]["distrust"] > 0
    without = url_filter.judge_urls(spark.createDataFrame([(i, u, None) for i, u, _ in rows], PAGE), rules).collect()
    assert {r["verdict"] for r in without if 20 <= r["page_id"] < 24} == {"allow"}  # it is the links that tell


def test_url_rules(spark):
    urls = ["http://X.example.com/en/a?b", "http://www.example.com/en/a", "http://example.com", "http://a.net/es/", "http://a.net/esx", "//no.scheme/x", None, "", "x://y://z/p#q", "http://h?u=://example.com/en/", "http://notexample.com/en/", "ftp://example.com:80/en/"]
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGE), url_filter.rules_table(spark)).join(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), "page_id").collect()}
    assert got[urls[0]] == ("x.example.com", "/en/a", "example.com/en/", "block")
    assert got[urls[1]] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[urls[2]] == ("example.com", "", None, "allow")  # an empty path starts with no rule's
    assert got[urls[3]][2:] == ("net/es/", "block") and got[urls[4]][2] is None
    assert all(got[u] == ("", "", None, "allow") for u in ("//no.scheme/x", None, ""))
    assert got[urls[8]][:2] == ("y:", "//z/p") and got[urls[9]][:2] == ("h", "")
    assert got[urls[10]][2] == "com/" and got[urls[11]][:3] == ("example.com:80", "/en/", None)


def test_url_odd_rows(spark):
    rows = [(1, None, None), (None, "http://a.com/x", "<a href='http://b.org/'>"), (None, "http://a.com/x", "<a href='http://b.org/'>"), (3, "http://b.org/", "<a " * 20_000 + "x" * 200_000), (4, "http://" + ".".join("abcdefghij" * 20) + ".com/", "")]
    df = spark.createDataFrame(rows, PAGE)
    plain = sorted(map(str, url_filter.judge_urls(df, url_filter.rules_table(spark)).collect()))
    assert len(plain) == 5 and all("'allow'" in r for r in plain)
    wide = df.select("*", *(F.lit("x").alias(c) for c in ("_id", "_host", "_path", "host", "path", "rule", "verdict", "_s", "_h", "src", "dst")))
    assert sorted(map(str, url_filter.judge_urls(wide, url_filter.rules_table(spark)).collect())) == plain
    assert url_filter.judge_urls(df.limit(0), url_filter.rules_table(spark)).collect() == []
    none = url_filter.rules_table(spark).limit(0)
    assert {r["verdict"] for r in url_filter.judge_urls(df, none).collect()} == {"allow"}


def resampled(rows, target, max_n=1, buckets=10_000, percent=10, min_words=20, seed="2024"):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]

    docs = [(i, *features(t)) for i, t, *_ in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in s}
    out = []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    best = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] if r[0] is not None else -1))
    drawn = {id(r): k + 1 for k, r in enumerate(best[: len(best) * percent // 100])}
    return sorted(map(str, (r[:4] + [drawn.get(id(r))] for r in out)))


def texts(seed, n):
    rng = random.Random(seed)
    vocab = [f"Wort{i}" if i % 7 else f"ñé{i}" for i in range(80)]
    return [(i, rng.choice(" .-").join(rng.choices(vocab, k=rng.choice([0, 1, 15, 20, 21, 90]))), None, None, None) for i in range(n)]


@pytest.mark.parametrize("max_n,buckets,percent", [(1, 10_000, 10), (2, 97, 35), (4, 1000, 100)])
def test_resample(spark, max_n, buckets, percent):
    rows, target = texts(1, 200), [t for _, t, *_ in texts(2, 20)]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = importance.resample(spark.createDataFrame(rows, DOC).repartition(3), aim, max_n=max_n, buckets=buckets, percent=percent).collect()
    assert sorted(str(list(r)) for r in got) == resampled(rows, target, max_n, buckets, percent)


def test_suffix_runs():
    """Every occurrence of every n-gram up to the bound, in the bucket of its words; suffixes in order."""
    for seed in range(4):
        words = importance.WordIds(pa.array([t for _, t, *_ in texts(seed, 30)] + ["a a a a a", "a a", ""]))
        order = importance.suffix_order(words.ids, words.doc, 4)
        ends = words.start[words.doc + 1]
        seen = [tuple(words.ids[k : min(k + 4, ends[k])]) for k in order]
        assert seen == sorted(seen)
        doc, bucket = importance.feature_buckets(words, 3, 1 << 30)
        want = Counter()
        for d in range(len(words.start) - 1):
            w = [words.unique[i] for i in words.ids[words.start[d] : words.start[d + 1]]]
            want.update((d, zlib.crc32(b" ".join(w[k : k + n])) % (1 << 30)) for n in (1, 2, 3) for k in range(len(w) - n + 1))
        assert Counter(zip(doc.tolist(), bucket.tolist())) == want


def test_resample_odd_rows(spark):
    long = " ".join(f"w{i % 991}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", None, None, None), (None, long, None, None, None), (3, long, None, None, None), (4, long, None, None, None), (4, long, None, None, None), (5, "\x00 . !", None, None, None)]
    df, aim = spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, None), (2, "w1 w2"), (2, "w1 w2")], "item_id bigint, text string")
    want = resampled(rows, ["", "w1 w2", "w1 w2"], percent=50)
    assert sorted(str(list(r)) for r in importance.resample(df, aim, percent=50).collect()) == want
    wide, target = df.select("*", *(F.lit("x").alias(c) for c in ("_id", "_text", "score", "rank", "weight", "bucket", "_in"))), aim.withColumn("bucket", F.lit(3))
    assert sorted(str(list(r)) for r in importance.resample(wide, target, percent=50).collect()) == want
    assert importance.resample(df.limit(0), aim).collect() == []
    assert sorted(str(list(r)) for r in importance.resample(df, aim.limit(0), percent=50).collect()) == resampled(rows, [], percent=50)


def test_resample_prefers_the_target(spark):
    rng = random.Random(5)
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(near if i % 5 == 0 else far, k=40)), None, None, None) for i in range(400)]
    aim = spark.createDataFrame([(1, " ".join(near))], "item_id bigint, text string")
    got = importance.resample(spark.createDataFrame(rows, DOC), aim).where("rank IS NOT NULL").collect()
    assert len(got) == 40 and np.mean([r["doc_id"] % 5 == 0 for r in got]) > 0.5  # a fifth without weights
