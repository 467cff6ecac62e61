"""Operators against brute force on small fixtures."""

import hashlib
import random
import re
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import classifier, decontaminate, jaccard, licenses, mixing, pages, rules, sharding, suffixes, tokens

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = [f"w{i}" for i in range(400)]


def corpus(seed, n, copies=0.4):
    """Texts with exact and near copies, shared passages and a hot source."""
    rng = random.Random(seed)
    passage = " ".join(rng.choices(VOCAB, k=60))
    texts = []
    for _ in range(n):
        r = rng.random()
        if texts and r < copies:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(VOCAB)
            texts.append(" ".join(words))
        else:
            words = rng.choices(VOCAB, k=rng.choice([0, 1, 3, 4, 5, 40, 120, 300]))
            if rng.random() < 0.4:
                at = rng.randrange(len(words) + 1)
                words[at:at] = passage.split(" ")
            texts.append(" ".join(words))
    return [(i, t, "en", "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}", len(t)) for i, t in enumerate(texts)]


def word_sets(rows, size):
    lower = {c: c + 32 for c in range(65, 91)}
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_brute(rows, size, percent):
    s = word_sets(rows, size)
    ids = sorted(s)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return {i: (len(s[i]), c) for i, c in components(ids, links).items()}


@pytest.mark.parametrize("size,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_jaccard(spark, size, percent, seed):
    rows = corpus(seed, 250)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOC).repartition(5), size, percent).collect()}
    assert got == jaccard_brute(rows, size, percent)


def test_jaccard_with_repeated_and_null_ids(spark):
    """All texts of an id are one node, a null id is none; brute force over texts."""
    rng = random.Random(21)
    rows = [((i // 2 if i % 5 == 0 else i) if i % 11 else None, t, *_) for i, t, *_ in corpus(21, 160)]
    rows += [(2000, rows[1][1], *rows[1][2:]), (2001, rows[2][1], *rows[2][2:]), (2002, rows[1][1], *rows[1][2:]), (2002, rows[2][1], *rows[2][2:])]
    rng.shuffle(rows)
    sets = word_sets([(k, t) for k, (_, t, *_) in enumerate(rows)], 4)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    ids = sorted({r[0] for r in rows if r[0] is not None})
    part = components(ids, [(rows[a][0], rows[b][0]) for a, b in links])
    equal = {frozenset(s): part[rows[k][0]] for k, s in sets.items() if s and rows[k][0] is not None}
    want = sorted(str((r[0], len(sets[k]), part[r[0]] if r[0] is not None else equal.get(frozenset(sets[k])))) for k, r in enumerate(rows))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOC).repartition(4), 4, 85).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == want


def test_jaccard_with_frequent_ngrams(spark, monkeypatch):
    """N-grams handed on early, hot partners in many salts and places that rows do not carry change nothing."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "MOST_HELD", 40)
    monkeypatch.setattr(jaccard, "SALT_ROWS", 2)
    monkeypatch.setattr(jaccard, "CARRIED", 1)
    rows = corpus(4, 250, copies=0.7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOC).repartition(5), 2, 70).collect()}
    assert got == jaccard_brute(rows, 2, 70)


def repeats_brute(rows, length):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        t = np.array([rng.randrange(rng.choice([1, 2, 200])) for _ in range(rng.randrange(50))], np.int64)
        assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i, t=t: t[i:].tolist())


@pytest.mark.parametrize("most", [4096, 2])
def test_repeats(spark, monkeypatch, most):
    """Also with nearly all anchors settled window by window."""
    monkeypatch.setattr(suffixes, "MOST_SEGMENTS", most)
    rows = corpus(5, 200) + [(900, "ab" * 300, "en", "x", 0), (901, "aaaa" * 100, "en", "x", 0), (902, "é" * 150, "en", "x", 0)]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.remove_repeats(spark.createDataFrame(rows, DOC).repartition(4)).collect()}
    assert got == repeats_brute(rows, 100)


def test_repeats_with_repeated_and_null_ids(spark):
    """Different texts of one id are documents of their own: only what occurs twice goes."""
    rng = random.Random(31)
    a, b, c = (" ".join(rng.choices(VOCAB, k=40)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, b + " x"), (None, c + " tail"), (3, c), (4, a + b), (4, a + b)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    n = lambda t: len(t.encode())
    assert sorted(x for x in got if x[0] in (1, 3, 4)) == [(1, n(a), 0), (3, n(c), n(c)), (4, n(a + b), n(a + b)), (4, n(a + b), n(a + b))]
    assert sorted(x for x in got if x[0] == 2) == sorted([(2, n(a), n(a)), (2, n(b), n(b))])  # b stands under a null id, which comes first
    nulls = sorted(x[1:] for x in got if x[0] is None)
    assert (n(b + " x"), 0) in nulls and sum(gone for _, gone in nulls) == n(c)
    alone = suffixes.remove_repeats(spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in alone) == [(1, 0), (2, 0), (2, n(a))]


def test_mixing_follows_weights(spark):
    rng = random.Random(3)
    sizes = {"a": 900, "b": 300, "c": 240, None: 60}
    rows = [(i, s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    rng.shuffle(rows)
    weights = {"a": 0.5, "b": 0.25, "c": 0.15, None: 0.1}
    block = 4
    got = sorted((r["position"], r["source"], r["block"], r["doc_id"]) for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string"), weights, block_rows=block, frame=100).collect())
    assert [g[0] for g in got] == list(range(1500)) and len({g[3] for g in got}) == 1500
    # Within one block of the target as long as no source has run out.
    active = min(n / weights[s] for s, n in sizes.items())
    seen = dict.fromkeys(sizes, 0)
    for t, (_, s, _, _) in enumerate(got[: int(active) // block * block], 1):
        seen[s] += 1
        if t % block == 0:
            assert all(abs(seen[k] / block - t / block * w) < 1 for k, w in weights.items())


def mix_brute(sizes, quota, block):
    """The schedule by simulation: slot by slot, earliest deadline first among released blocks, exhausted sources idle."""
    frame, blocks = sum(quota), [-(-n // block) for n in sizes]
    nxt, out, slot = [0] * len(sizes), [], 0
    while any(n < b for n, b in zip(nxt, blocks, strict=True)):
        ready = [(-(-(nxt[i] + 1) * frame // quota[i]), i) for i in range(len(sizes)) if nxt[i] * frame // quota[i] <= slot]
        i = min((d, i, ) for d, i in ready)[1] if ready else None
        if i is not None:
            if nxt[i] < blocks[i]:
                out.append((i, nxt[i]))
            nxt[i] += 1
        slot += 1
    return out


def test_mixing_against_simulation(spark):
    sizes = [50, 20, 9]
    rows = [(i, s) for i, s in enumerate(x for s, n in zip("abc", sizes, strict=True) for x in [s] * n)]
    quota = mixing.quanta([n**0.5 for n in sizes], 64)
    got = sorted((r["position"], "abc".index(r["source"]), r["block"]) for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string"), block_rows=4, frame=64).collect())
    order = list(dict.fromkeys((s, b) for _, s, b in got))
    assert order == mix_brute(sizes, quota, 4)


@pytest.mark.parametrize("sizes", [{f"s{i:02}": 600 for i in range(20)}, {"hot": 4000} | {f"s{i:02}": 421 for i in range(19)}])
def test_mixing_does_not_drift(spark, sizes):
    """Within one block of the true weights at every slot of a long stream, though 1 / 20 and square roots are no multiples of 1 / 1024."""
    rows = [(i, s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    got = sorted((r["position"], r["source"], r["doc_id"]) for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string"), block_rows=1).collect())
    assert [g[0] for g in got] == list(range(len(rows))) and len({g[2] for g in got}) == len(rows)
    weights = {s: n**0.5 / sum(m**0.5 for m in sizes.values()) for s, n in sizes.items()}
    active = min(n / weights[s] for s, n in sizes.items())
    seen = dict.fromkeys(sizes, 0)
    for t, (_, s, _) in enumerate(got[: int(active)], 1):
        seen[s] += 1
        assert all(abs(seen[k] - t * w) < 1 + 1e-9 for k, w in weights.items())


def fluid(weights, blocks):
    """Per source the fluid schedule's blocks at each whole slot; a source that has run out leaves its share to the others."""
    done, at, out = [Fraction(0)] * len(blocks), Fraction(0), [[Fraction(0)] for _ in blocks]
    left = {i for i, n in enumerate(blocks) if n}
    while left:
        act = sum(weights[i] for i in left)
        step = min(Fraction(int(at) + 1) - at, *((blocks[i] - done[i]) * act / weights[i] for i in left))
        for i in left:
            done[i] += step * weights[i] / act
        at += step
        left = {i for i in left if done[i] < blocks[i]}
        if at.denominator == 1:
            for i, d in enumerate(done):
                out[i].append(d)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_slots_follow_the_fluid_schedule(spark, seed):
    """Every block once, one a slot, within one block of the fluid schedule at every slot of every source, whatever the frames, also after sources have run out."""
    rng = random.Random(seed)
    weights = [rng.choice([1, 2, 3, 7, 20]) for _ in range(rng.randrange(2, 9))]
    blocks = [rng.choice([1, 5, 40, 150]) for _ in weights]
    want = fluid([Fraction(w) for w in weights], blocks)
    for frame in (1, 64, 10**6):
        got = sorted((r["slot"], r["s"], r["block"]) for r in mixing.block_slots(spark, weights, blocks, frame).collect())
        assert [x for x, *_ in got] == list(range(sum(blocks)))
        seen = [0] * len(blocks)
        for t, (_, s, j) in enumerate(got, 1):
            assert j == seen[s]
            seen[s] += 1
            assert all(abs(n - want[i][t]) < 1 for i, n in enumerate(seen)), (t, seen)


def test_slots_of_a_long_stream(spark):
    """Within one block of irrational weights over many frames, one source a third of all."""
    blocks = [6_000] + [640] * 19
    target = [n**0.5 for n in blocks]
    got = mixing.block_slots(spark, mixing.exact(target), blocks).orderBy("slot").toPandas()
    assert (got["slot"] == range(len(got))).all() and len(got.drop_duplicates(["s", "block"])) == sum(blocks)
    active = int(min(n / w for n, w in zip(blocks, target, strict=True)) * sum(target))
    for s, w in enumerate(target):
        seen = (got["s"] == s).cumsum()[:active]
        assert (abs(seen - (seen.index + 1) * w / sum(target)) < 1 + 1e-6).all()


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.choice([0, 1, 10, 50, 4000])) for i in range(3000)] + [(10_000 + i, "the same") for i in range(1500)]
    got = sharding.shard_by_size(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), 24).collect()
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append(r)
    assert sorted(held) == list(range(24)) and len(got) == len(rows)
    total = sum(r["size"] for r in got)
    for rs in held.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / 24) <= 4008
    order = sharding.shard_by_size(spark.createDataFrame([(i, "ab") for i in range(100)], "doc_id bigint, text string"), 5, order_col="doc_id").collect()
    assert [r["doc_id"] for r in sorted(order, key=lambda r: (r["shard"], r["slot"]))] == list(range(100))


@pytest.mark.parametrize("per_range", [500_000, 40])
def test_shards_keep_the_key_order(spark, per_range):
    """Also where sizes are heavy-tailed, one text is hot and ranges are subdivided again and again."""
    rng = random.Random(18)
    rows = [(i, "x" * min(200_000, int(rng.paretovariate(0.7)))) for i in range(2500)] + [(10_000 + i, "the same") for i in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    size = {i: len(t) + 8 for i, t in rows}
    total, at, want = sum(size.values()), 0, {}
    for i in sorted(size):
        want[i] = min(23, int((at + size[i] / 2) * 24 / total))
        at += size[i]
    got = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard_by_size(df, 24, order_col="doc_id", rows_per_range=per_range).collect())
    assert [i for *_, i in got] == sorted(size) and {i: s for s, _, i in got} == want
    # By a table of places, against the ids' order; equal texts stand together where there is none.
    places = spark.createDataFrame([(i, -i) for i in size], "doc_id bigint, place bigint")
    got = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard_by_size(df, 24, order=places, rows_per_range=per_range).collect())
    assert [i for *_, i in got] == sorted(size, reverse=True)
    crcs = [c for *_, c in sorted((r["shard"], r["slot"], r["text_crc32"]) for r in sharding.shard_by_size(df, 24, rows_per_range=per_range).collect())]
    assert 1 + sum(a != b for a, b in zip(crcs, crcs[1:])) == len({t for _, t in rows})


def test_tokens(spark):
    vocabulary = tokens.read_vocabulary(open(tokens.DEFAULT_VOCABULARY, "rb").readlines())
    known = set(vocabulary)

    def greedy(w):
        i = n = 0
        while i < len(w):
            j = len(w)
            while w[i:j] not in known:
                j -= 1
            i, n = j, n + 1
        return n

    texts = ["The quick brown fox, jumped.", "naïve Übergröße 北京 😀", "a" * 3000, "  tabs\tand\x0blines\n", "internationalization" * 20]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: sum(greedy(b" " + w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        tokens.LongestMatch([b"a"])
    # One byte can pop hundreds of tokens.
    long = tokens.LongestMatch([bytes([c]) for c in range(256)] + [b"a" * 600 + b"c"])
    assert long.counts([b"a" * 599 + b"b", b"a" * 600 + b"c", b"a" * 601 + b"c", b"a" * 1300]).tolist() == [600, 1, 2, 1300]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_leaks(spark):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choices(VOCAB, k=rng.choice([5, 8, 20, 40])))) for k in range(30)]
    rows, planted = [], set()
    for i in range(120):
        words = rng.choices(VOCAB, k=60)
        if i % 2:
            k = rng.randrange(30)
            w = items[k][1].split()
            for _ in range(int(0.2 * len(w)) if i % 4 == 1 else 0):
                w[rng.randrange(len(w))] = "other"
            words[30:30] = w
            planted.add((i, k))
        rows.append((i, ", ".join(words).upper() if i % 3 else " ".join(words)))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_items=7).collect()}
    assert len(planted & set(got)) >= 0.97 * len(planted)
    plain = {i: re.findall(r"\w+", t.lower()) for i, t in rows}
    for (i, k), r in got.items():
        item = items[k][1].split()
        assert r["distance"] <= int(0.2 * len(item)) and edit(item, plain[i][r["start_word"] : r["end_word"]]) == r["distance"]


def nearest(item, words):
    """Smallest edit distance of the item to any run of the words, its first end and latest start."""
    row = [(0, -j) for j in range(len(words) + 1)]
    for i, a in enumerate(item, 1):
        old, row = row, [(i, 0)]
        for j, b in enumerate(words):
            row.append(min((old[j][0] + (a != b), old[j][1]), (old[j + 1][0] + 1, old[j + 1][1]), (row[j][0] + 1, row[j][1])))
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[end][0], -row[end][1], end


def test_leaks_at_the_threshold_are_all_found(spark):
    """Substitutions, insertions and deletions up to the budget, at any item length; all pairs against the full table of distances."""
    rng = random.Random(12)
    items = [(k, " ".join(rng.choices(VOCAB, k=n))) for k, n in enumerate([1, 4, 5, 9, 15, 30, 50, 59, 100, 200])]
    rows, planted = [], set()
    for k, text in items:
        for kind in ("delete", "mixed", "insert") * 5:
            w = text.split()
            for at in sorted(rng.sample(range(len(w)), int(0.2 * len(w))), reverse=True):
                step = rng.choice(["delete", "insert", "replace"]) if kind == "mixed" else kind
                w[at : at + (step != "insert")] = [] if step == "delete" else ["other"]
            planted.add((len(rows), k))
            rows.append((len(rows), " ".join(rng.choices(VOCAB, k=15) + w + rng.choices(VOCAB, k=15))))
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start_word"], r["end_word"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert planted <= set(got)
    every = {(i, k): nearest(x.split(), t.split()) for i, t in rows for k, x in items if k % 3 == 0 or (i, k) in planted}
    most = {k: int(0.2 * len(x.split())) for k, x in items}
    assert {p: v for p, v in got.items() if p in every} == {p: v for p, v in every.items() if v[0] <= most[p[1]]}


def test_leaks_sampling():
    """How many places are sampled follows from the length; unrelated windows mostly fall through; memory is bounded."""
    needed = {n: decontaminate.samples_for(decontaminate.calibrated(n), 0.8, 0.9999) for n in (1, 4, 5, 9, 20, 59, 100, 200)}
    assert needed[4] <= needed[59] <= needed[200] and all(0 < s <= decontaminate.MOST_SAMPLES for s in needed.values()), needed
    rng = random.Random(3)
    items = decontaminate.Items(list(range(40)), [" ".join(rng.choices(VOCAB, k=4000 if k == 0 else 50)) for k in range(40)], 0.8, 0.9999)
    assert sum(x.nbytes for x in items.sampled.values()) <= 8 * decontaminate.WALKS * decontaminate.MOST_SAMPLES * 40
    other = decontaminate.word_hashes(pa.array([" ".join(f"z{i}" for i in range(500))]))[0]
    near = items.candidates(other, np.arange(1, 40), 10 * np.arange(39), np.full(39, 500))
    own = np.concatenate(items.words[1:])
    same = items.candidates(own, np.arange(1, 40), 50 * np.arange(39), 50 * np.arange(1, 40))
    assert not near.any() and same.all()


def test_rules_against_counts(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(VOCAB[:12], k=rng.randrange(120))) + "\n" + rng.choice(["x", "", "# a", "x"]) + "\nx" for _ in range(80)] + ["", "a b c a b c a b c"]
    got = {r["doc_id"]: r for r in rules.rule_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), keep=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + o for k, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert got[i]["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))


def test_bad_hosts_go(spark):
    rows = [("good", False)] * 95 + [("good", True)] * 5 + [("bad", True)] * 90 + [("bad", False)] * 10 + [("few", True)]
    v = {r["host"]: r for r in rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean"), "host", "failed", 0.6).collect()}
    assert v["bad"]["host_rejected"] and not v["good"]["host_rejected"] and 0.4 < v["few"]["host_rate"] < 1.0


def filled(template, name="Software"):
    """A template's wording with its optional parts and one word at each place of a name."""
    return re.sub(r"<<var \d+>>", name, template.replace("<<opt>>", "").replace("<</opt>>", ""))


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_whole_licenses(label):
    scan = licenses.LicenseScanner().scan
    words = licenses.words_of("Intro. " + filled(licenses.TEMPLATES[label][0]) + " The end.")
    assert [(x[0], x[2], x[3]) for x in scan(words)[1]] == [(1, label, True)]
    # A text that breaks off, or lacks a word of the wording, is not the licence.
    assert not [x for x in scan(words[: len(words) // 2])[1]]
    kept = [w for w in words if w != {"zlib": "altered", "unlicense": "perpetuity"}.get(label, "software")]
    assert not [x for x in scan(kept)[1] if x[3]]


def test_notices(spark):
    rows = [
        (1, filled(licenses.TEMPLATES["isc"][0]), "isc", 1.0),
        (2, "Released under the MIT License.", "mit", 0.8),
        (3, "This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0", 0.8),
        (4, "This program is " + filled(licenses.NOTICES["lgpl-2.1"][0]), "gpl,lgpl-2.1", 0.8),  # the phrase is in it
        (5, "an apache license of some kind", "apache", 0.5),
        (6, "the \u201cSoftware\u201d is free", "", 0.0),
        (7, filled(licenses.TEMPLATES["mit"][0]).replace('"AS IS"', "\u201cAS IS\u201d"), "mit", 1.0),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["labels"], r["score"]) for r in got) == [(i, labels, score) for i, _, labels, score in rows]
    own = licenses.LicenseScanner({"x": ["alpha <<var 1>> beta"]})
    assert own.scan("alpha beta alpha q beta".split())[1] == [(0, 2, "x", True), (2, 5, "x", True)]
    with pytest.raises(ValueError):
        licenses.LicenseScanner({"x": ["<<opt>>alpha<</opt>>"]})


@pytest.mark.parametrize("seed", range(6))
def test_license_scan_against_patterns(seed):
    """Automata accept what the template's regular expression does, at every start, for random templates and texts."""
    rng = random.Random(seed)

    def part(depth):
        kind = rng.random()
        if kind < 0.25 and depth < 2:
            inner = [part(depth + 1) for _ in range(rng.randint(1, 2))]
            return "<<opt>>" + " ".join(x[0] for x in inner) + "<</opt>>", "(?:" + "".join(x[1] for x in inner) + ")?"
        if kind < 0.4:
            n = rng.randint(1, 3)
            return f"<<var {n}>>", r"(?:\S+ ){0,%d}" % n
        word = rng.choice("abc")
        return word, word + " "

    for _ in range(60):
        parts = [part(0) for _ in range(rng.randint(1, 5))]
        automaton = licenses.TemplateAutomaton("a " + " ".join(x[0] for x in parts))
        pattern = re.compile("a " + "".join(x[1] for x in parts))
        words = [rng.choice("abcd") for _ in range(25)]
        for at in range(len(words)):
            ends = [e for e in range(at, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[at:e]))]
            assert automaton.match(words, at) == (ends[0] if ends else None)


def test_license_automata():
    assert licenses.words_of("MIT-License é\x7f9") == ["mit", "license", "é", "9"]
    a = licenses.TemplateAutomaton("a <<opt>>b <<opt>>c<</opt>><</opt>> <<var 2>> d")
    for text, ok in (("a d", 1), ("a b d", 1), ("a b c x y d", 1), ("a x y z d", 0), ("a b", 0), ("a c d", 1), ("b d", 0)):
        assert (a.match(text.split(), 0) is not None) == bool(ok), text


def test_style_trees(spark):
    """What repeats on a host is cut although nothing in its markup tells; articles stay, copies too."""
    def page(k, body, menu="Home Shop About"):
        return f"<html><body><div class='x1'>{menu}</div><div class='x2'>{body}</div><div class='x3'>All rights kept, 2024</div></body></html>"

    rows = [(k, f"http://site.example/{k}", page(k, f"<p>Story {k} is of its own kind, number {k * 7}.</p><p>More on {k}.</p>")) for k in range(20)]
    rows += [(100 + k, f"http://mirror.example/{k}", page(k, "<p>One and the same long article on every page of this host.</p>")) for k in range(20)]
    rows += [(200, "http://lone.example/", page(0, "<p>Only page.</p>"))]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Story 3 is of its own kind, number 21.\nMore on 3."
    assert "One and the same long article" in got[105]
    assert got[200] == "Home Shop About\nOnly page.\nAll rights kept, 2024"


def test_tree_against_counts(spark):
    """Importances of every node, against a plain count over the pages; pages with and without article, presentation included."""
    rng = random.Random(14)
    rows = []
    for k in range(60):
        body = "".join(f"<p>{' '.join(rng.choices(VOCAB, k=rng.randrange(1, 9)))}</p>" for _ in range(rng.randrange(1, 4)))
        body = f"<article>{body}</article>" if k % 2 else f"<div class='text'>{body}</div>"
        rows.append((k, f"http://h{k % 2}.example/{k}", f"<body><nav><ul><li>{rng.choice(VOCAB)}<li>b</ul></nav>{body}<div class='ad'>{rng.choice(VOCAB[:5])}</div><footer>f</footer>"))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("substring(url, 8, 2) AS _host", "html AS _html")
    got = {(r["host"], r["path"]): r for r in pages.style_tree(df).collect()}
    want = {}
    for _, url, html in dict((r[2], r) for r in rows).values():
        for path, node in pages.branches(pages.blocks(html)).items():
            want.setdefault((url[7:9], path), []).append(node)
    want = {k: v for k, v in want.items() if len(v) >= 8}
    assert set(got) == set(want) and {p for _, p in got} >= {"body>nav>ul>li", "body>footer", "body>article>p", "body>div.text", "body>div.ad"}

    def entropy(values):
        n = len(values)
        return -sum(values.count(v) / n * np.log(values.count(v) / n) for v in set(values)) / np.log(n)

    for k, v in want.items():
        content, layout, share = zip(*v, strict=True)
        r = got[k]
        assert r["pages"] == len(v) and abs(r["share"] - sum(share) / len(v)) < 1e-9
        assert abs(r["content"] - entropy(content)) < 1e-9 and abs(r["layout"] - entropy(layout)) < 1e-9
        assert sorted(r["repeats"]) == sorted(c for c in set(content) if content.count(c) >= 8)


def test_class_words_and_articles_do_not_decide_alone(spark):
    """A text under a class word stays where it is what its pages are about; so does one beside an article that is a mere teaser."""
    own = [f"<p>{' '.join(random.Random(k).choices(VOCAB, k=40))}</p>" * (1 + k % 7) for k in range(30)]
    rows = [(k, f"http://notices.example/{k}", f"<div class='notice'>{own[k]}</div><div class='promo'>Buy {k}</div>") for k in range(30)]
    rows += [(100 + k, f"http://teasers.example/{k}", f"<div class='story'>{own[k]}</div><article><p>Next: story {k}</p></article>") for k in range(30)]
    got = {r["page_id"]: r for r in pages.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(30):
        text = pages.main_text(pages.blocks(own[k]))
        assert got[k]["text"] == text and got[k]["n_cut"] == 1
        assert got[100 + k]["text"].startswith(text)


@pytest.mark.parametrize("piece", ["<a b", "<a '", '<a x="', "<", "<!", "<svg>", "<div>", "</p>", "<li>", "<p>", "<b><li>", "<a ' \">", "<span class='ad'>", "&", "<div>x", "<!--", "<a<"])
def test_markup_in_linear_time(piece):
    began = time.process_time()
    pages.main_text(pages.blocks(piece * 2_000))
    small = time.process_time() - began
    began = time.process_time()
    pages.main_text(pages.blocks(piece * 16_000))
    assert time.process_time() - began < max(1.0, 24 * small)


def test_own_content_stays_in_a_repeated_branch(spark):
    """A page is cut where it repeats its host, not where others do; headings of an article template stay; many variants are no repeat."""
    def page(k, body):
        return f"<html><body><div class='x2'><p>{f'Story {k} is of its own kind, number {k * 7}. ' * 6}</p></div>{body}</body></html>"

    rows = [(k, f"http://lists.example/{k}", page(k, f"<ul><li>{'See all' if k < 190 else f'Part {k} of the set'}</li></ul>")) for k in range(200)]
    rows += [(1000 + k, f"http://heads.example/{k}", f"<article><h2>Overview</h2><p>{f'Text {k} of an article. ' * 9}</p></article>") for k in range(200)]
    rows += [(3000 + k, f"http://many.example/{k}", page(k, f"<div class='v'>Variant {k % 5}</div>")) for k in range(6000)]
    rows += [(20000, "http://lists.example/x", "<html><body><ul><li>See all</li></ul></body></html>")]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert not [k for k in range(190) if "See all" in got[k]]
    assert all(f"Part {k} of the set" in got[k] for k in range(190, 200))
    assert all(got[1000 + k].startswith("Overview\n") for k in range(200))
    assert all(f"Variant {k % 5}" in got[3000 + k] for k in range(6000))
    assert got[20000] == "See all"


def test_markup():
    html = """<html><head><title>x</title><script>var t="</p>";</script></head><body><header><a>Home</a></header><nav><ul><li>M</ul></nav>
    <div class="ad">Buy</div><article><h1>T &amp; U</h1><p><b>Bold<br><p>Two
 lines <i>it</i> x &lt; y</p><div class="comments"><p>reader</p></div><form><p>join</p></form><ul><li>a<li>b</ul><p>3 < 4</article><aside>s</aside><footer>f</footer></body></html>"""
    assert pages.main_text(pages.blocks(html)) == "T & U\nBold\nTwo lines it x < y\na\nb\n3 < 4"


@pytest.mark.parametrize(
    "markup,text",
    [
        ("<body class='has-sidebar'><article class='post no-sidebar long-form'><p>A</p></article>", "A"),
        ("<main><div class='cookieBanner'>x</div><p>A<div id='user-comments'><article class='comment'>y</article></div></main>", "A"),
        ("<div class='page-header'>h</div><div><p>A &nbsp; B</p><p class='notice'>n</p><div role='navigation'>m</div></div>", "A B"),
        ("<article><header><h1>T</h1></header><table><tr><td>1<td>2<tr><td>3</table><pre>a\n b</pre><footer>f</footer></article>", "T\n1\n2\n3\na b"),
        ("<p>a<!-- x <p>y -->b<style>p{}</style><select><option>o</select><p hidden>h</p>", "ab"),
        ("a < b &lt;c&gt; &#233;&#x41;", "a < b <c> éA"),
        ("One <a class='share'>Share<p>Body</p><p>Two</p> see <a>link</a> tail", "One\nBody\nTwo\nsee link tail"),
        ("<p>x</p><span class='ad'><span>buy</span> now cheap</span> y", "x\ny"),
        ("<p>x <b class='promo'>buy <i>now</i></b> y <b class='ad'>never closed</p><p>z", "x y\nz"),
        ("<div>" * 70 + "<div class='advert'>buy</div><p>" + "text " * 30, ("text " * 30).strip()),
        ("<form><p>The whole page is one form</p><label>Name</label><button><div>Go</div></button></form>", "The whole page is one form"),
        ("<form><nav>m</nav><main><p>A</p></main><p>beside</p></form>", "A"),
        ("<article><p>A</p></article><form>sign in here with a good many words of its own</form>", "A"),
        ("<article><p>A</p><form><p>join</p></form></article>", "A"),
        ("<p>A</p><button>never closed<p>B</p>", "A\nnever closed\nB"),
        ("<p>A long story is told here</p><div class='user-reviews'>Great</div>", "A long story is told here"),
    ],
)
def test_markup_cases(markup, text):
    assert pages.main_text(pages.blocks(markup)) == text


def test_classifier_sample_is_bounded(spark):
    """A hot id brings one text to the sample; null ids are not held out and not trained on."""
    docs = spark.createDataFrame([(1, f"text {i} of a hot id") for i in range(500)] + [(i, f"some text {i}") for i in range(40)] + [(None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id bigint, quality int")
    model = classifier.fit(docs, labels, max_rows=10)
    scored = classifier.score(docs, model).select("doc_id", classifier.held_out().alias("held_out"), "score").collect()
    assert len(scored) == 541 and all(r["held_out"] in (True, False) and 0 <= r["score"] <= 1 for r in scored)
    assert classifier.fit(docs.orderBy(F.rand(3)), labels, max_rows=10).__dict__.keys() == model.__dict__.keys()


def test_classifier_held_out(spark, small):
    d, labels = spark.read.parquet(f"{small.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{small.replace('0.001', '0.1')}/labels.parquet")
    model = classifier.fit(d, labels, max_rows=3000)
    r = classifier.score(d, model).where(classifier.held_out()).join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] >= 0.95 and 0 <= r["lo"] <= r["hi"] <= 1
