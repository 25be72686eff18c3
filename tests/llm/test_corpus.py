"""Operators over whole tables, against brute force and their stated laws."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from scenespark.llm import common, covertree, licenses, mixing, pitman_yor, sharding, simhash

from .edges import SCHEMA, TEXTS, documents, labels
from .test_texts import chained


def words(text):
    return (text or "").encode().split()


# --- sharding ---------------------------------------------------------------------------------------
def test_shards_match_the_mixture(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i}", "en", rng.choice(["big"] * 8 + ["b", "c", None])) for i in range(1003)]
    got = sharding.shard_rows(documents(spark, rows), 8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1003))
    sizes, by = Counter(r["shard"] for r in got), defaultdict(Counter)
    for r in got:
        by[r["source"]][r["shard"]] += 1
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for of, n in by.items():
        assert all(abs(n[k] - sum(n.values()) / 8) <= 2 for k in range(8)), of
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    again = sharding.shard_rows(documents(spark, rows[::-1]), 8).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_shard_edges(spark):
    got = sharding.shard_rows(documents(spark), 8).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in TEXTS), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    assert Counter(Counter(r["shard"] for r in got).values()) == {1: 3, 2: 5}
    few = sharding.shard_rows(documents(spark, TEXTS[:3]), 8).collect()
    assert len(few) == 3 and all(r["slot"] == 0 for r in few) and len({r["shard"] for r in few}) == 3
    assert sharding.shard_rows(documents(spark, []), 8).count() == 0


# --- mixing -----------------------------------------------------------------------------------------
def water(sizes, weights, most, share):
    """Round by round: give the rest by weight, clamp what is full, and give again."""
    budget, full = share * sum(sizes), {}
    while True:
        left = budget - sum(full.values())
        w = sum(x for k, x in enumerate(weights) if k not in full)
        goal = {k: left * x / w for k, x in enumerate(weights) if k not in full} if w else {}
        over = {k: most * sizes[k] for k, g in goal.items() if g > most * sizes[k] + 1e-9}
        if not over:
            return [{**goal, **full}[k] for k in range(len(sizes))]
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 50, 1000, 10000]) for _ in range(9)]
    weights = [rng.choice([1, 2, 5, 20]) for _ in sizes]
    most, share = rng.choice([1.5, 3]), rng.choice([0.4, 1.0])
    t = spark.createDataFrame([(f"s{k}", s, float(w)) for k, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(t, most, share).collect()}
    assert [got[f"s{k}"] for k in range(9)] == pytest.approx(water(sizes, weights, most, share), abs=1e-6)


def test_mix_comes_near_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice(["a"] * 20 + ["b", "c", None])) for i in range(3000)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == 3000
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for of, rs in by.items():
        total = sum(r["size"] for r in rs)
        assert all(r["source_size"] == total and r["taken"] <= 3 * r["size"] and r["target"] <= 3 * total + 1e-6 for r in rs)
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 60, of
        assert max(r["repeats"] for r in rs) - min(r["repeats"] for r in rs) <= 1
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_edges(spark):
    got = mixing.mix(documents(spark)).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((r[0], len(words(r[1]))) for r in TEXTS), key=str)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(documents(spark, [(1, None, None, None), (2, " ", "en", "a")])).collect())


# --- licences ---------------------------------------------------------------------------------------
def test_licences_and_inheritance(spark):
    from pyspark.sql import functions as F

    whole = dict(licenses.FILES)
    rows = [
        ("a/LICENSE", "Copyright 2020 some holder\n\n" + whole["MIT"]),
        ("a/b/c/code", "some code without a header"),
        ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
        ("a/other", "plain words"),
        ("z/file", "plain words"),
        ("z/own", "first line\nThis work is licensed under the GNU General Public License, version 3.\nlast line " + "with many words " * 50),
        (None, "plain"),
        ("a/b/null", None),
        ("a/b/empty", ""),
        ("a/b/empty", ""),
        ("z/short", "Released under the MIT License."),
        ("z/wrapped", "/* This Source Code Form is subject to\n * the terms of the Mozilla Public\n * License, v. 2.0.\n */ code"),
        ("y/terms", whole["BSD-3-Clause"].replace(" ", "\n")),
        ("y/code", "nothing here"),
    ]
    docs = spark.createDataFrame([(k, p, t, 1, "x") for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string, unit int, term string")
    got = {r["doc_id"]: r for r in licenses.license_scan(docs, F.col("path")).collect()}
    assert len(got) == len(rows)
    # a short text that is a header alone is no licence file: z/file inherits nothing from z/short
    want = ["MIT", "Apache-2.0", "Apache-2.0", "MIT", None, "GPL-3.0", None, "Apache-2.0", "Apache-2.0", "Apache-2.0", "MIT", "MPL-2.0", "BSD-3-Clause", "BSD-3-Clause"]
    assert [got[k]["license"] for k in range(len(rows))] == want
    assert got[1]["inherited_from"] == "a/b" and got[3]["inherited_from"] == "a" and got[5]["file_license"] is None and got[10]["file_license"] is None
    assert got[2]["own_score"] == pytest.approx(1.0)
    assert licenses.license_scan(docs.limit(0), F.col("path")).count() == 0


def test_licence_prefilter_loses_nothing():
    """Random texts of template terms and others: whatever reaches the threshold has a needed term."""
    import re

    rng = random.Random(3)
    every = (*licenses.TEMPLATES, *licenses.FILES)
    other, idf, weights = licenses.weighed(every)
    terms = licenses.needed(weights, 0.6)
    some = re.compile(licenses.found_by(terms).replace(r"[\p{L}\p{N}]", r"[^\W_]"))
    assert not some.search("licensing unfreed xmit")
    reached = 0
    for _ in range(4000):
        own = rng.choice(weights)
        words = [t for t in own if rng.random() < rng.choice([0.2, 0.5, 0.9])] + ["zzz"] * rng.randrange(3)
        c = Counter(words)
        v = {t: (math.log(n) + 1) * idf.get(t, other) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        if norm and max(sum(x * w.get(t, 0.0) for t, x in v.items()) for w in weights) / norm >= 0.6:
            reached += 1
            assert some.search(" ".join(words)) and set(terms) & set(words)
    assert reached > 500


def test_licence_edges(spark):
    got = licenses.license_scan(documents(spark)).collect()
    assert len(got) == len(TEXTS) and {r["doc_id"]: r["license"] for r in got} == {r[0]: "MIT" if r[0] == 10 else None for r in TEXTS}


# --- language model -----------------------------------------------------------------------------------
def corpus(n=400, seed=4):
    rng = random.Random(seed)
    langs = [(["the", "of", "is"], [f"ea{k}" for k in range(60)]), (["de", "la", "et"], [f"fo{k}" for k in range(60)])]
    rows = []
    for i in range(n):
        small, large = langs[i % 2]
        rows.append((i, " ".join(rng.choice(small) if rng.random() < 0.4 else large[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randrange(1, 40))), "x", "a"))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_base_scores_and_gain(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in pitman_yor.scores(documents(spark, rows)).collect()}
    toks = {r[0]: [*words(r[1].lower()), b""] for r in rows}
    c = Counter(t for i, ts in toks.items() if not held(i) for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ts), sum(c[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), abs=1e-6)
    out = [r for r in got.values() if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def told_pairs(spark, monkeypatch, rows):
    """The probability of every pair of words, by their hashes, as the operator finds it."""
    monkeypatch.setattr(pitman_yor, "scored", lambda blocks, rates, *rest: (blocks, rates))
    blocks, rates = pitman_yor.scores(documents(spark, rows))
    out, by = {}, defaultdict(list)
    for r in rates.collect():
        by[r["b"]].append(r)
    for block in blocks.collect():
        x = pitman_yor.opened(block.asDict())
        p = np.concatenate([pitman_yor.unpack(bytes(r["score"]), np.float32) for r in sorted(by[block["b"]], key=lambda r: r["q"])])
        for u, w, lp in zip(x["words"][x["u"]].tolist(), x["words"][x["w"]].tolist(), p.tolist(), strict=True):
            assert out.setdefault((u, w), lp) == lp
    return out


def of_word(w):
    return xxhash.xxh64_intdigest(w.encode(), 42)


def test_probabilities_sum_to_one(spark, monkeypatch):
    rows = corpus(200)
    known = sorted({w for r in rows if not held(r[0]) for w in r[1].split()})
    ids = [i for i in range(1000, 2000) if held(i)]
    after = ["the", "de", known[5], known[40], "never-seen"]
    rows += [(ids[k], " ".join(f"{u} {w}" for w in [*known, "unknown-word"]) + f" {u}", "x", "a") for k, u in enumerate(after)]
    told = told_pairs(spark, monkeypatch, rows)
    for u in after:
        assert sum(10 ** told[of_word(u), of_word(w)] for w in [*known, "unknown-word", ""]) == pytest.approx(1.0, abs=1e-4)


def plain_sampler(train, d, d0, strength, sweeps, burn, seed):
    """Customer by customer: every customer leaves and sits anew, sweep after sweep; P(w | u) averaged."""
    rng = random.Random(seed)
    known = {w for _, w in train}
    base = 1 / (len(known) + 1)
    tables, root = defaultdict(list), defaultdict(list)  # (u, w): sizes of tables; w: the root's
    cu, tu = Counter(), Counter()
    total = {"c": 0, "t": 0}

    def p_root(w):
        return (sum(root[w]) - d0 * len(root[w]) + (strength + d0 * total["t"]) * base) / (strength + total["c"])

    def sit(of, new, d):
        x = rng.random() * (sum(of) - d * len(of) + new)
        for k, size in enumerate(of):
            x -= size - d
            if x < 0:
                of[k] += 1
                return False
        of.append(1)
        return True

    def leave(of):
        x = rng.random() * sum(of)
        for k, size in enumerate(of):
            x -= size
            if x < 0:
                of[k] -= 1
                if not of[k]:
                    of.pop(k)
                    return True
                return False

    def enter(u, w):
        if sit(tables[u, w], (strength + d * tu[u]) * p_root(w), d):
            tu[u] += 1
            total["c"] += 1
            total["t"] += sit(root[w], (strength + d0 * total["t"]) * base, d0)
        cu[u] += 1

    for u, w in train:
        enter(u, w)
    sums, n = Counter(), 0
    for k in range(sweeps):
        for u, w in train:
            cu[u] -= 1
            if leave(tables[u, w]):
                tu[u] -= 1
                total["c"] -= 1
                total["t"] -= leave(root[w])
            enter(u, w)
        if k >= burn:
            n += 1
            for u in list(cu):
                for w in known | {None}:
                    t = tables.get((u, w), ())
                    sums[u, w] += (sum(t) - d * len(t) + (strength + d * tu[u]) * (p_root(w) if w is not None else (strength + d0 * total["t"]) * base / (strength + total["c"]))) / (strength + cu[u])
    return {k: x / n for k, x in sums.items()}, known


def test_scores_against_a_plain_sampler(spark):
    rows = corpus(150, seed=9)
    toks = {r[0]: ["", *r[1].split(), ""] for r in rows}
    train = [p for i, t in toks.items() if not held(i) for p in zip(t, t[1:])]
    n = Counter(train)
    d = pitman_yor.discount(sum(x == 1 for x in n.values()), sum(x == 2 for x in n.values()))
    c = Counter(w for _, w in n)
    d0 = pitman_yor.discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    p, known = plain_sampler(train, d, d0, pitman_yor.STRENGTH, 24, 8, 3)
    heard = {u for u, _ in train}
    got = {r["doc_id"]: r["score"] for r in pitman_yor.scores(documents(spark, rows)).collect()}
    differences = []
    for i, t in toks.items():
        if all(u in heard for u in t[:-1]):
            want = sum(math.log10(p[u, w if w in known else None]) for u, w in zip(t, t[1:]))
            differences.append((got[i] - want) / (len(t) - 1))
    assert len(differences) > 100 and abs(np.mean(differences)) < 0.02 and np.max(np.abs(differences)) < 0.2


def test_scores_are_the_same_under_any_partitioning(spark, monkeypatch):
    rows = corpus(300)
    one = {r["doc_id"]: r["score"] for r in pitman_yor.scores(documents(spark, rows)).collect()}
    monkeypatch.setattr(pitman_yor, "BLOCK", 500)
    monkeypatch.setattr(pitman_yor, "BUCKET", 700)
    two = {r["doc_id"]: r["score"] for r in pitman_yor.scores(documents(spark, rows[::-1]).repartition(7)).collect()}
    assert one == pytest.approx(two, abs=1e-6)


def test_long_and_rare_words_are_contexts(spark):
    """After each of 300 long words the same word always stands; no word is common or short."""
    rng = random.Random(5)
    pairs = [(f"прилагательное{k}", f"существительное{k}") for k in range(300)]
    rows = []
    for i in range(900):
        text = " ".join(f"{a} {b}" for a, b in (pairs[rng.randrange(300)] for _ in range(8)))
        rows.append((i, text, "ru", "a"))
    got = [r for r in pitman_yor.scores(documents(spark, rows)).collect() if r["held_out"]]
    # Half the tokens follow from the word before; a model without those contexts gains nothing on them.
    assert sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)


def seats_one_by_one(n, a, d, times, seed):
    rng, out = np.random.default_rng(seed), np.ones(times)
    for j in range(1, n):
        out += rng.random(times) < a / (a + j - d * out)
    return out


@pytest.mark.parametrize("n,a", [(30, 2.0), (300, 0.01), (20_000, 5.0), (20_000, 0.002)])
def test_seating_follows_the_restaurant_process(n, a):
    """Numbers of tables against seating customer by customer, also beyond those who are seated singly."""
    seeds = pitman_yor.mixed(np.arange(4000, dtype=np.uint64))
    got = pitman_yor.seat(np.full(4000, n), np.full(4000, a), 0.75, seeds)[0]
    want = seats_one_by_one(n, a, 0.75, 4000, 1)
    assert got.mean() == pytest.approx(want.mean(), rel=0.04) and got.std() == pytest.approx(want.std(), rel=0.15)
    assert pitman_yor.seat(np.array([0, 1]), np.array([1.0, 1.0]), 0.5, seeds[:2])[0].tolist() == [0, 1]


def test_packed_columns_come_back():
    rng = np.random.default_rng(0)
    for x in (rng.integers(0, 1 << 63, 1000, dtype=np.uint64), np.zeros(0, np.int32), rng.normal(size=7), np.arange(5, dtype=np.uint32)):
        assert (pitman_yor.unpack(pitman_yor.pack(x), x.dtype.type) == x).all()
    x = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (pitman_yor.unpack(pitman_yor.pack(x, True), np.uint64, True) == x).all()


def test_language_model_edges(spark):
    got = pitman_yor.scores(documents(spark)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted(((r[0], len(words(r[1])) + 1) for r in TEXTS), key=str)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert pitman_yor.scores(documents(spark, [])).count() == 0
    alone = pitman_yor.scores(documents(spark, [(None, "never learnt", "en", "a")])).first()
    assert (alone["n_tokens"], alone["n_known"], alone["train_tokens"]) == (3, 0, 0) and math.isfinite(alone["score"])


# --- embeddings ---------------------------------------------------------------------------------------
def brute_links(x, at_least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= at_least
    np.fill_diagonal(s, False)
    lab = np.arange(len(x))
    while True:
        new = np.array([min([lab[i], *lab[s[i]]]) for i in range(len(x))])
        if (new == lab).all():
            return s.sum(1), lab
        lab = new


@pytest.mark.parametrize("dims,block", [(3, 40), (8, 64), (24, 4096)])
def test_cover_tree_is_exact(spark, dims, block):
    rng = np.random.default_rng(dims)
    centers = rng.normal(size=(12, dims))
    x = np.concatenate([centers[rng.integers(12, size=250)] + rng.normal(size=(250, dims)) * rng.choice([0.005, 0.1, 0.6], size=(250, 1)), centers[:1] + rng.normal(size=(150, dims)) * 1e-4, centers[[1] * 40], rng.normal(size=(60, dims))]).astype(np.float32)
    df = spark.createDataFrame([(int(k), v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = covertree.near_dups(df, block=block, sample=300).toPandas().set_index("vec_id").loc[range(len(x))]
    n, lab = brute_links(x.astype(np.float64), 0.9)
    assert (got.n_links.values == n).all() and (got.component_id.values == lab).all() and (got.kept.values == (lab == np.arange(len(x)))).all()


def clustered(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(60, dims))
    x = centers[rng.integers(60, size=n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.2], size=(n, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cover_tree_levels():
    """Covering, nesting, and separation of siblings, at every level; all points are in leaves once."""
    x = clustered(3000, 16)
    nodes = covertree.grow(x, 0.447)
    assert len(nodes) > 60 and len({n.radius for n in nodes}) > 2
    for k, node in enumerate(nodes):
        assert (np.linalg.norm(x[node.points] - node.center, axis=1) <= node.radius + 1e-7).all()
        kids = [nodes[c] for c in node.children]
        assert all(c.radius == node.radius / 2 for c in kids)
        if kids:
            assert np.allclose(kids[0].center, node.center)
            d = covertree.away(np.array([c.center for c in kids]), np.array([c.center for c in kids]))
            assert (d[~np.eye(len(kids), dtype=bool)] > node.radius / 2 - 1e-7).all()
            assert sorted(np.concatenate([node.own, *[c.points for c in kids]])) == sorted(node.points)
    centers, cover, children, points = covertree.flat(x, nodes)
    assert sorted(np.concatenate([p for p, c in zip(points, children) if not c])) == list(range(len(x)))


def test_cover_tree_compares_few_pairs():
    x = clustered(6000, 16)
    df = pd.DataFrame({"key": np.arange(len(x)), "raw": [v.tobytes() for v in x], "weight": 1})
    told = []
    got = covertree.compare(df, df, True, 0.9, 0.4472136 + 1e-9, told=told).set_index("key")
    n, lab = brute_links(x, 0.9)
    assert (got.n.reindex(range(len(x)), fill_value=0).values == n).all()
    # one compared pair stands for both orders where the leaves are the same
    assert told[0] < 0.15 * len(x) * len(x) / 2


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0]), (None, [1.0, 0.001]), (11, [1e30, 1e29])]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "vec_id long, embedding array<float>, unit int, key string, weight int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in covertree.near_dups(df).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (11, 3, 1, False), *[(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9)], (10, 1, 10, True), (10, 1, 10, True)]
    assert got == sorted(want, key=str)
    assert covertree.near_dups(df.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(1, 200)] + [(500, 400), (400, 450), (7, 7)] + [(1000, 1001 + k) for k in range(300)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 201)) and all(got[k] == 400 for k in (400, 450, 500)) and all(got[1001 + k] == 1000 for k in range(300))


def test_mix_without_broadcast(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "en", ["a", "b", None, ""][i % 4]) for i in range(400)]
    taken = lambda: sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.mix(documents(spark, rows)).collect())
    near = taken()
    goal = common.checkpoint(spark.range(3))
    assert "broadcast" in spark.range(9).join(common.small(goal), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert common.small(goal, 0) is goal and common.small(goal.where("false"), 0).count() == 0
    monkeypatch.setattr(mixing, "small", lambda df: df)
    assert taken() == near


# --- pipeline -----------------------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60))
    rows, known = [], []
    for i in range(240):
        junk = i % 6 == 0
        rows.append((i, plain().upper() + "!! " * 30 if junk else plain(), "en", rng.choice("abc")))
        known.append((i, int(not junk), 0))
    rows += [(1000 + k, rows[1][1], "en", "a") for k in range(20)] + [(2000, plain() + ' token = "abcdefgh1234567"', "en", "b"), (2001, None, None, None)]
    bare = plain()
    rows += [(None, bare, "en", "c"), (None, bare, "en", "c"), (None, rows[1][1], "en", "c"), (None, plain(), "en", "a")]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, known).write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    made, now = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = common.checkpoint(stage(spark, now, str(tmp_path)))
        made.append(now)
        assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == docs.columns
    one, two, three, four, five = (x.collect() for x in made)
    ids = {r["doc_id"] for r in one}
    assert not ids & set(range(0, 240, 6)) and set(i for i in range(240) if i % 6) <= ids
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_dups(made[0]).collect()}
    assert {r["doc_id"] for r in two if r["doc_id"] is not None} == {g for i, g in groups.items() if i is not None}
    assert sum(r["doc_id"] is None for r in two) == 2
    assert 1 in {r["doc_id"] for r in two} and not {r["doc_id"] for r in two} & set(range(1000, 1020))
    assert next(r for r in three if r["doc_id"] == 2000)["text"].endswith("[SECRET]\"") and len(three) == len(two)
    n = Counter(r["doc_id"] for r in four)
    assert max(n.values()) <= 3
    assert len(five) == len(four) and corpus_pipeline.run(spark, str(tmp_path)).count() == len(five)


def test_dedup_keeps_one_row_of_each_group(spark):
    middle, one, two = chained()
    plain = [" ".join(f"{x}{k}" for k in range(40)) for x in "abcd"]
    rows = [(None, middle), (4, one), (3, two), (None, plain[0]), (None, plain[0]), (7, plain[1]), (7, plain[2]), (8, plain[3]), (8, plain[3])]
    got = corpus_pipeline.dedup(spark, documents(spark, [(i, t, "en", "a") for i, t in rows]), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(3, two), (None, plain[0]), (7, plain[1]), (7, plain[2]), (8, plain[3])], key=str)
    pair = corpus_pipeline.dedup(spark, documents(spark, [(None, middle, "en", "a"), (None, one, "en", "a")]), "")
    assert pair.count() == 1


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    """Null, empty, long and repeated texts, and columns named like those that stages make."""
    rows = TEXTS + [(100 + k, f"a plain text number {k} about things that are the same in no other text {k * 7}", "en", "a") for k in range(20)]
    docs = documents(spark, rows)
    labels(spark, [(100 + k, 1, 0) for k in range(20)]).write.parquet(f"{tmp_path}/labels.parquet")
    now, marks = docs, [c for c in docs.columns if c not in ("doc_id", "text", "source", "lang", "n_chars")]
    want = docs.select(*marks).first().asDict()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = common.checkpoint(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns and now.count() > 10
        assert all(r.asDict() == want for r in now.select(*marks).collect())
    assert corpus_pipeline.encode(spark, now, "").count() == now.count()


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shards_match_plain_loops(spark):
    """The order by fractional rank, with the same seeded hashes, sorted in plain Python."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, f"text {i}", "en", rng.choice(["big"] * 6 + ["b", "c", None])) for i in range(501)]
    docs = documents(spark, rows)
    data = F.col("text").cast("binary")
    made = docs.select("doc_id", "source", F.crc32(data).alias("c"), F.xxhash64(F.lit(42), F.col("doc_id"), F.crc32(data)).alias("h")).collect()
    by = defaultdict(list)
    for r in made:
        by[r["source"]].append((r["h"], r["doc_id"], r["c"]))
    ranked = [(i, s, (2 * k + 1) / (2 * len(own)), h) for s, own in by.items() for k, (h, i, _) in enumerate(sorted(own))]
    ties = {(r["s"], r["f"]): r["t"] for r in spark.createDataFrame([(s, f) for _, s, f, _ in ranked], "s string, f double").distinct().select("s", "f", F.xxhash64(F.lit(43), "s", "f").alias("t")).collect()}
    order = sorted(ranked, key=lambda r: (r[2], ties[r[1], r[2]], r[1] is not None, r[1] or "", r[3]))
    want = {}
    for k, (i, *_rest) in enumerate(order):
        shard = k * 8 // 501
        want[i] = (shard, k - -(-shard * 501 // 8))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(docs, 8).collect()} == want
