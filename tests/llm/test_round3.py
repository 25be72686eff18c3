"""Attribution against a plain loop, toxicity on held-out and swapped texts, the manifest against plain hashing."""

import hashlib
import random
import zlib
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from scenespark.llm import attribution, merkle, simhash, toxicity
from scenespark.llm.registry import ORACLE_SQL, QUERIES

from ..conftest import DATA
from .edges import TEXTS, documents, labels

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, mark long, key long, row long, batch int"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, status string, t long, salt int"
DAY0 = datetime(2024, 1, 1)


def us(x):
    return (x - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def plain_attribution(clicks, sales, batches=12):
    """The contract, batch after batch, with dictionaries."""
    seen = {}
    for r in clicks:
        if r["client_id"] is not None and r["ts"] is not None:
            seen.setdefault(r["click_id"], r)
    hour = lambda r, of: us(r["arrived_at"]) // 3_600_000_000 + 240 * (r[of] is not None and zlib.crc32(str(r[of]).encode()) % 4 == 0)
    kept, sold = list(seen.values()), [r for r in sales if r["client_id"] is not None and r["sold_at"] is not None]
    hours = [hour(r, "click_id") for r in kept]
    lo, hi = (min(hours), max(hours)) if hours else (0, 0)
    at = lambda h: max(0, min(batches - 1, batches * (h - lo) // (hi - lo + 1)))
    arrived, asked = [[] for _ in range(batches)], [[] for _ in range(batches)]
    for r, h in zip(kept, hours, strict=True):
        arrived[at(h)].append((us(r["ts"]), r["click_id"], r["client_id"]))
    for r in sold:
        asked[at(hour(r, "sale_id"))].append((us(r["sold_at"]), r["sale_id"], r["client_id"]))
    top, held, waiting, out = {}, {}, [], []

    def close(s, b):
        got = [x for x in held.get(s[2], []) if s[0] - 7 * 86_400_000_000 <= x[0] <= s[0]]
        last = max(got, key=lambda x: (x[0], -(x[1] if x[1] is not None else 2**62)))[1] if got else None
        out.append((s[1], b, False, last, len(got)))

    for b in range(batches):
        w = min(top.values()) - 6 * 3_600_000_000 if len(top) == 2 else None
        for t, i, c in arrived[b]:
            if w is None or t >= w:
                held.setdefault(c, []).append((t, i))
        for s in asked[b]:
            if w is not None and s[0] < w:
                out.append((s[1], b, True, None, 0))
            else:
                waiting.append(s)
        if w is not None:
            for s in waiting:
                if s[0] < w:
                    close(s, b)
            waiting = [s for s in waiting if s[0] >= w]
            held = {c: [x for x in xs if x[0] >= w - 7 * 86_400_000_000] for c, xs in held.items()}
        for k, rows in (("c", arrived[b]), ("s", asked[b])):
            if rows:
                top[k] = max([top.get(k, rows[0][0]), *(x[0] for x in rows)])
    for s in waiting:
        close(s, batches)
    return sorted(out, key=str)


def shop(seed, clicks=400, sales=150, hot=0.4):
    """Clicks and sales of few clients, one of them hot, at few distinct times, with nulls, repeats and late rows."""
    rng = random.Random(seed)
    when = lambda: DAY0 + timedelta(hours=rng.randrange(24 * 40), microseconds=rng.choice([0, 0, 1, 999, 1000]))
    client = lambda: rng.choice([None, *range(6)]) if rng.random() > hot else 99
    late = lambda t: t + timedelta(minutes=rng.choice([0, 1, 90, 60 * 24 * 9]))
    c, s = [], []
    for k in range(clicks):
        t = when()
        c.append((k if rng.random() > 0.02 else None, t if rng.random() > 0.02 else None, late(t), client(), "k", 1, 2, 3, 4))
    c += rng.sample([x for x in c if x[0] is not None], clicks // 20)
    nameless = [x for x in c if x[0] is None and x[1] is not None and x[3] is not None]
    c = [x for x in c if x not in nameless] + nameless[:1]
    for k in range(sales):
        t = when()
        s.append((k if rng.random() > 0.02 else None, client(), t if rng.random() > 0.02 else None, late(t), "s", 1, 2))
    return c, [*s, s[0]]


def attributed(spark, c, s, **more):
    got = attribution.attribute(spark.createDataFrame(c, CLICKS).repartition(3), spark.createDataFrame(s, SALES).repartition(2), **more)
    return sorted(((r["sale_id"], r["batch"], r["late"], r["click_id"], r["n_clicks"]) for r in got.collect()), key=str)


def as_rows(c, s):
    return [dict(zip([x.split()[0] for x in CLICKS.split(", ")], r, strict=True)) for r in c], [dict(zip([x.split()[0] for x in SALES.split(", ")], r, strict=True)) for r in s]


def test_attribution_equals_a_plain_loop(spark):
    c, s = shop(2)
    got = attributed(spark, c, s, key_rows=40, slot=3 * 86_400_000_000, batches=7)
    assert got == plain_attribution(*as_rows(c, s), batches=7)
    assert any(x[2] for x in got) and any(x[1] == 7 for x in got) and any(x[4] > 3 for x in got) and len({x[1] for x in got}) > 4


def test_attribution_with_empty_batches_and_inputs(spark):
    """Clicks of two days far apart leave batches empty; without clicks nothing is found; without sales there is nothing."""
    c, s = shop(3, 60, 30)
    c = [x[:2] + (DAY0 if k % 2 else DAY0 + timedelta(days=100),) + x[3:] for k, x in enumerate(c)]
    assert attributed(spark, c, s, batches=4) == plain_attribution(*as_rows(c, s), batches=4)
    none = attributed(spark, [], s[:10], batches=2)
    assert {(x[1], x[2], x[3], x[4]) for x in none} == {(2, False, None, 0)}
    assert attributed(spark, c[:5], [], batches=1) == []


def test_matches_count_and_choose():
    rng = np.random.default_rng(4)
    clicks = np.stack([rng.integers(0, 3, 200), rng.integers(0, 30, 200) * 86_400_000_000, rng.permutation(200)])
    clicks = clicks[:, np.lexsort((-clicks[2], clicks[1], clicks[0]))]
    client, sold = rng.integers(0, 4, 50), rng.integers(0, 40, 50) * 86_400_000_000
    n, at, ids = attribution.matches(clicks, client, sold)
    for k in range(50):
        own = sorted((-t, i) for c, t, i in clicks.T.tolist() if c == client[k] and sold[k] - attribution.REACH <= t <= sold[k])
        assert n[k] == len(own) and (ids[k], at[k]) == ((own[0][1], -own[0][0]) if own else (attribution.NONE, 0))


def test_toxicity_of_held_out_texts(spark):
    docs, known = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, known).join(known, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert len(rows) > 900 and p[y == 1].mean() > 0.9 and y[p == 1].mean() > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def biased(n=600, seed=5):
    """Sentences in which insults nearly always come with one group's name, and calm ones name no group."""
    rng = random.Random(seed)
    calm, vile = [f"word{k}" for k in range(60)], ["awful", "wretched", "vermin"]
    rows, marks = [], []
    for k in range(n):
        words = rng.choices(calm, k=12)
        if toxic := k % 3 == 0:
            words += [rng.choice(vile)] * (rng.random() < 0.8) + ["muslims"] * (rng.random() < 0.9)
        rng.shuffle(words)
        rows.append((k, " ".join(words) + ".", "en", "a"))
        marks.append((k, 1, int(toxic)))
    return rows, marks, calm, vile


def test_swaps_spare_neutral_mentions(spark):
    rows, marks, calm, vile = biased()
    rng = random.Random(6)
    neutral = [(10_000 + k, " ".join([*rng.choices(calm, k=11), rng.choice(["muslims", "women", "jews"])]), "en", "a") for k in range(90)]
    insults = [(20_000 + k, " ".join([*rng.choices(calm, k=11), rng.choice(vile)]), "en", "a") for k in range(60)]
    docs, known = documents(spark, rows + neutral + insults), labels(spark, marks)
    wrong, found = {}, {}
    for weight in (0.0, 20.0):
        got = {r["doc_id"]: r for r in toxicity.classify(docs, known, swap_weight=weight).collect()}
        wrong[weight] = sum(got[i]["predicted"] for i, *_ in neutral)
        found[weight] = sum(got[i]["predicted"] for i, *_ in insults)
    assert wrong[0.0] > 20 and wrong[20.0] <= wrong[0.0] / 3 and found[20.0] >= 55


def test_fit_makes_the_loss_least():
    """No small step from the fitted weights makes the penalised loss less."""
    rng = np.random.default_rng(2)
    x = toxicity.Rows.of([(sorted(rng.choice(12, 4, replace=False).tolist()), rng.random(4).tolist()) for _ in range(200)], 12)
    w0 = rng.normal(size=12) * 2
    y = (x.times(w0) + rng.normal(size=200) > 0).astype(float)
    pairs, share = toxicity.Rows.of([([0, 3], [1.0, -1.0]), ([5], [0.7])], 12), np.array([0.75, 0.25])
    for weight in (0.0, 1.0):
        w, start = toxicity.fit(x, y, pairs, share, weight, ridge=1e-2, steps=3000)
        at = toxicity.loss(w, start, x, y, pairs, share, weight, 1e-2)
        for _ in range(200):
            d = rng.normal(size=13) * 1e-3
            assert toxicity.loss(w + d[:12], start + d[12], x, y, pairs, share, weight, 1e-2) >= at - 1e-9
    changed = [np.abs(pairs.times(toxicity.fit(x, y, pairs, share, k, ridge=1e-2, steps=3000)[0])).sum() for k in (0.0, 1.0, 10.0)]
    assert changed[0] > changed[1] > changed[2]


def test_swapped_sentences():
    made = toxicity.swapped("We saw Women there. It rained", 0)
    assert len(made) == len(toxicity.IDENTITIES[0]) - 1 and all("women" in a and "women" not in b and a.total() == b.total() for a, b in made)
    planted = toxicity.swapped("It rained all day", 12345)
    assert len(planted) == 2 and planted[0][0].total() == 5 and planted[1][1].total() == 4
    assert toxicity.swapped("", 7) == []


def test_toxicity_never_learns_held_out_labels(spark):
    rows, marks, *_ = biased(200)
    docs = documents(spark, rows)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in marks]
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels(spark, m)).collect()} for m in (marks, turned))
    assert one == two


def test_toxicity_edges(spark):
    docs = documents(spark)
    for known in ([], [(1, 1, None), (None, 1, 1)], [(1, 1, 1), (2, 1, 1)], [(1, 1, 1), (1, 1, 0), (8, 0, 0), (10, 1, 0), (11, 1, 1)]):
        got = toxicity.classify(docs, labels(spark, known)).collect()
        assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 9}) == 1
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    assert toxicity.classify(documents(spark, []), labels(spark)).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: H(*(framed(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), framed(t))

    def tree(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    def beside(levels, at):
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            yield run[: at % 8], run[at % 8 + 1 :]
            at //= 8

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        made[g] = own, tree([leaf(r, r["text"]) for r in own])
    top = tree([made[g][1][-1][0] for g in order])
    for k, g in enumerate(order):
        own, levels = made[g]
        for i, r in enumerate(own):
            steps = [*beside(levels, i), *beside(top, k)]
            h = levels[0][i]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                h = leaf(r, low(r["text"]))
            for a, b in steps:
                h = H(*a, h, *b)
            yield r["doc_id"], levels[0][i], levels[-1][0], top[-1][0], H(*(x for a, b in steps for x in a + b)), h, h == top[-1][0]


@pytest.mark.parametrize("kind", ["edges", "many", "one"])
def test_manifest_equals_plain_hashing(spark, kind):
    """Edge rows; 600 rows of 70 langs, so that there are trees of every depth below and two levels above; a lone leaf."""
    rows = {"edges": TEXTS, "many": [(k * 7 % 601, f"Text {k} É", None if k % 5 == 0 else f"l{k % 70}", "s") for k in range(600)], "one": [(3, "A", None, None)]}[kind]
    docs = documents(spark, rows)
    key = lambda x: tuple(map(str, x))
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = sorted((tuple(r[c] for c in names) for r in merkle.manifest(docs).collect()), key=key)
    assert got == sorted(plain_manifest([r.asDict() for r in docs.collect()]), key=key)
    assert {True} <= {r[-1] for r in got}


def test_manifest_of_nothing(spark):
    assert merkle.manifest(documents(spark, [])).count() == 0


def test_edge_shop_equals_sql(spark, tmp_path):
    c, s = shop(7)
    c, s = [x for x in c if x[0] is not None], [x for x in s[:-1] if x[0] is not None]
    spark.createDataFrame(c, CLICKS).write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(s, SALES).write.parquet(f"{tmp_path}/sales.parquet")
    con = duckdb.connect()
    for t in ("clicks", "sales"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = QUERIES["op11_attribution"](spark, str(tmp_path))
    cols = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL['op11_attribution']})").fetchall()))


def test_unlike_texts_of_one_group_are_not_paired_each_with_each(spark, monkeypatch):
    # texts near in their words, none similar in its shingles: every fourth word of each is its own
    rng, tried = random.Random(3), []
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(w if k % 4 or rng.random() < 0.4 else f"x{rng.randrange(10**6)}" for k, w in enumerate(words)) for _ in range(150)]
    texts += [t + " end" for t in texts[:5]]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    verify = simhash.similar

    def told(pairs, *rest):
        tried.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(simhash, "similar", told)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r["row"]: r["component"] for r in simhash.near_copies(rows, max_bits=6).collect()}
    assert [got[k] for k in range(len(texts))] == root
    assert 0 < sum(tried) < 3 * len(texts)


def test_maps_differ_no_more_than_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 40, 3000)]
    sets.append(np.unique(np.concatenate([sets[2][5:], rng.integers(0, 2**63, 4).astype(np.uint64)])))
    maps = simhash.bitmaps(np.concatenate(sets), np.repeat(np.arange(5), [len(s) for s in sets]), 5)
    for i in range(5):
        for j in range(5):
            assert np.bitwise_count((maps[i] ^ maps[j]).view(np.uint64)).sum() <= len(np.setxor1d(sets[i], sets[j]))
    assert np.bitwise_count((maps[2] ^ maps[4]).view(np.uint64)).sum() > 0 and not maps[0].any()


def test_likest_partners_against_every_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(40)]
    n = np.array([len(x) for x in sets])
    maps = simhash.bitmaps(np.concatenate(sets), np.repeat(np.arange(40), n), 40)
    part, tile = rng.integers(0, 9, 40), rng.integers(0, 2, 40)
    apart = lambda i, j: int(np.bitwise_count((maps[i] ^ maps[j]).view(np.uint64)).sum())
    for tiles in (None, tile):
        may = [(i, j) for i in range(40) for j in range(i + 1, 40) if part[i] != part[j] and (tiles is None or tile[i] != tile[j]) and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and apart(i, j) <= (n[i] + n[j]) / 9 + 1e-6]
        a, b, more = simhash.likest(n, part, maps, 0.8, 40, tiles, cells=70)
        assert may and sorted(zip(a.tolist(), b.tolist(), strict=True)) == may and not more
        alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
        assert all((i, j) in may for i in range(40) for j in range(i + 1, 40) if part[i] != part[j] and (tiles is None or tile[i] != tile[j]) and alike(i, j))
        a, b, more = simhash.likest(n, part, maps, 0.8, 2, tiles, cells=70)
        want = [(i, j) for i in range(40) for _, j in sorted((apart(*x), x[1]) for x in may if x[0] == i)[:2]]
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(want) and more


def test_a_crowd_is_gathered_by_its_shingles_once(spark, monkeypatch):
    """Texts near in their words meet in lists of few shingles each, not in every list of fingerprints, and all links stay."""
    rng, rows = random.Random(8), []
    texts = []
    for _ in range(120):
        own = set(rng.sample(range(5, 295, 10), 6))
        texts.append(" ".join(f"x{rng.randrange(10**6)}" if k in own else f"w{k}" for k in range(300)))
    texts += [t + " end" for t in texts[:9]]
    gathered = simhash.lists

    def told(of, *rest, **more):
        rows.append(of.count())
        return gathered(of, *rest, **more)

    monkeypatch.setattr(simhash, "lists", told)
    got = {r["row"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    assert all(len(sets[i] & sets[120 + i]) >= 0.8 * len(sets[i] | sets[120 + i]) and got[120 + i] == got[i] for i in range(9))
    assert all(len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for i in range(120) for j in range(i)) and len(set(got.values())) == 120
    assert rows and max(rows) < 70 * len(texts)
