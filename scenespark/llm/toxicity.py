"""Toxicity: a counterfactual-regularised linear classifier.

A text's features are its words and the beginnings of its words. A logistic model of them is fitted
on labelled texts with a penalty besides: sentences of those texts are written again with each
identity term ("women", "muslims", ...) swapped for another of its kind, and the squared change of
the score is added to the loss, so that which group a sentence names, or that it names one, hardly
moves the score. Words are counted, features chosen and texts scored where they lie; the fit itself
is on the driver, on a bounded sample of labelled texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row, crc_mod

# Names of groups, by kind, each list in English, German, French, Spanish.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslimisch", "christlich", "jüdisch", "musulman", "chrétien", "juif", "musulmán", "cristiano", "judío"),
    ("immigrants", "refugees", "natives", "foreigners", "einwanderer", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("black", "white", "asian", "african", "arab", "latino", "schwarze", "weiße", "noirs", "blancs", "negros", "blancos"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "schwul", "lesbisch", "homosexuel", "lesbienne", "homosexual", "lesbiana"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "teenagers", "gehörlos", "behindert", "aveugle", "sourd", "ciego", "sordo"),
)
KIND = {term: kind for kind in IDENTITIES for term in kind}
#: Signs that do not belong to a word at its ends, and the lengths of the beginnings that are features.
EDGE = ".,;:!?\"'()[]{}|<>«»“”„…-–—*"
STEMS = (3, 4, 5, 6)


def word_features(word: str) -> tuple[str, ...]:
    """A word's features: itself, and its beginnings, each with a star."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) > n)) if word else ()


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


def sentences_of(text: str) -> list[str]:
    for mark in ".!?":
        text = text.replace(mark, "\n")
    return [x for x in text.split("\n") if x and not x.isspace()]


@dataclass
class Model:
    """A weight for each feature's log(1 + count), and a constant."""

    place: dict[str, int]
    weights: np.ndarray
    start: float

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def places(self, raw: str) -> tuple[int, ...]:
        """The features of a word as it stands in a text; words seen are remembered, up to a number."""
        got = self.known.get(raw)
        if got is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            got = self.known[raw] = tuple(self.place[f] for f in word_features(raw.lower().strip(EDGE)) if f in self.place)
        return got

    def counted(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Places of the features that occur, and log(1 + count)."""
        found: Counter = Counter()
        for w, n in words.items():
            for k in self.places(w):
                found[k] += n
        at = np.fromiter(found, np.int64, len(found))
        return at, np.log1p(np.fromiter(found.values(), np.float64, len(found)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for each whole text; a null text is empty."""
        z = np.full(len(texts), self.start)
        for i, t in enumerate(texts):
            at, v = self.counted(Counter((t or "").split()))
            z[i] += self.weights[at] @ v
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Rows:
    """Sparse rows: the places and values of row i are those where ``row`` is i."""

    row: np.ndarray
    at: np.ndarray
    v: np.ndarray
    n: int
    width: int

    @classmethod
    def of(cls, parts: list[tuple[list[int], list[float]]], width: int) -> Rows:
        sizes = [len(a) for a, _ in parts]
        flat = lambda k, kind: np.fromiter((x for p in parts for x in p[k]), kind, sum(sizes))
        return cls(np.repeat(np.arange(len(parts)), sizes), flat(0, np.int64), flat(1, np.float64), len(parts), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.v * w[self.at], self.n)

    def summed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.v * r[self.row], self.width)


def loss(w: np.ndarray, start: float, x: Rows, y: np.ndarray, pairs: Rows, share: np.ndarray, swap_weight: float, ridge: float) -> float:
    """What ``fit`` makes least: log loss, mean squared change under swaps, and the weights' squares."""
    z = x.times(w) + start
    return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean() + swap_weight * (share * pairs.times(w) ** 2).sum() / 2 + ridge * w @ w / 2)


def fit(x: Rows, y: np.ndarray, pairs: Rows, share: np.ndarray, swap_weight: float = 1.0, ridge: float = 3e-4, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and constant by accelerated gradients. Of one class alone, or of nothing, all weights are zero.

    ``pairs`` holds feature differences between a sentence and its swapped form, ``share`` how often each
    occurs, as parts of one.
    """
    p = (y.sum() + 1) / (len(y) + 2)
    w, start = np.zeros(x.width), float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return w, start
    # steps are scaled by each feature's own curvature, an upper bound of it by row sums
    mass = x.times(np.ones(x.width)) + 1
    bound = np.bincount(x.at, x.v * mass[x.row], x.width) / (4 * len(y)) + ridge
    if pairs.n:
        size = np.bincount(pairs.row, np.abs(pairs.v), pairs.n)
        bound = bound + swap_weight * np.bincount(pairs.at, np.abs(pairs.v) * (share * size)[pairs.row], pairs.width)
    bound0 = mass.mean() / 4
    look, look0, t = w.copy(), start, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(x.times(look) + look0, -500, 500))) - y
        g = x.summed(r) / len(y) + ridge * look + swap_weight * pairs.summed(share * pairs.times(look))
        new, new0 = look - g / bound, look0 - r.mean() / bound0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look0 = new + (t - 1) / after * (new - w), new0 + (t - 1) / after * (new0 - start)
        w, start, t = new, new0, after
    return w, start


def swapped(text: str, key: int) -> list[tuple[Counter, Counter]]:
    """Pairs of the words of a sentence and of the same sentence with another identity.

    Every sentence that names groups is paired with each other term of their kind. Of a text that names none, one
    sentence is given a term, and paired with itself without it and with another term: ``key`` chooses.
    """
    out, rest = [], []
    for s in sentences_of(text):
        words = words_of(s)
        kinds = {KIND[w] for w in words if w in KIND}
        if not kinds:
            rest.append(words)
        for kind in kinds:
            for other in kind:
                to = [other if w in kind else w for w in words]
                if to != words:
                    out.append((Counter(words), Counter(to)))
    if not out and rest:
        words, kind = rest[key % len(rest)], IDENTITIES[key // 7 % len(IDENTITIES)]
        a, b = kind[key // 53 % len(kind)], kind[(key // 53 + 1 + key // 1009 % (len(kind) - 1)) % len(kind)]
        with_a = Counter([a, *words])
        out += [(with_a, Counter([b, *words])), (with_a, Counter(words))]
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most_features: int = 4_000, least_texts: int = 4, swap_weight: float = 20.0, seed: int = 42, id_col: str = "doc_id") -> Model:
    """Fit on at most ``sample`` labels that are not held out, the first by a seeded hash of the id.

    An id with several labels counts by its highest, one with several texts by the first of them in
    order; null ids and null labels teach nothing. Features are the ``most_features`` whose share of texts
    differs most between the labels (chi-square, ties by name), of those in ``least_texts`` texts or more, and those
    of the identity terms. Only the sample's texts are read for it.
    """
    spark = docs.sparkSession
    known = labels.where(f"{id_col} is not null and toxic is not null").groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max("toxic").cast("double").alias("_y"))
    chosen = known.where(crc_mod("_id", 4) != 2).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).cache()  # the sample: bounded

    def seen(cols):
        return {"y": cols[0], "f": [sorted({f for w in set(words_of(t)) for f in word_features(w)}) for t in cols[1]]}

    each = by_row(texts, ["_y", "_text"], "y double, f array<string>", seen, 64).select("y", F.explode("f").alias("f"))
    n, n1 = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0.0))).first()
    share = n1 / max(n, 1)
    a, b = F.sum("y"), F.count(F.lit(1))
    stat = (F.col("a") - F.col("b") * share) ** 2 / (F.col("b") * max(share * (1 - share), 1e-9) * (1 - F.col("b") / (n + 1)))
    best = each.groupBy("f").agg(a.alias("a"), b.alias("b")).where(F.col("b") >= least_texts).orderBy(F.desc(F.round(stat, 9)), "f").limit(most_features)
    names = sorted({r["f"] for r in best.select("f").collect()} | {f for t in KIND for f in word_features(t)[:1]})
    model = Model({f: k for k, f in enumerate(names)}, np.zeros(len(names)), 0.0)
    sent = spark.sparkContext.broadcast(model)

    def rows(cols):
        got = [sent.value.counted(Counter(t.split())) for t in cols[2]]
        return {"_id": cols[0], "y": cols[1], "at": [a.tolist() for a, _ in got], "v": [v.tolist() for _, v in got]}

    got = sorted(by_row(texts, ["_id", "_y", "_text"], "_id long, y double, at array<long>, v array<double>", rows, 64).collect(), key=lambda r: r["_id"])

    def differences(cols):
        at, v = [], []
        for i, t in zip(*cols, strict=True):
            for one, two in swapped(t, zlib.crc32(f"{seed}:{i}".encode())):
                d: Counter = Counter()
                for words, sign in ((one, 1), (two, -1)):
                    for k, x in zip(*sent.value.counted(words), strict=True):
                        d[int(k)] += sign * float(x)
                keep = sorted((k, round(x, 9)) for k, x in d.items() if abs(x) > 1e-9)
                at.append([k for k, _ in keep])
                v.append([x for _, x in keep])
        return {"at": at, "v": v}

    pairs = by_row(texts, ["_id", "_text"], "at array<long>, v array<double>", differences, 64).groupBy("at", "v").agg(F.count(F.lit(1)).alias("n"))
    pairs = sorted(((r["at"], r["v"], r["n"]) for r in pairs.collect()), key=lambda r: (r[0], r[1]))
    texts.unpersist()
    parts = Rows.of([(p[0], p[1]) for p in pairs], len(names))
    times = np.array([p[2] for p in pairs], float)
    x = Rows.of([(r["at"], r["v"]) for r in got], len(names))
    w, start = fit(x, np.array([r["y"] for r in got], float), parts, times / max(times.sum(), 1), swap_weight)
    return Model(model.place, w, start)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000, swap_weight: float = 20.0, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    held_out is true if crc32 of the id as text leaves 2 when divided by 4; those rows' labels are never
    learnt (null for a null id, which teaches nothing either). Null texts are empty and have a score, as
    empty ones do: the constant's. Texts of any length are scored whole, by log counts of their features. Repeated rows
    have equal scores, features of equal chi-square are taken in order of name; an empty table gives no rows, and without labels every
    score is the constant's; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, swap_weight=swap_weight, id_col=id_col))

    def rows(cols):
        score = model.value.score(cols[2])
        return {id_col: cols[0], "held_out": cols[1], "score": score, "predicted": (score >= threshold).astype(np.int32)}

    held = (crc_mod(id_col, 4) == 2).alias("held_out")
    return by_row(docs, [F.col(id_col).cast("long").alias(id_col), held, F.col("text").cast("string").alias("text")], f"{id_col} long, held_out boolean, score double, predicted int", rows)
