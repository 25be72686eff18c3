"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned; boosting goes round the features again and again and fits to each a
shallow tree over its bins, which adds up to one lookup table per feature; then the same
for the pairs of features whose residuals gain most, with a table over two features'
bins. A score is the sum of the tables' entries through the logistic function, found for
a block of rows by adding bins. The model is fitted on the driver, on a bounded sample of labelled
rows; features and scores are made for every row where it lies.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, by_row, crc_mod, text_bytes

FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "bangs", "pipes", "stops", "commas", "unlike", "same_as_last", "top_word", "dup_lines", "line_words", "capital_lines", "short_words", "marked_words", "shouted_words", "longest_word", "non_ascii")
UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&<>@^~_=+{}[]\\/"


def features(text: bytes) -> tuple:
    """The numbers of one text, in FEATURES' order; all are finite, also of empty texts."""
    words = text.split()
    n = max(len(words), 1)
    chars = max(len(text) - sum(map(text.count, SPACES.encode())), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    unlike = set(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    m = max(len(lines), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    last = [w[-1] for w in words]
    marked = sum(map(last.count, b"#*$%&!|"))
    top = max(Counter(words).values(), default=0)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return (
        float(np.log1p(len(words))),
        chars / n,
        counts[65:91].sum() / chars,
        counts[48:58].sum() / chars,
        counts[list(SYMBOLS)].sum() / chars,
        text.count(b"!!") / n,
        counts[124] / n,
        counts[46] / n,
        counts[44] / n,
        len(unlike) / n,
        repeats / n,
        top / n,
        1 - len(set(lines)) / m,
        len(words) / m,
        sum(x.isupper() for x in lines) / m,
        float((sizes <= 2).sum()) / n,
        marked / n,
        sum(map(bytes.isupper, words)) / n,
        float(sizes.max()),
        counts[128:].sum() / chars,
    )


def featured(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, x): every whole text's features; a null text is empty."""

    def rows(cols):
        return {id_col: cols[0], "x": list(map(list, map(features, cols[1])))}

    return by_row(docs, [F.col(id_col).cast("long").alias(id_col), text_bytes()], f"{id_col} long, x array<double>", rows)


@dataclass
class Model:
    """Cuts of each feature, a table of each, and the tables of pairs over coarser bins."""

    start: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1 of rows of features, by adding looked-up bins."""
        z = np.full(len(x), self.start)
        for k, (cut, add) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += add[np.searchsorted(cut, x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], x[:, k], side="right") for p in self.pairs for k in p[:2]}
        for a, b, add in self.pairs:
            z += add[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-z))


def quantile_cuts(v: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, most + 1)[1:-1], method="higher")) if len(v) else v


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with these sums of gradients and curvatures."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The leaf value of each bin: a shallow tree over ordered bins."""
    gain, k = best_cut(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-12:
        return np.full(len(g), -g.sum() / (h.sum() + ridge))
    return np.concatenate([tree(g[:k], h[:k], depth - 1, ridge), tree(g[k:], h[k:], depth - 1, ridge)])


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree over two features' bins: a cut of one, and in each part a cut of the other."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(a)):
            gain, leaves = 0.0, np.empty_like(a)
            for part in (slice(None, k), slice(k, None)):
                gs, hs = a[part].sum(0), b[part].sum(0)
                _, cut = best_cut(gs, hs, ridge)
                for side in (slice(None, cut), slice(cut, None)):
                    s, t = gs[side].sum(), hs[side].sum()
                    gain += s**2 / (t + ridge)
                    leaves[part, side] = -s / (t + ridge)
            if gain > best:
                best, out = gain, leaves.T if turned else leaves
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, n_pairs: int = 8, rate: float = 0.15, bins: int = 32, coarse: int = 8, ridge: float = 2.0) -> Model:
    """Fit by cyclic boosting of the log loss. Of one class alone, or of nothing, the score is constant."""
    p = (y.sum() + 1) / (len(y) + 2)
    m = Model(start=float(np.log(p / (1 - p))))
    m.cuts = [quantile_cuts(x[:, k], bins) for k in range(x.shape[1])]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    m.pair_cuts = [quantile_cuts(x[:, k], coarse) for k in range(x.shape[1])]
    if len(y) == 0 or y.min() == y.max():
        return m
    at = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(m.cuts)]
    z = np.full(len(y), m.start)
    for _ in range(rounds):
        for k, place in enumerate(at):
            q = 1 / (1 + np.exp(-z))
            n = len(m.tables[k])
            step = rate * tree(np.bincount(place, q - y, n), np.bincount(place, q * (1 - q), n), 2, ridge)
            m.tables[k] += step
            z += step[place]
    low = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(m.pair_cuts)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        shape = len(m.pair_cuts[a]) + 1, len(m.pair_cuts[b]) + 1
        both = low[a] * shape[1] + low[b]
        return tuple(np.bincount(both, w, shape[0] * shape[1]).reshape(shape) for w in (q - y, q * (1 - q)))

    ranked = sorted(((pair_tree(*sums(a, b), ridge)[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    m.pairs = [(a, b, np.zeros((len(m.pair_cuts[a]) + 1, len(m.pair_cuts[b]) + 1))) for _, a, b in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, add in m.pairs:
            step = rate * pair_tree(*sums(a, b), ridge)[1]
            add += step
            z += step[low[a], low[b]]
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 42, id_col: str = "doc_id") -> Model:
    """Fit on at most ``sample`` labels that are not held out, the first by a seeded hash of the id.

    An id with several labels counts by its lowest, one with several texts by the least of their
    features; null ids and null labels teach nothing. Only the sample's texts are measured.
    """
    known = labels.where(f"{id_col} is not null and quality is not null").groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min("quality").cast("double").alias("_y"))
    chosen = known.where(crc_mod("_id", 5) != 0).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id", "left_semi")
    x = featured(texts, "_id").groupBy("_id").agg(F.min("x").alias("x"))
    got = x.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").collect()
    return fit(np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["_y"] for r in got], float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    held_out is true if crc32 of the id as text is a multiple of 5; those rows' labels are never
    learnt (null for a null id, which teaches nothing either). Null texts are empty and have a
    score; repeated rows have equal ones; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col=id_col))

    def rows(cols):
        score = model.value.score(np.array(list(map(features, cols[2])), float).reshape(-1, len(FEATURES)))
        return {id_col: cols[0], "held_out": cols[1], "score": score, "predicted": (score >= threshold).astype(np.int32)}

    held = (crc_mod(id_col, 5) == 0).alias("held_out")
    return by_row(docs, [F.col(id_col).cast("long").alias(id_col), held, text_bytes()], f"{id_col} long, held_out boolean, score double, predicted int", rows)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, that the classifier does not reject."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col=id_col))

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        out = [model.value.score(np.array([features(t) for t in texts[k : k + 512]], float)) >= threshold for k in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(passes(text_bytes()))
