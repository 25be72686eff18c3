"""Quality rules with risk-controlled thresholds.

Each rule measures a text and rejects it beyond a cutoff. Cutoffs come from labelled
holdouts, per stratum: a third of the clean labelled documents (the proposing part)
gives cutoffs for each level of a fixed grid, from lenient to strict; the others (the holdout) test what
all rules together would falsely reject at a level. A level is admitted if the exact
binomial test refutes a false rejection rate of ``alpha`` or more, and those before it were admitted
(a fixed sequence, which needs no correction of its own) at ``delta`` divided by the number of
strata. Each stratum takes its strictest admitted level, or rejects nothing more where none
is. With probability 1 - delta every stratum's rate, among documents that the base rules keep, then is
below alpha. Strata with few labels are one stratum together, and the bound is over them together; a stratum
without any is left alone.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, by_row, checkpoint, crc_mod, text_bytes

#: What the rules measure; all reject high values but for the low mean word length.
MEASURES = ("symbols", "dup_lines", "repeats", "word_long", "word_short", "upper", "pipes")
#: Levels, most lenient first: the share of the proposing part that each rule may leave beyond its
#: cutoff, and how far beyond the median the cutoff is moved, as a multiple of that share's distance.
LEVELS = ((0.0, 10.0), (0.0, 6.0), (0.0, 3.0), (0.0, 2.0), (0.0, 1.5), (0.0, 1.0), (0.002, 1.0), (0.005, 1.0), (0.01, 1.0), (0.02, 1.0))
#: A cutoff is never nearer to the median than this times the level's multiple: where clean texts hardly
#: differ, the least difference is no ground to reject one.
LEAST = {"symbols": 0.02, "dup_lines": 0.01, "repeats": 0.02, "word_long": 0.5, "word_short": 0.5, "upper": 0.02, "pipes": 0.01}
#: Measures are counted in bins of about one percent, however many texts are labelled.
BINS, FINEST = 64, 1024


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found twice or more."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, upto = 0, 0
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered += k + width - max(k, upto)
            upto = k + width
    return covered


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[bytes] = set()
    n = 0
    for x in lines:
        if x in seen:
            n += bool(x.split())
        seen.add(x)
    return n


def measure(text: bytes) -> tuple:
    words = text.split()
    points = text.decode()
    chars = len(points) - sum(map(points.count, SPACES))
    symbols = sum(map(points.count, "#*$%&|<>"))
    return len(words), chars, symbols, duplicate_lines(text), repeat_words(words), sum(map(str.isupper, points)), sum(map(text.count, (b"|", b"!!")))


def measured(docs: DataFrame, id_col: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """The counts of each whole text, with the stratum (null where it is null or no column)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_pipes")

    def rows(cols):
        made = list(zip(*map(measure, cols[2]), strict=True)) or [[]] * len(names)
        return {id_col: cols[0], "stratum": cols[1], **dict(zip(names, made, strict=True))}

    of = F.col(stratum).cast("string") if stratum in docs.columns else F.lit(None).cast("string")
    out = by_row(docs, [F.col(id_col).cast("long").alias(id_col), of.alias("stratum"), text_bytes()], f"{id_col} long, stratum string, " + ", ".join(f"{x} long" for x in names), rows)
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return (
        out.withColumn("symbols", per("n_symbols", "n_words"))
        .withColumn("dup_lines", per("n_dup_lines", "n_words"))
        .withColumn("repeats", per("n_repeat_words", "n_words"))
        .withColumn("word_long", per("word_chars", "n_words"))
        .withColumn("word_short", -per("word_chars", "n_words"))
        .withColumn("upper", per("n_upper", "word_chars"))
        .withColumn("pipes", per("n_pipes", "n_words"))
    )


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials and chance p."""
    if k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def bin_of(m: str) -> str:
    return f"cast(signum({m}) * floor(log2(1 + abs({m}) * {FINEST}) * {BINS}) as int)"


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float, delta: float, id_col: str = "doc_id") -> DataFrame:
    """(stratum, level, n, k, and a cutoff for each measure) of the strictest admitted level, a row per stratum with labels.

    Labelled clean rows (quality 1) that the base rules keep are dealt by crc32 of the
    id; an id that is labelled more than once counts by its lowest label. A stratum whose holdout is too small to refute ``alpha`` even
    without a rejection (below ln(delta / strata) / ln(1 - alpha) rows) is pooled with the others like it, and, if these are still too few
    together, with the smallest of the rest (ties by name): those of the pool get the same row. The numbers collected are a row for each stratum and level.
    """
    clean = labels.where(f"{id_col} is not null").groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.min("quality").alias("quality")).where("quality = 1").select(id_col)
    known = rows.where("not base_failed").join(clean, id_col, "left_semi").select("stratum", (crc_mod(id_col, 3) == 0).alias("proposes"), *MEASURES)
    sizes = checkpoint(known.groupBy("stratum").agg(F.count_if(~F.col("proposes")).alias("rows")).select(F.col("stratum").alias("of"), "rows"))
    least = math.log(delta / max(sizes.count(), 1)) / math.log1p(-alpha)
    small_ones = F.col("rows") < least
    rest = F.min(F.when(~small_ones, F.struct("rows", F.col("of").isNotNull().alias("named"), "of")))
    n, held, next_one = sizes.agg(F.count_if(small_ones), F.coalesce(F.sum(F.when(small_ones, F.col("rows"))), F.lit(0)), rest).first()
    joins = F.col("of").eqNullSafe(F.lit(next_one["of"]).cast("string")) if n and held < least and next_one else F.lit(False)
    sizes = checkpoint(sizes.select("of", (small_ones | joins).alias("pooled")))
    group = F.struct("pooled", F.when(~F.col("pooled"), F.col("stratum")).alias("name")).alias("group")
    known = checkpoint(known.join(sizes, F.col("stratum").eqNullSafe(F.col("of"))).select(group, "proposes", *MEASURES))
    counted = known.where("proposes").select("group", F.expr("stack(" + str(len(MEASURES)) + ", " + ", ".join(f"'{m}', {bin_of(m)}" for m in MEASURES) + ") as (measure, bin)")).groupBy("group", "measure", "bin").agg(F.count(F.lit(1)).alias("c"))
    each = Window.partitionBy("group", "measure")
    edge = F.expr(f"case when bin >= 0 then (pow(2, (bin + 1) / {BINS}) - 1) / {FINEST} else -(pow(2, -bin / {BINS}) - 1) / {FINEST} end")
    upto = counted.withColumn("upto", F.sum("c").over(each.orderBy("bin"))).withColumn("n", F.sum("c").over(each)).withColumn("edge", edge)
    at = lambda share: F.min(F.when(F.col("upto") >= (1 - share) * F.col("n"), F.col("edge")))
    middle = at(0.5)
    least = F.element_at(F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair]), F.col("measure"))
    cut = F.array(*[middle + F.greatest(at(share) - middle, least) * far for share, far in LEVELS])
    spread = upto.groupBy("group", "measure").agg(cut.alias("cuts")).select("group", "measure", F.posexplode("cuts").alias("level", "cut"))
    wide = checkpoint(spread.groupBy("group", "level").pivot("measure", list(MEASURES)).agg(F.first("cut")).select(F.col("group").alias("g"), "level", *[F.col(m).alias(f"cut_{m}") for m in MEASURES]))
    beyond = " or ".join(f"{m} > cut_{m}" for m in MEASURES)
    # Each row of the holdout meets the grid's few levels of its stratum.
    tested = known.where("not proposes").join(wide, F.col("group").eqNullSafe(F.col("g"))).groupBy("group", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"cast({beyond} as long)")).alias("k"))
    tested = checkpoint(tested)
    strata = max(1, tested.select("group").distinct().count())

    @F.pandas_udf("double")
    def refuted(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([at_most(int(a), int(b), alpha) for a, b in zip(k, n, strict=True)], dtype=float)

    passed = tested.withColumn("failed", (refuted("k", "n") > delta / strata).cast("int"))
    passed = passed.withColumn("failed", F.sum("failed").over(Window.partitionBy("group").orderBy("level"))).where("failed = 0")
    best = passed.groupBy("group").agg(F.max("level").alias("level"), F.max_by("n", "level").alias("n"), F.max_by("k", "level").alias("k"))
    chosen = best.withColumnRenamed("level", "best").join(wide, F.col("group").eqNullSafe(F.col("g")) & (F.col("best") == F.col("level")))
    member = (F.col("pooled") == F.col("group.pooled")) & (F.col("pooled") | F.col("of").eqNullSafe(F.col("group.name")))
    return sizes.join(chosen, member).select(F.col("of").alias("stratum"), "level", "n", "k", *[f"cut_{m}" for m in MEASURES])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """One row per document: its counts, base_failed, kept, and level (null: its stratum has none).

    Null and empty texts have no words and fail the base rules. Texts of any length are measured whole.
    A null stratum is a stratum. Values at a cutoff are kept. Repeated rows are kept and
    judged alike; rows of a null id are judged but never learnt from; without labels, only
    the base rules reject. Other columns are not read.
    """
    rows = checkpoint(measured(docs, id_col, stratum).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")))
    cuts = cutoffs(rows, labels, alpha, delta, id_col).withColumnRenamed("stratum", "of")
    beyond = " or ".join(f"{m} > cut_{m}" for m in MEASURES)
    judged = rows.join(cuts, F.col("of").eqNullSafe(F.col("stratum")), "left").withColumn("kept", F.expr(f"not base_failed and not coalesce({beyond}, false)"))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level")
