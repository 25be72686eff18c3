"""Language-model scoring by a hierarchical Pitman-Yor model.

A token's context is the word before it, or none at a text's begin. Every context has a
restaurant; all share the root restaurant as parent, whose base is even over the known
tokens and one unknown. No context, token or pair of them is left out, and no table of
them is gathered: words are 64-bit hashes, and three tables of packed columns hold all.

* blocks: some millions of tokens each, as numbers of the block's own words, with the
  documents they belong to. A text is read and split once.
* pairs, by the hash of context and token, with the customers n of each distinct pair and, for
  every block, where its pairs stand.
* words, by their hash, with their customers as a context, as a token, and in the root.

Messages between them are packed columns too: what stands in a bucket of one that the
other asked for, in an order both know, so that keys travel once. Given the totals of its
context and the root's probability of its token, the seating of a pair's customers
depends on no other pair's, so that Gibbs sampling goes pair by pair wherever they lie: a
sweep seats a pair's customers anew one after the other by the predictive weights, and
accepts that by Metropolis-Hastings; the tables laid are the token's customers in the root,
which are seated likewise. Rounds of sweeps renew the totals and the root's
probabilities; the last round's sweeps give averaged predictive probabilities. Every
draw is a function of the pair's hash, so that neither partitions nor reruns change a
score. Discounts come from the counts of ones and twos.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, released, stored, text_bytes

STRENGTH = 1.0
#: Tokens in a block, and in all blocks for each bucket of pairs or words, about.
BLOCK, BUCKET = 1_500_000, 2_500_000
#: Customers of a pair that are seated singly; later ones come a sixty-fourth of those seated at a time.
SINGLY = 512
U = np.uint64


# --- packed columns -----------------------------------------------------------------------------------
def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """A column as bytes: differences where it rises, then byte by byte, compressed."""
    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True) if len(x) else b"")


def unpack(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * width, asbytes=True), np.uint8).reshape(width, n)
    x = np.ascontiguousarray(planes.T).view(kind).reshape(n)
    return np.cumsum(x, dtype=kind) if rising else x


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()), "array<binary>": pa.list_(pa.binary())}


def table(schema: str, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([(name, KINDS[kind]) for name, kind in (f.split() for f in schema.split(", "))]))


# --- hashes and draws ---------------------------------------------------------------------------------
def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the published SplitMix64 generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(u) * U(3) + w)


def uniform(seeds: np.ndarray, k: int) -> np.ndarray:
    """The k-th number between 0 and 1 of each seed."""
    with np.errstate(over="ignore"):
        return (mixed(seeds + U(k * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(11)).astype(np.float64) * 2.0**-53


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n - 1 that rise with the hash."""
    return (((h >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def cuts(h: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of every bucket that has some of the sorted hashes."""
    b = bucket(h, n)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    return list(zip(b[at].tolist(), at.tolist(), [*at[1:].tolist(), len(b)], strict=True))


# --- seating ------------------------------------------------------------------------------------------
def seat(n: np.ndarray, a: np.ndarray, d: float, seeds: np.ndarray, sweep: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Seat n customers of each row one after the other; a: the weight of a new table beside discounts.

    Returns the number of tables and the log of the proposal's weight. After SINGLY
    customers, those who come at once meet the same weights, and the number of them that take new
    tables is rounded at random, without bias.
    """
    order = np.argsort(-n, kind="stable")
    c, a, seeds = n[order].astype(np.int64), a[order], seeds[order]
    t, log = (c > 0).astype(np.float64), np.zeros(len(c))
    j, k = 1, int((c > 1).sum())
    while k:
        m = np.minimum(1 if j < SINGLY else j // 64, c[:k] - j)
        total = a[:k] + np.maximum(j + (m - 1) / 2 - d * t[:k], 1e-12)
        t[:k] += np.floor(m * (a[:k] / total) + uniform(seeds[:k], (sweep + 1 << 40) + j))
        log[:k] += m * np.log(total)
        j += 1 if j < SINGLY else j // 64
        k = int(np.searchsorted(-c[:k], -j))
    back = np.empty(len(c), np.int64)
    back[order] = np.arange(len(c))
    return t[back], log[back]


def sampled(n: np.ndarray, a: np.ndarray, d: float, seeds: np.ndarray, sweeps: int, burn: int) -> tuple[np.ndarray, np.ndarray]:
    """The last sweep's tables for n customers of each row, and the sum of those of the sweeps after ``burn``."""
    t, log = seat(n, a, d, seeds)
    total = np.zeros(len(n)) if burn else t.copy()
    for k in range(1, sweeps):
        t2, log2 = seat(n, a, d, seeds, k)
        take = np.log(np.maximum(uniform(seeds, k + 1 << 40), 1e-300)) < log2 - log
        t, log = np.where(take, t2, t), np.where(take, log2, log)
        if k >= burn:
            total += t
    return t.astype(np.int64), total.astype(np.int64)


def discount(ones: float, twos: float) -> float:
    """From how many have one customer and how many two; within bounds that keep every weight positive."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.75


# --- blocks -------------------------------------------------------------------------------------------
class Ids(dict):
    """Numbers new words in order."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


BLOCKS = "b long, tokens long, words binary, seq binary, sizes binary, taught binary, ids array<long>, held array<boolean>"


def blocks_of(docs: DataFrame) -> DataFrame:
    """docs: (id, held, taught, text as bytes). A row per block; a block's first word is the empty one, which ends a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def fresh():
            ids = Ids()
            return ids, ids[b""], [], [], [], [], []

        def block():
            nonlocal made
            b = TaskContext.get().partitionId() << 32 | made
            made += 1
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in ids), U, len(ids))
            flat = np.concatenate(seq)
            row = {"b": b, "tokens": len(flat), "words": pack(hashes), "seq": pack(flat), "sizes": pack(np.array(sizes, np.int32)), "taught": pack(np.array(taught, np.uint8)), "ids": keys, "held": held}
            return table(BLOCKS, [row]).to_batches()[0]

        ids, end, seq, sizes, taught, keys, held = fresh()
        n = 0
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column(3)[row].as_py().lower().split()
                words.append(b"")
                seq.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                sizes.append(len(words))
                n += len(words)
                keys.append(batch.column(0)[row].as_py())
                held.append(batch.column(1)[row].as_py())
                taught.append(bool(batch.column(2)[row].as_py()))
                if n >= BLOCK:
                    yield block()
                    ids, end, seq, sizes, taught, keys, held = fresh()
                    n = 0
        if sizes:
            yield block()

    return docs.select("id", "held", "taught", "text").mapInArrow(run, BLOCKS)


def opened(row: dict) -> dict:
    """A block's distinct pairs in the order of their hashes, and for each token the place of its pair."""
    words, seq = unpack(row["words"], U), unpack(row["seq"], np.int32)
    sizes, taught = unpack(row["sizes"], np.int32), unpack(row["taught"], np.uint8)
    before = np.concatenate([[0], seq[:-1]])  # the end of the text before, or the first word, which is the end
    keys, place = np.unique(before.astype(np.int64) << 32 | seq, return_inverse=True)
    u, w = keys >> 32, keys & 0xFFFFFFFF
    h = pair_hash(words[u], words[w])
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    u, w, h, place = u[order], w[order], h[order], rank[place]
    n = np.bincount(place, np.repeat(taught, sizes), len(h)).astype(np.int64)
    speaks = np.zeros(len(h), bool)  # the first pair with a token asks for the token's count
    speaks[np.unique(w, return_index=True)[1]] = True
    return {"words": words, "seq": seq, "sizes": sizes, "u": u, "w": w, "h": h, "place": place, "n": n, "speaks": speaks}


ASKED = "q int, b long, words binary, u binary, w binary, n binary, speaks binary"


def asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """A row for each block and bucket of pairs."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x = opened(row)
                out = []
                for q, i, j in cuts(x["h"], buckets):
                    own, at = np.unique(np.concatenate([x["u"][i:j], x["w"][i:j]]), return_inverse=True)
                    order = np.argsort(x["words"][own], kind="stable")
                    rank = np.empty(len(own), np.uint32)
                    rank[order] = np.arange(len(own), dtype=np.uint32)
                    u, w = np.split(rank[at], 2)
                    out.append({"q": q, "b": row["b"], "words": pack(x["words"][own[order]], True), "u": pack(u), "w": pack(w), "n": pack(x["n"][i:j]), "speaks": pack(x["speaks"][i:j].astype(np.uint8))})
                yield from table(ASKED, out).to_batches(64)

    return blocks.select("b", "words", "seq", "sizes", "taught").mapInArrow(run, ASKED)


# --- pairs and words ----------------------------------------------------------------------------------
PAIRS = "q int, words binary, u binary, w binary, n binary, ones long, twos long, bs array<long>, at array<binary>, speaks array<binary>"


def distinct_pairs(group: pa.Table) -> pa.Table:
    """One row of a bucket's distinct pairs in the order of their hashes, and each block's places among them."""
    rows = sorted(group.to_pylist(), key=lambda r: r["b"])
    words = [unpack(r["words"], U, True) for r in rows]
    every = np.unique(np.concatenate(words))
    keys = []
    for r, own in zip(rows, words, strict=True):
        to = np.searchsorted(every, own).astype(np.int64)
        keys.append(to[unpack(r["u"], np.uint32)] << 32 | to[unpack(r["w"], np.uint32)])
    sizes = [len(k) for k in keys]
    pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.concatenate([unpack(r["n"], np.int64) for r in rows]), len(pairs)).astype(np.int64)
    u, w = pairs >> 32, pairs & 0xFFFFFFFF
    order = np.argsort(pair_hash(every[u], every[w]), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = np.split(rank[at].astype(np.uint32), np.cumsum(sizes)[:-1])
    u, w, n = u[order].astype(np.uint32), w[order].astype(np.uint32), n[order]
    return table(PAIRS, [{"q": rows[0]["q"], "words": pack(every, True), "u": pack(u), "w": pack(w), "n": pack(n), "ones": int((n == 1).sum()), "twos": int((n == 2).sum()), "bs": [r["b"] for r in rows], "at": [pack(p, True) for p in places], "speaks": [r["speaks"] for r in rows]}])


SUMS = "r int, q int, words binary, cu binary, cw binary, tu binary, tw binary"


def first_sums(pairs: DataFrame, buckets: int) -> DataFrame:
    """For each bucket of words what a bucket of pairs holds of its words: customers, and tables, one a pair at first."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                words, u, w, n = unpack(row["words"], U, True), unpack(row["u"], np.uint32), unpack(row["w"], np.uint32), unpack(row["n"], np.int64)
                sums = [np.bincount(side, weight, len(words)).astype(np.int64) for weight in (n, n > 0) for side in (u, w)]
                out = [{"r": r, "q": row["q"], "words": pack(words[i:j], True), **{c: pack(s[i:j]) for c, s in zip(("cu", "cw", "tu", "tw"), sums, strict=True)}} for r, i, j in cuts(words, buckets)]
                yield from table(SUMS, out).to_batches(64)

    return pairs.select("q", "words", "u", "w", "n").mapInArrow(run, SUMS)


WORDS = "r int, words binary, cu binary, cw binary, tu binary, tw binary, customers long, known long, guests long, ones long, twos long, qs array<int>, at array<binary>"


def distinct_words(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["q"])
    own = [unpack(r["words"], U, True) for r in rows]
    every = np.unique(np.concatenate(own))
    at = [np.searchsorted(every, x) for x in own]
    flat = np.concatenate(at)
    cu, cw, tu, tw = (np.bincount(flat, np.concatenate([unpack(r[c], np.int64) for r in rows]), len(every)).astype(np.int64) for c in ("cu", "cw", "tu", "tw"))
    return table(WORDS, [{"r": rows[0]["r"], "words": pack(every, True), "cu": pack(cu), "cw": pack(cw), "tu": pack(tu), "tw": pack(tw), "customers": int(cw.sum()), "known": int((cw > 0).sum()), "guests": int(tw.sum()), "ones": int((tw == 1).sum()), "twos": int((tw == 2).sum()), "qs": [r["q"] for r in rows], "at": [pack(x.astype(np.uint32), True) for x in at]}])


def renewed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A bucket of words with the tables laid in the last round."""
    row = left.to_pylist()[0]
    of = {q: unpack(x, np.uint32, True) for q, x in zip(row["qs"], row["at"], strict=True)}
    n = len(unpack(row["cu"], np.int64))
    tu, tw = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in right.to_pylist():
        tu[of[r["q"]]] += unpack(r["tu"], np.int64)
        tw[of[r["q"]]] += unpack(r["tw"], np.int64)
    row |= {"tu": pack(tu), "tw": pack(tw), "guests": int(tw.sum()), "ones": int((tw == 1).sum()), "twos": int((tw == 2).sum())}
    return table(WORDS, [row])


ROOT_SWEEPS, ROOT_BURN = 4, 1


def root_tables(row: dict, fresh: float, d: float) -> np.ndarray:
    """The averaged tables of the root for a bucket's words."""
    seeds = mixed(unpack(row["words"], U, True))
    tw = unpack(row["tw"], np.int64)
    return sampled(tw, np.full(len(tw), fresh), d, seeds, ROOT_SWEEPS, ROOT_BURN)[1] / (ROOT_SWEEPS - ROOT_BURN)


def root(words: DataFrame, tables: float) -> dict:
    """The numbers that all share in the root; ``tables``: how many it had in the round before."""
    known, guests, ones, twos = (float(x or 0) for x in words.agg(*[F.sum(c) for c in ("known", "guests", "ones", "twos")]).first())
    d, base = discount(ones, twos), 1.0 / (known + 1)
    before = (STRENGTH + d * (tables or known)) * base

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield table("laid double", [{"laid": float(root_tables(batch.slice(k, 1).to_pylist()[0], before, d).sum())}]).to_batches()[0]

    laid = float(words.select("words", "tw").mapInArrow(run, "laid double").agg(F.sum("laid")).first()[0] or 0)
    fresh = (STRENGTH + d * laid) * base
    return {"d": d, "before": before, "laid": laid, "fresh": fresh, "guests": guests, "unknown": fresh / (STRENGTH + guests)}


TOLD = "q int, r int, p binary, tu binary, cu binary, cw binary"


def told(words: DataFrame, shared: dict, counts: bool = False) -> DataFrame:
    """For each bucket of pairs the root's probabilities of its words, their tables as contexts and, if asked for, their customers."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                p = (unpack(row["tw"], np.int64) - shared["d"] * root_tables(row, shared["before"], shared["d"]) + shared["fresh"]) / (STRENGTH + shared["guests"])
                tu, cu, cw = (unpack(row[c], np.int64) for c in ("tu", "cu", "cw"))
                for q, x in zip(row["qs"], row["at"], strict=True):
                    at = unpack(x, np.uint32, True)
                    more = {"cu": pack(cu[at]), "cw": pack(cw[at])} if counts else {}
                    yield from table(TOLD, [{"q": q, "r": row["r"], "p": pack(p[at]), "tu": pack(tu[at]), **more}]).to_batches()

    return words.mapInArrow(run, TOLD)


def joined(right: pa.Table, names: dict[str, type]) -> list[np.ndarray]:
    """Columns told by all buckets of words, in the order of a bucket's own words."""
    rows = sorted(right.to_pylist(), key=lambda r: r["r"])
    return [np.concatenate([unpack(r[c], kind) for r in rows]) for c, kind in names.items()]


LAID = "q int, r int, tu binary, tw binary, laid binary"


def seated(pairs: DataFrame, told_: DataFrame, buckets: int, d: float, per: int, sweeps: int, burn: int, round_: int) -> DataFrame:
    """Sweeps over every pair: a row for each bucket of words, and one without with each pair's tables, summed over sweeps.

    ``per``: the sweeps over which the contexts' tables, as told, are summed.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        words, u, w, n = unpack(row["words"], U, True), unpack(row["u"], np.uint32), unpack(row["w"], np.uint32), unpack(row["n"], np.int64)
        p, tu = joined(right, {"p": np.float64, "tu": np.int64})
        t = (n > 0).astype(np.int64)
        total = t * (sweeps - burn)
        # A pair of one customer has one table whatever is drawn, so that only the others are seated.
        i = np.flatnonzero(n > 1)
        ui, wi = u[i], w[i]
        seeds = mixed(pair_hash(words[ui], words[wi]) + U(round_))
        t[i], total[i] = sampled(n[i], (STRENGTH + d * tu[ui] / per) * p[wi], d, seeds, sweeps, burn)
        laid_u, laid_w = np.bincount(u, total, len(words)).astype(np.int64), np.bincount(w, t, len(words)).astype(np.int64)
        out = [{"q": row["q"], "r": r, "tu": pack(laid_u[a:b]), "tw": pack(laid_w[a:b])} for r, a, b in cuts(words, buckets)]
        return table(LAID, [*out, {"q": row["q"], "laid": pack(total)}])

    return pairs.select("q", "words", "u", "w", "n").groupBy("q").cogroup(told_.groupBy("q")).applyInArrow(meet, LAID)


RATED = "b long, q int, score binary, c binary"


def rated(pairs: DataFrame, laid: DataFrame, told_: DataFrame, d: float, per: int) -> DataFrame:
    """For each block the log10 probabilities of its pairs, and the customers of the tokens it asked for."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        u, w, n = unpack(row["u"], np.uint32), unpack(row["w"], np.uint32), unpack(row["n"], np.int64)
        p, tu, cu, cw = joined(right, {"p": np.float64, "tu": np.int64, "cu": np.int64, "cw": np.int64})
        back = (STRENGTH + d * tu / per) / (STRENGTH + cu)
        score = np.log10((n - d * unpack(row["laid"], np.int64) / per) / (STRENGTH + cu[u]) + back[u] * p[w]).astype(np.float32)
        out = []
        for b, x, speaks in zip(row["bs"], row["at"], row["speaks"], strict=True):
            at = unpack(x, np.uint32, True)
            out.append({"b": b, "q": row["q"], "score": pack(score[at]), "c": pack(cw[w[at[unpack(speaks, np.uint8) > 0]]])})
        return table(RATED, out)

    own = pairs.select("q", "u", "w", "n", "bs", "at", "speaks").join(laid.where("laid is not null").select("q", "laid"), "q")
    return own.groupBy("q").cogroup(told_.groupBy("q")).applyInArrow(meet, RATED)


def scored(blocks: DataFrame, rates: DataFrame, id_col: str, floor: float, train: int) -> DataFrame:
    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        x = opened(row)
        rows = sorted(right.to_pylist(), key=lambda r: r["q"])
        score = np.concatenate([unpack(r["score"], np.float32) for r in rows]).astype(np.float64)
        c = np.zeros(len(x["words"]), np.int64)
        c[x["w"][x["speaks"]]] = np.concatenate([unpack(r["c"], np.int64) for r in rows])
        of, many = np.repeat(np.arange(len(x["sizes"])), x["sizes"]), len(x["sizes"])
        base = np.log10((c + 0.1) / floor)[x["seq"]]
        columns = [row["ids"], row["held"], x["sizes"], np.bincount(of, c[x["seq"]] > 0, many).astype(np.int64), np.full(many, train), np.bincount(of, base, many), np.bincount(of, score[x["place"]], many)]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

    return blocks.groupBy("b").cogroup(rates.groupBy("b")).applyInArrow(meet, schema)


def scores(docs: DataFrame, id_col: str = "doc_id", rounds: int = 1, sweeps: int = 4, burn: int = 1) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32 of the id as text, modulo 10, is not 0 (a null id's
    texts are scored, not learnt). A null text is empty: its end is its only token. A text of any
    length is one of its block's, whole. Repeated rows keep a row each and all count in training; equal
    texts have equal scores; an empty table gives no rows; with nothing learnt every token is
    the unknown one. Other columns are not read. Beside the stated sums over buckets nothing reaches
    the driver.
    """
    marked = docs.select(F.col(id_col).cast("long").alias("id"), (crc_mod(id_col, 10) == 0).alias("held"), (crc_mod(id_col, 10) != 0).alias("taught"), text_bytes())
    blocks = stored(blocks_of(marked))
    buckets = max(1, -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // BUCKET))
    pairs = stored(asked(blocks, buckets).groupBy("q").applyInArrow(distinct_pairs, PAIRS))
    d = discount(*(float(x or 0) for x in pairs.agg(F.sum("ones"), F.sum("twos")).first()))
    words = stored(first_sums(pairs, buckets).groupBy("r").applyInArrow(distinct_words, WORDS))
    train, known = (int(x or 0) for x in words.agg(F.sum("customers"), F.sum("known")).first())
    shared, per = root(words, 0.0), 1
    for k in range(rounds + 1):
        last = k == rounds
        laid = stored(seated(pairs, told(words, shared), buckets, d, per, sweeps if last else 2, burn if last else 1, k))
        after = stored(words.groupBy("r").cogroup(laid.where("r is not null").groupBy("r")).applyInArrow(renewed, WORDS))
        released(words)
        words, per = after, sweeps - burn if last else 1
        shared = root(words, shared["laid"])
        if not last:
            released(laid)
    rates = stored(rated(pairs, laid, told(words, shared, counts=True), d, per))
    for done in (pairs, laid, words):
        released(done)
    return scored(blocks, rates, id_col, train + 0.1 * (known + 1), train)
