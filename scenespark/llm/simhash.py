"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most
``max_bits`` bits share at least ``8 - max_bits`` positional bytes: the guaranteed
minimum. A list for one positional byte alone would hold a 256th of all fingerprints, so
the index has lists for the bytes at some positions together, one position fewer than the
minimum. The choices of positions are a covering design: whatever positions a near pair shares, one
choice lies within them. In a list the shared positional bytes of every pair are tallied; pairs
below the minimum go, and those that reach it are kept in the first of their lists alone, and then
verified bit by bit. Lists with many members are cut into tiles, and every two tiles meet in a task of their own.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_row, checkpoint, connected_components, labels_of, small, stored, text_bytes
from .xxh import words_of, xxh64_ranges

#: Members of a list beyond which it is cut into tiles of about so many.
TILE = 4096

#: Bits of the map that tells sets of shingles apart: 128 bytes a text.
BITS = 1024


def majority(h: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of each owner: a bit is set if it is in over half of the owner's ``n`` hashes, which stand in order of owner."""
    step = 1 << 16  # bits are counted in blocks: memory stays bounded for very long texts
    ones = np.zeros((len(n), 64), np.int64)
    for k in range(0, len(h), step):
        bits = np.unpackbits(h[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[k : k + step]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    fp = np.zeros(len(n), np.uint64)
    for bit in range(64):
        fp |= (ones[:, bit] * 2 > n).astype(np.uint64) << np.uint64(bit)
    return fp


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of the lower-cased texts, repeats included: hashes, their texts' places, shingles of each text."""
    data, starts, ends, counts = words_of([x.lower() for x in texts])
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n
    first, at = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.concatenate([[0], np.cumsum(n)[:-1]])
    i = np.arange(n.sum()) - np.repeat(at, n) + np.repeat(first, n)
    last = i + np.repeat(np.minimum(counts, width), n) - 1
    return xxh64_ranges(data, starts[i], ends[last] - starts[i]), np.repeat(np.arange(len(texts)), n), n


def fingerprint_texts(texts: list[bytes], width: int = 3) -> np.ndarray:
    """Unsigned fingerprints: bit set if set in over half the shingles' XXH64 (seed 42)."""
    return majority(*shingle_hashes(texts, width))


def stirred(h: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes, one of each (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_fingerprints(texts: list[bytes], many: int) -> np.ndarray:
    """``many`` independent fingerprints of each text's words, lower-cased: a word's second occurrence is another word than its first."""
    h, owner, n = shingle_hashes(texts, 1)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(h))
    nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = stirred(h + nth * np.uint64(0x9E3779B97F4A7C15))
        return np.stack([majority(stirred(h + np.uint64(k + 1) * np.uint64(0xD1B54A32D192ED03)), owner, n) for k in range(many)], axis=1)


def bitmaps(h: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
    """For each of ``many`` owners BITS bits, as signed longs, which each of its distinct hashes flips one of: those of two sets differ in no more places than the sets do."""
    out, cut = np.zeros((many, BITS // 64), np.int64), np.searchsorted(owner, np.arange(many + 1))
    for at in range(0, many, 256):
        end = min(many, at + 256)
        x = slice(cut[at], cut[end])
        flips = np.bincount((owner[x] - at) * BITS + (h[x] % np.uint64(BITS)).astype(np.int64), minlength=(end - at) * BITS)
        out[at:end] = np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(end - at, -1)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, other long columns, fp): the fingerprint as a signed long. Null and empty texts, and texts of spaces alone, have zero."""
    names = (id_col, *also)

    def rows(cols):
        return {**dict(zip(names, cols[:-1], strict=True)), "fp": fingerprint_texts(cols[-1]).view(np.int64)}

    return by_row(docs, [*(F.col(c).cast("long").alias(c) for c in names), text_bytes()], ", ".join(f"{c} long" for c in (*names, "fp")), rows)


@lru_cache
def choices(share: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` positions of eight such that any ``share`` positions hold one of them: the most useful first, ties in order."""
    wanted, out = {frozenset(x) for x in combinations(range(8), share)}, []
    while wanted:
        best = max(combinations(range(8), size), key=lambda x: sum(w.issuperset(x) for w in wanted))
        out.append(best)
        wanted = {w for w in wanted if not w.issuperset(best)}
    return out


def design(max_bits: int) -> list[tuple[int, ...]]:
    """The positions of the index's lists for a limit of bits."""
    if not 0 < max_bits < 7:
        raise ValueError("max_bits must be 1 to 6")
    return choices(8 - max_bits, 7 - max_bits)


@lru_cache
def first_choice(max_bits: int) -> np.ndarray:
    """For each set of shared positions, as bits, the first of the design's choices within it; 255 if there is none."""
    out = np.full(256, 255, np.uint8)
    for k, keep in reversed(list(enumerate(design(max_bits)))):
        bits = sum(1 << p for p in keep)
        out[[m for m in range(256) if m & bits == bits]] = k
    return out


def near_in_list(f: np.ndarray, k: int, max_bits: int, tile: np.ndarray | None = None, cells: int = 1 << 20):
    """Pairs of a list's members (unsigned fingerprints) that share the minimum of bytes, belong to this list and are near.

    Some members are tallied at a time against all later ones, so that memory is bounded. With ``tile``, only pairs of
    different tiles. Yields places i < j, and the bits that differ.
    """
    first, step = first_choice(max_bits), max(1, cells // max(1, len(f)))
    for at in range(0, len(f), step):
        differ = f[at : at + step, None] ^ f[None, at:]
        shared = np.zeros(differ.shape, np.uint8)
        for p in range(8):
            shared |= ((differ >> np.uint64(8 * p)) & np.uint64(255) == 0).astype(np.uint8) << np.uint8(p)
        i, j = np.nonzero((np.bitwise_count(shared) >= 8 - max_bits) & (first[shared] == k))
        bits = np.bitwise_count(differ[i, j])
        ok = (i < j) & (bits <= max_bits)
        i, j, bits = at + i[ok], at + j[ok], bits[ok]
        if tile is not None:
            apart = tile[i] != tile[j]
            i, j, bits = i[apart], j[apart], bits[apart]
        yield i, j, bits


def tile_of(f: np.ndarray, tiles: int) -> np.ndarray:
    return np.mod(f.view(np.int64), tiles)


def spanning(fps: np.ndarray, k: int, max_bits: int, tiles: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a list's members that join the same members as all its near pairs, fewer than the members.

    ``tiles``: the members are those of two tiles of a long list, whose own pairs are found elsewhere.
    """
    f = np.unique(fps.view(np.uint64))
    root = np.arange(len(f))
    for i, j, _ in near_in_list(f, k, max_bits, tile_of(f, tiles) if tiles else None):
        if len(i):
            root = labels_of(len(f), np.concatenate([np.arange(len(f)), i]), np.concatenate([root, j]))
    led = np.flatnonzero(root != np.arange(len(f)))
    return f[led].view(np.int64), f[root[led]].view(np.int64)


def postings(fps: DataFrame, fp: str, max_bits: int, *also: str) -> DataFrame:
    """(k, shared, fp, further columns): a row for each choice of positions, with the bytes found there."""
    masks = [sum(255 << 8 * p for p in keep) for keep in design(max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).cast("short").alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("shared")) for k, m in enumerate(signed)])
    rows = fps.select(F.col(fp).alias("fp"), *also)
    # A fingerprint has many postings: the table is dealt to as many tasks as a shuffle has.
    rows = rows.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns)
    return rows.select("fp", *also, F.explode(keys).alias("x")).select("x.k", "x.shared", "fp", *also)


def lists(of: DataFrame, member: Column, by: tuple[str, ...] = ("k", "shared"), tile: int = TILE) -> DataFrame:
    """(by, i, j, tiles, members): the lists of postings that have two members or more; those with over ``tile`` members by pairs of tiles.

    tiles is null for a list that is whole; else the row has the members of tiles i and j.
    """
    long_ones = small(checkpoint(of.groupBy(*by).count().where(F.col("count") > tile).select(*by, (F.floor(F.col("count") / (2 * tile)) * 2 + 3).cast("int").alias("tiles"))))
    marked = of.join(long_ones, list(by), "left").withColumn("own", F.expr("pmod(fp, tiles)").cast("int"))
    two = F.expr("if(tiles is null, array(named_struct('i', 0, 'j', 0)), transform(sequence(0, tiles - 1), u -> named_struct('i', least(own, u), 'j', greatest(own, u))))")
    dealt = marked.withColumn("two", F.explode(two))
    out = dealt.groupBy(*by, "two.i", "two.j", "tiles").agg(F.collect_list(member).alias("members"))
    return out.where(F.size("members") > 1)


def near_pairs(fps: DataFrame, max_bits: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints of column fp that join the same ones as all pairs within ``max_bits`` bits.

    Each list gives fewer links than it has members, however many pairs are near in it.
    """

    def rows(cols):
        found = [spanning(np.array(members, np.int64), k, max_bits, tiles if i != j else None) for k, members, tiles, i, j in zip(*cols, strict=True)]
        return {"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])}

    return by_row(lists(postings(fps, "fp", max_bits), F.col("fp"), tile=tile), ["k", "members", "tiles", "i", "j"], "a long, b long", rows, 64)


def components(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, component): the smallest fingerprint that each distinct one of column fp reaches by links, whatever ids stand behind them."""
    parts = connected_components(near_pairs(fps, max_bits)).withColumnRenamed("node", "fp")
    return fps.select("fp").join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_dups(docs: DataFrame, max_bits: int = 2, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable by links of at most ``max_bits`` bits. A
    null id keeps its row, links others like any row, and has the component that it links
    with, or null if it links with null ids alone. Repeated rows stay repeated; an empty table
    gives no rows; other columns are never read.
    """
    fp = checkpoint(fingerprints(docs, id_col))
    reps = checkpoint(fp.groupBy("fp").agg(F.min(id_col).alias("rep")))
    whole = reps.join(components(reps, max_bits), "fp")
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    rep = whole.join(least, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fp.join(rep, "fp").select(id_col, hexed, "component_id")


def likest(n: np.ndarray, part: np.ndarray, maps: np.ndarray, at_least: float, most: int, tile: np.ndarray | None = None, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a list's members that may be similar and are of different parts, of each member the ``most`` likest later ones, and whether any were left out.

    ``n`` has the members' numbers of shingles, ``maps`` their bitmaps. Sets of x and y shingles that are similar differ in
    (x + y)(1 - s) / (1 + s) of them at most, bitmaps in no more. With ``tile``, only pairs of different tiles.
    """
    bound = (1 - at_least) / (1 + at_least) + 1e-9  # a little more: its last digit is a matter of rounding
    out, more, step = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], False, max(1, cells // max(1, len(n)))
    for at in range(0, len(n), step):
        x, y = slice(at, at + step), slice(at, None)
        ok = np.minimum(n[x, None], n[None, y]) >= at_least * np.maximum(n[x, None], n[None, y])
        ok &= np.triu(part[x, None] != part[None, y], 1)
        if tile is not None:
            ok &= tile[x, None] != tile[None, y]
        i, j = np.nonzero(ok)
        i, j = at + i, at + j
        apart = np.zeros(len(i), np.int64)
        for word in maps.T:
            apart += np.bitwise_count((word[i] ^ word[j]).view(np.uint64))
        ok = apart <= bound * (n[i] + n[j])
        i, j, apart = i[ok], j[ok], apart[ok]
        order = np.lexsort((j, apart, i))
        i, j = i[order], j[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < most
        more |= not keep.all()
        out.append((i[keep], j[keep]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]), more


def similar(pairs: DataFrame, shingles: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) whose arrays of distinct shingles have a Jaccard similarity of ``at_least``."""
    one, two = (shingles.select(F.col("row").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("n") >= at_least * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b")


def near_copies(docs: DataFrame, row: str = "row", at_least: float = 0.8, width: int = 5, max_bits: int = 3, prints: int = 7, most: int = 2, crowd: int = 32) -> DataFrame:
    """(row, component): texts that are linked by a Jaccard similarity of ``at_least`` between their distinct shingles of ``width`` words.

    Words are lower-cased (A to Z). Candidates are within ``max_bits`` bits in one of several fingerprints of their words;
    each is verified by its whole shingles before it links, so unlike texts never do. Texts of lists with over ``crowd`` members
    are crowded: their lists would show the same pairs again and again. Pairs of two crowded texts are found, all of them, by their shingles instead: similar
    sets of x and y shingles share ``at_least`` of the larger, so one that is shared is among the first x - ceil(x s) + 1 of the one, in order of hash, and
    the first y - ceil(y s) + 1 of the other. In a list of such a shingle pairs that bitmaps of the shingles rule out go, and each text first meets
    the ``most`` likest; once these have linked, those of different components follow, again the likest first and then all, so that none is lost.
    Texts with the same words in the same order are one text before
    anything is paired; null and empty texts and those of spaces alone are one such text. ``row`` must be distinct longs; component is
    the smallest of a group. An empty table gives no rows. Very long texts have their distinct shingles in one array.
    """

    def measured(cols):
        texts = [b" ".join(t.lower().split()) for t in cols[1]]
        f = word_fingerprints(texts, prints).view(np.int64)
        h, owner, _ = shingle_hashes(texts, width)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        return {"row": cols[0], "text_key": [xxhash.xxh3_128_digest(t) for t in texts], "n": np.bincount(owner, minlength=len(texts)), "f": list(f), "map": list(bitmaps(h, owner, len(texts)))}

    rows = stored(by_row(docs, [F.col(row).cast("long").alias("row"), text_bytes()], "row long, text_key binary, n long, f array<long>, map array<long>", measured))
    reps = stored(rows.groupBy("text_key").agg(F.min(F.struct("row", "n", "f", "map")).alias("x")).select("text_key", "x.*"))
    each = reps.where("n > 0").select("row", "n", F.posexplode("f").alias("q", "fp"))
    by = ("q", "k", "shared")
    index = postings(each, "fp", max_bits, "row", "n", "q").select("q", "k", "shared", "row")
    long_lists = small(checkpoint(index.groupBy(*by).count().where(F.col("count") > crowd).select(*by, F.lit(True).alias("long"))))
    crowded = stored(index.join(long_lists, list(by), "left").groupBy("row").agg(F.max("long").alias("crowded")).where("crowded"))

    def near(cols):
        out: dict[str, list] = {"a": [], "b": []}
        for k, members in zip(*cols, strict=True):
            f = np.array([m["fp"] for m in members], np.int64)
            n, ids = (np.array([m[c] for m in members], np.int64) for c in ("n", "row"))
            lone = np.array([not m["crowded"] for m in members])
            for i, j, _ in near_in_list(f.view(np.uint64), k, max_bits):
                # texts whose sizes differ too much are not similar
                ok = (lone[i] | lone[j]) & (np.minimum(n[i], n[j]) >= at_least * np.maximum(n[i], n[j]))
                a, b = ids[i[ok]], ids[j[ok]]
                out["a"] += np.minimum(a, b).tolist()
                out["b"] += np.maximum(a, b).tolist()
        return out

    def paired(of: DataFrame, limit: int | None) -> DataFrame:
        """(a, b, more): pairs of crowded texts of different parts that meet in a list and may be similar; a row of nulls where a list has more."""

        def rows(cols):
            out: dict[str, list] = {"a": [], "b": [], "more": []}
            for members, tiles, i, j in zip(*cols, strict=True):
                ids, n, part = (np.array([m[c] for m in members], np.int64) for c in ("fp", "n", "part"))
                maps = np.array([m["map"] for m in members], np.int64)
                a, b, more = likest(n, part, maps, at_least, limit or len(n), np.mod(ids, tiles) if i != j else None)
                a, b = ids[a], ids[b]
                out["a"] += [*np.minimum(a, b).tolist(), None][: len(a) + more]
                out["b"] += [*np.maximum(a, b).tolist(), None][: len(a) + more]
                out["more"] += [False] * len(a) + [True] * more
            return out

        return by_row(lists(of, F.struct("fp", "n", "part", "map"), ("s",)), ["members", "tiles", "i", "j"], "a long, b long, more boolean", rows, 16)

    def shingles_of(asked: DataFrame) -> DataFrame:
        """(row, s): the distinct shingles of the rows asked for, in order."""

        def arrays(cols):
            h, owner, _ = shingle_hashes(cols[1], width)
            cut = np.searchsorted(owner, np.arange(len(cols[1]) + 1))
            return {"row": cols[0], "s": [np.unique(h[x:y]).view(np.int64) for x, y in zip(cut, cut[1:], strict=False)]}

        return by_row(docs.select(F.col(row).cast("long").alias("row"), "text").join(asked, "row", "left_semi"), ["row", text_bytes()], "row long, s array<long>", arrays, 64)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs)
        asked = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        return stored(similar(pairs, stored(shingles_of(asked)), at_least))

    def joined(links: DataFrame) -> DataFrame:
        return checkpoint(connected_components(links).select(F.col("node").alias("row"), "component"))

    def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """The pairs whose rows are in different components by now."""
        for c in "ab":
            pairs = pairs.join(parts.select(F.col("row").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
        return pairs.where("ca <> cb").drop("ca", "cb")

    told = reps.where("n > 0").join(crowded, "row", "left").select("row", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.posexplode("f").alias("q", "fp"))
    member = F.struct("fp", "row", "n", "crowded")
    short = postings(told, "fp", max_bits, "row", "n", "q", "crowded").join(long_lists, list(by), "left_anti").groupBy(*by).agg(F.collect_list(member).alias("members"), F.bool_and("crowded").alias("all"))
    pairs = by_row(short.where("size(members) > 1 and not all"), ["k", "members"], "a long, b long", near).distinct()
    bound = (1 - at_least) / (1 + at_least) + 1e-9  # as in likest
    for c in "ab":
        pairs = pairs.join(reps.select(F.col("row").alias(c), F.col("map").alias(f"m{c}"), F.col("n").alias(f"n{c}")), c)
    far = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda x, y: x + y)
    pairs = stored(pairs.select("a", "b", far.alias("d"), (F.col("na") + F.col("nb")).alias("n")).where(F.col("d") <= bound * F.col("n")).select("a", "b", "d"))
    # first the likeliest partners of each text, then the pairs that these have not joined
    rank = lambda of, other: F.row_number().over(Window.partitionBy(of).orderBy("d", other))
    likely = pairs.withColumn("r", rank("a", "b")).where("r <= 2").select("a", "b").unionByName(pairs.withColumn("r", rank("b", "a")).where("r <= 2").select("a", "b")).distinct()
    likely = stored(likely)
    links = linked(likely)
    parts = joined(links)
    others = apart(pairs.select("a", "b").join(likely, ["a", "b"], "left_anti"), parts)
    links = links.unionByName(linked(others))
    parts = joined(links)
    if not crowded.isEmpty():
        first = F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(at_least) - 1e-6) + 1).cast("int"))
        met = stored(shingles_of(crowded.select("row")).join(reps.select("row", "n", "map"), "row").select("row", "n", "map", first.alias("first")))
        for limit in (most, most, None):
            of = met.join(parts, "row", "left").select("row", "n", "map", F.coalesce("component", "row").alias("part"), F.explode("first").alias("s"))
            found = stored(paired(of.withColumnRenamed("row", "fp"), limit))
            more_links = linked(found.where("not more").select("a", "b").distinct())
            if not more_links.isEmpty():
                links = links.unionByName(more_links)
                parts = joined(links)
            if found.where("more").isEmpty():
                break
    own = reps.join(parts, "row", "left").select("text_key", F.coalesce("component", "row").alias("component"))
    return rows.select("row", "text_key").join(own, "text_key").select("row", "component")
