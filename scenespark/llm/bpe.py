"""Byte-level BPE by merge replay over a corpus of distinct words.

The words of a block of texts are made distinct; an inverted index leads from each rank
to the word positions where a pair of neighbours makes that token. Ranks are replayed in
order over the whole block, touching only the neighbours of what is merged. A merge that
makes a pair of a lower rank is rare, but possible: that rank is replayed first, and the
rest of its word waits, so that the ids are those of merging each word by itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_row

# Letters, digits and spaces below U+0100: for texts of such characters the pattern gives the
# same matches with the standard library's faster classes.
LETTERS, DIGITS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
# Letters and digits that Unicode gained after the version that the rank files'
# library knows, to which they are neither.
NEWER = "".join(
    "-".join(f"\\U{int(x, 16):08X}" for x in run.split("-"))
    for run in """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
    10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
    187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
    1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
    2CEA2-2CEAD 323B0-33479 3D000-3FC3F
    """.split()
)
#: Longer words, in bytes, are merged one occurrence at a time.
LONG = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pairs:
    """For two neighbouring ids, the rank of the token they make together."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in sorted(found)] + [self.NONE], np.int32)
        self.of_byte = np.array([ranks[bytes([x])] for x in range(256)], np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], self.NONE) if len(self.keys) else np.full(len(a), self.NONE, np.int32)


def replay_block(words: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids one after the other, and how many each has (no word is empty).

    All occurrences of a rank in different words are merged at once.
    """
    none = Pairs.NONE
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sym = pairs.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    nxt, prv = np.arange(1, len(sym) + 1, dtype=np.int32), np.arange(-1, len(sym) - 1, dtype=np.int32)
    ends = np.cumsum(sizes)
    nxt[ends - 1] = -1
    prv[ends - sizes] = -1
    rank_at = np.full(len(sym), none, np.int32)  # of the pair that begins at a position
    left = np.flatnonzero(nxt >= 0)
    rank_at[left] = pairs(sym[left], sym[left + 1])
    alive = np.ones(len(sym), bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(places: np.ndarray) -> None:
        r = rank_at[places]
        order = np.argsort(r, kind="stable")
        r, places = r[order], places[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for rank, part in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(heap, rank)

    left = left[rank_at[left] != none]
    if len(left):
        add(left)
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank, None)
        if parts is None:
            continue
        places = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        places = places[rank_at[places] == rank]
        while len(places):
            w = word_of[places]
            first = np.ones(len(places), bool)
            first[1:] = w[1:] != w[:-1]
            i, rest = places[first], places[~first]
            j = nxt[i]
            k = nxt[j]
            sym[i] = rank
            nxt[i] = k
            alive[j] = False
            rank_at[j] = none
            rank_at[i] = none
            has = k >= 0
            ri, rk = i[has], k[has]
            prv[rk] = ri
            rank_at[ri] = pairs(sym[ri], sym[rk])
            p = prv[i]
            has = p >= 0
            li, lp = i[has], p[has]
            rank_at[lp] = pairs(sym[lp], sym[li])
            new = np.concatenate([ri, lp])
            new = new[rank_at[new] != none]
            if len(new):
                add(np.unique(new))
            if not len(rest):
                break
            low = new[rank_at[new] < rank]
            if len(low):
                waits = np.isin(word_of[rest], word_of[low])
                later = rest[waits & (rank_at[rest] == rank)]
                if len(later):
                    add(later)
                rest = rest[~waits]
            places = rest[rank_at[rest] == rank]
    return sym[alive], np.bincount(word_of[alive], minlength=len(words))


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each word, one occurrence after the other: for words with long runs."""
    out: list = [None] * len(words)
    tok: list[bytes] = []
    word_of: list[int] = []
    nxt: list[int] = []
    prv: list[int] = []
    first: list[tuple[int, int]] = []
    singles = [bytes([x]) for x in range(256)]
    for k, w in enumerate(words):
        at = len(tok)
        first.append((k, at))
        tok.extend(map(singles.__getitem__, w))
        word_of.extend([k] * len(w))
        prv.extend(range(at - 1, at + len(w) - 1))
        nxt.extend(range(at + 1, at + len(w) + 1))
        prv[at] = -1
        nxt[-1] = -1
    rank_at = [-1] * len(tok)  # the rank of the pair that begins at a position
    index: dict[int, list[int]] = defaultdict(list)
    get = ranks.get
    for i, j in enumerate(nxt):
        if j >= 0 and (r := get(tok[i] + tok[j])) is not None:
            rank_at[i] = r
            index[r].append(i)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        if rank not in index:
            continue
        places = index.pop(rank)
        places.sort()
        waits, later = -1, []
        for i in places:
            if rank_at[i] != rank:
                continue
            if word_of[i] == waits:
                later.append(i)
                continue
            j = nxt[i]
            tok[i] += tok[j]
            rank_at[j] = -1
            nxt[i] = k = nxt[j]
            rank_at[i] = -1
            if k >= 0:
                prv[k] = i
                if (r := get(tok[i] + tok[k])) is not None:
                    rank_at[i] = r
                    if r not in index:
                        heapq.heappush(heap, r)
                    index[r].append(i)
                    if r < rank:
                        waits = word_of[i]
            p = prv[i]
            if p >= 0:
                rank_at[p] = -1
                if (r := get(tok[p] + tok[i])) is not None:
                    rank_at[p] = r
                    if r not in index:
                        heapq.heappush(heap, r)
                    index[r].append(p)
                    if r < rank:
                        waits = word_of[i]
        if later:
            if rank not in index:
                heapq.heappush(heap, rank)
            index[rank].extend(later)
    for k, i in first:
        ids = []
        while i >= 0:
            ids.append(ranks[tok[i]])
            i = nxt[i]
        out[k] = ids
    return out


class Codec:
    """Encodes blocks of texts; remembers words up to a number of them, then begins anew."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: Pairs | None = None, remember: int = 120_000):
        self.ranks, self.remember = ranks, remember
        self.pairs = pairs or Pairs(ranks)
        self.decimal = [str(k) for k in range(max(ranks.values()) + 1)]
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        old = pattern.replace(r"\p{L}\p{N}]", rf"\p{{L}}\p{{N}}]||[{NEWER}]]").replace(r"[^\s\p{L}", r"[[^\s\p{L}")
        for kind in "LN":
            old = old.replace(rf"\p{{{kind}}}+", rf"[\p{{{kind}}}--[{NEWER}]]+")
        self.any = regex.compile(old, regex.V1)
        quick = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{BLANKS}{LETTERS}{DIGITS}]").replace(r"\p{L}+", f"[{LETTERS}]+").replace(r"\p{N}+", f"[{DIGITS}]+").replace(r"\S", f"[^{BLANKS}]").replace(r"\s", f"[{BLANKS}]")
        self.quick = None if "\\p" in quick else re.compile(quick)
        # Words to their ids, as bytes of int32: atoms, so that the collector of cyclic garbage
        # has nothing to visit.
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if self.quick:
            try:
                text.encode("latin-1")
                return self.quick.findall(text)
            except UnicodeEncodeError:
                pass
        return self.any.findall(text)

    def learn(self, words: list[str]) -> None:
        """Remember the ids of distinct words. A word that is itself a token is that token."""
        short, long, raw = [], [], []
        for w in words:
            b = w.encode()
            if (r := self.ranks.get(b)) is not None:
                self.known[w] = array("i", [r]).tobytes()
            elif len(b) <= LONG:
                short.append(w)
                raw.append(b)
            else:
                long.append(w)
        for w, ids in zip(long, replay([w.encode() for w in long], self.ranks), strict=True):
            self.known[w] = array("i", ids).tobytes()
        if short:
            ids, counts = replay_block(raw, self.pairs)
            data, a = ids.astype(np.intc).tobytes(), 0
            for w, b in zip(short, (4 * np.cumsum(counts)).tolist(), strict=True):
                self.known[w] = data[a:b]
                a = b

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.words(x) for x in texts]
        if len(self.known) > self.remember:
            self.known = {}
        self.learn(list(set(chain.from_iterable(split)) - self.known.keys()))
        ids_of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, words)), np.intc) for words in split]

    def said(self, ids: np.ndarray) -> str:
        """Ids in decimal, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


#: A worker's own codecs, which last from task to task.
made: dict[tuple[str, str], Codec] = {}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, ids: bool = False, decoded: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Per document: id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also the ids
    (array<int>), with ``decoded`` the decoded text. A null text is empty: no tokens and
    the digests of nothing. Rows and their repeats are kept as they come; other columns
    are not read. The ranks, whose number is fixed, are broadcast.
    """
    spark: SparkSession = docs.sparkSession
    ranks = load_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, Pairs(ranks)))

    def rows(cols):
        if (ranks_path, pattern) not in made:
            made[ranks_path, pattern] = Codec(shared.value[0], pattern, shared.value[1])
        codec = made[ranks_path, pattern]
        out = defaultdict(list)
        for found in codec.encode(cols[1]):
            out["n_tokens"].append(len(found))
            out["ids_sha256"].append(hashlib.sha256(codec.said(found).encode()).hexdigest())
            back = codec.decode(found)
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            if ids:
                out["ids"].append(found)
            if decoded:
                out["decoded"].append(back.decode())
        return {id_col: cols[0], **out}

    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return by_row(docs, [F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")], schema, rows, chunk=512)
