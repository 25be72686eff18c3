"""Secret scans: Aho-Corasick prefilter, anchored expressions near hits, checksums.

One pass of an automaton over the text finds every keyword; only where one ends is an
expression tried, anchored at the keyword's beginning. For runs of hexadecimal digits the
keywords are all sequences of four such digits. Kinds beside the base ones carry a
checksum or an encoded header inside the secret, and count only if that is right.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row

HEX = "0123456789abcdef"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_token(m: re.Match) -> bool:
    """A token whose last six characters are the CRC-32 of the thirty before, in base 62."""
    body, n, said = m[1][:30], zlib.crc32(m[1][:30].encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        said = BASE62[k] + said
    return m[1][30:] == said and len(body) == 30


def base58_key(m: re.Match) -> bool:
    """Base 58 whose last four bytes begin the double SHA-256 of the others."""
    n = 0
    for c in m[0]:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def jwt(m: re.Match) -> bool:
    """A header in base 64 that is a JSON object and names an algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error, TypeError, RecursionError):
        return False


#: Kind, keywords in lower case, expression, test of its match. Base kinds come first.
KINDS = [
    ("assign", ["password", "passwd", "secret", "token", "apikey", "api_key"], r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    ("access", ["akia"], r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", ["".join(x) for x in product(HEX, repeat=4)], r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ("code_host", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])", crc_token),
    ("package_host", ["npm_"], r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])", crc_token),
    ("wallet", ["xprv"], rf"xprv[{BASE58}]{{107}}(?![{BASE58}])", base58_key),
    ("jwt", ["eyj"], r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", jwt),
]
BASE = 3


class Scanner:
    def __init__(self):
        self.found_by = ahocorasick.Automaton()
        for k, (_, words, _, _) in enumerate(KINDS):
            for w in words:
                self.found_by.add_word(w, (k, len(w)))
        self.found_by.make_automaton()
        self.tries = [re.compile(x[2]).match for x in KINDS]
        self.tests = [x[3] for x in KINDS]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in order; leftmost and not overlapping within each kind."""
        low = text.lower()
        if len(low) != len(text):  # a capital whose lower case is two characters
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        hits: list[list[int]] = [[] for _ in KINDS]
        for at, (k, n) in self.found_by.iter(low):
            hits[k].append(at - n + 1)
        out = []
        for k, starts in enumerate(hits):
            if starts:
                attempt, test, past = self.tries[k], self.tests[k], -1
                for at in starts if k == 2 else sorted(starts):
                    if at >= past and (m := attempt(text, at)):
                        past = m.end()
                        if test(m):
                            out.append((at, k, past))
        return sorted(out)


made: list[Scanner] = []


def scanner() -> Scanner:
    """The worker's own scanner, made when first needed."""
    if not made:
        made.append(Scanner())
    return made[0]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_more.

    Spans are ``kind:start:end`` in code points, by start and then kind. A null text is
    empty: no spans and the digest of nothing. A text of any length is scanned whole, in one
    pass of the automaton. Spans of several kinds may begin at one place; they come in the kinds'
    order. Repeated rows are kept; an empty table gives no rows; other columns are not read.
    """

    def rows(cols):
        scan = scanner()
        out = {id_col: cols[0], **{c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_more")}}
        for text in cols[1]:
            found = scan.spans(text)
            kinds = [k for _, k, _ in found]
            for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                out[c].append(kinds.count(k))
            out["n_more"].append(sum(k >= BASE for k in kinds))
            out["base_sha256"].append(hashlib.sha256(joined([x for x in found if x[1] < BASE]).encode()).hexdigest())
            out["spans"].append(joined(found))
        return out

    return by_row(docs, [F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")], f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_more long", rows)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of the text replaced by ``mark``.

    Overlapping spans become one mark. Null and empty texts stay as they are, texts of any
    length are scanned whole, repeated rows are cleaned alike, and an empty table gives no rows; n_chars,
    where there is such a column, is counted anew for texts that change.
    """

    def clean(texts):
        scan = scanner()
        out = []
        for x in texts:
            found = scan.spans(x) if x else []
            parts, past = [], 0
            for a, _, b in found:
                if a >= past:
                    parts += [x[past:a], mark]
                past = max(past, b)
            out.append("".join(parts) + x[past:] if found else x)
        return out

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series(clean(texts.tolist()), dtype=object)

    # Every column travels in one struct beside the new text, so that no name can clash.
    both = docs.select(F.struct(*docs.columns).alias("row"), cleaned(F.col(text)).alias("clean"))
    old = F.col("row").getField(text)

    def column(c: str):
        if c == text:
            return F.col("clean").alias(c)
        if c == "n_chars":
            return F.when(F.col("clean").eqNullSafe(old), F.col("row.n_chars")).otherwise(F.length("clean")).cast(docs.schema[c].dataType).alias(c)
        return F.col("row").getField(c).alias(c)

    return both.select(*map(column, docs.columns))
