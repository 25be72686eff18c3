"""The subpackage's queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, bpe, covertree, licenses, merkle, mixing, pitman_yor, quality, rules, secrets, sharding, simhash, toxicity
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dups(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path of their own; source, language and id stand for one, so that no name tells a licence file, only a whole licence's text.

    Where one document of a source and language is such a text, the others inherit it. The test tables hold none, so that nothing inherits there.
    """
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.license_scan(table(spark, sf_dir, "documents"), path)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(table(spark, sf_dir, "documents"))


def op10_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_dups(table(spark, sf_dir, "embeddings"))


def op11_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales")).drop("click_at")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_secrets, op3_bpe, op4_simhash, op5_sharding, op6_rules, op7_licenses, op8_mixing, op9_pitman_yor, op10_covertree, op11_attribution, op12_toxicity, op13_merkle)
}

#: DuckDB has no crc32: the table of its 256 bytes, and the sum over a number's digits.
CRC_BYTES = "crc_bytes AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) crc_t)"


def crc_sql(column: str) -> str:
    """crc32 of a number's decimal text, where the table of CRC_BYTES is at hand."""
    text = f"({column})::VARCHAR"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k::INT, 1))::BIGINT)), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295)"


def merkle_sql(deep: int = 9, langs: int = 4) -> str:
    """The manifest by plain joins, a statement for each level: up to 8 ** deep rows of a lang and 8 ** langs langs."""
    framed = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(framed, merkle.FIELDS[:-1]))
    low = f"translate(text, '{merkle.CAPITALS}', '{merkle.CAPITALS.lower()}')"
    parents = lambda new, old: f"{new} AS (SELECT g, pos, n, p, sha256(p) h FROM (SELECT g, pos >> 3 pos, (any_value(n) + 7) >> 3 n, string_agg(h, '' ORDER BY pos) p FROM {old} WHERE n > 1 GROUP BY g, pos >> 3))"
    with_ = [
        CRC_BYTES,
        f"d AS (SELECT doc_id, lang g, sha256({head} || {framed('text')}) h, CASE WHEN {crc_sql('doc_id')} % 3 = 0 THEN sha256({head} || {framed(low)}) END bad FROM documents, crc_bytes)",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 pos, count(*) OVER (PARTITION BY g) n FROM d)",
        *(parents(f"l{k}", f"l{k - 1}") for k in range(1, deep + 1)),
        "u0 AS (SELECT 0 g, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 pos, count(*) OVER () n FROM (" + " UNION ALL ".join(f"SELECT g lang, h FROM l{k} WHERE n = 1" for k in range(deep + 1)) + "))",
        *(parents(f"u{k}", f"u{k - 1}") for k in range(1, langs + 1)),
        "top AS (" + " UNION ALL ".join(f"SELECT h root FROM u{k} WHERE n = 1" for k in range(langs + 1)) + ")",
        "x0 AS (SELECT l0.*, u0.h subroot, u0.pos top_pos, root, '' proof, coalesce(bad, l0.h) f FROM l0 JOIN u0 ON l0.g IS NOT DISTINCT FROM u0.lang, top)",
    ]
    steps = [(f"l{k}", "x.g IS NOT DISTINCT FROM y.g", "x.pos", k - 1) for k in range(1, deep + 1)] + [(f"u{k}", "true", "x.top_pos", k - 1) for k in range(1, langs + 1)]
    for i, (level, same, at, k) in enumerate(steps):
        cut = f"(({at} >> {3 * k}) % 8) * 64"
        parts = f"substr(y.p, 1, {cut})", f"substr(y.p, {cut} + 65)"
        with_.append(f"x{i + 1} AS (SELECT x.* EXCLUDE (proof, f), CASE WHEN y.p IS NULL THEN proof ELSE proof || {parts[0]} || {parts[1]} END proof, CASE WHEN y.p IS NULL THEN f ELSE sha256({parts[0]} || f || {parts[1]}) END f FROM x{i} x LEFT JOIN {level} y ON {same} AND {at} >> {3 * (k + 1)} = y.pos)")
    return "WITH " + ",\n".join(with_) + f"\nSELECT doc_id, h leaf, subroot, root, sha256(proof) proof_sha256, f folded_root, f = root verified FROM x{len(steps)}"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE_SQL: dict[str, str] = {
    # Without a stream: a sale closes in the first later batch whose mark has passed it, and counts the clicks taken by then.
    "op11_attribution": f"""
WITH {CRC_BYTES},
c AS (SELECT click_id id, client_id client, epoch_us(ts) t, epoch_us(arrived_at) // 3600000000 + CASE WHEN {crc_sql('click_id')} % 4 = 0 THEN 240 ELSE 0 END h FROM (SELECT DISTINCT ON (click_id) * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL ORDER BY click_id, ts, client_id, arrived_at), crc_bytes),
s AS (SELECT sale_id id, client_id client, epoch_us(sold_at) t, epoch_us(arrived_at) // 3600000000 + CASE WHEN {crc_sql('sale_id')} % 4 = 0 THEN 240 ELSE 0 END h FROM sales, crc_bytes WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
e AS (SELECT min(h) lo, max(h) hi FROM c),
cb AS (SELECT c.*, (12 * (h - lo)) // (hi - lo + 1) b FROM c, e),
sb AS (SELECT s.*, CASE WHEN h < lo THEN 0 ELSE least(11, (12 * (h - lo)) // (hi - lo + 1)) END b FROM s, e),
w AS (SELECT b, least(max(ct) OVER before, max(st) OVER before) - 21600000000 w, max(ct) OVER before mc, max(st) OVER before ms FROM (SELECT range b, (SELECT max(t) FROM cb WHERE cb.b = range) ct, (SELECT max(t) FROM sb WHERE sb.b = range) st FROM range(13)) WINDOW before AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT b, CASE WHEN mc IS NOT NULL AND ms IS NOT NULL THEN w END w FROM w),
k AS (SELECT cb.* FROM cb JOIN m USING (b) WHERE m.w IS NULL OR cb.t >= m.w),
sl AS (SELECT row_number() OVER () r, sb.*, coalesce(sb.t < m.w, false) late, coalesce((SELECT min(m2.b) FROM m m2 WHERE m2.b > sb.b AND m2.b < 12 AND m2.w > sb.t), 12) closing FROM sb JOIN m USING (b)),
j AS (SELECT sl.r, k.id, k.t FROM sl JOIN k ON k.client = sl.client AND k.t BETWEEN sl.t - 604800000000 AND sl.t AND k.b <= sl.closing WHERE NOT sl.late),
f AS (SELECT r, count(*) n, arg_min(id, (-t, id)) click_id FROM j GROUP BY r)
SELECT sl.id sale_id, CASE WHEN late THEN sl.b ELSE closing END::INTEGER batch, late, f.click_id, coalesce(f.n, 0)::BIGINT n_clicks FROM sl LEFT JOIN f USING (r)""",
    "op13_merkle": merkle_sql(),
    # Without the operator's prefilter: every line, sentence and whole text is scored.
    "op7_licenses": rf"""
WITH d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) path, text FROM documents),
parts AS (SELECT doc_id, unnest(l) part, generate_subscripts(l, 1) - 1 unit FROM (SELECT doc_id, list_concat(string_split(text, chr(10)), string_split(regexp_replace(regexp_replace(text, '{licenses.SPACE}', ' ', 'g'), '([.;!?]) ', '\1' || chr(10), 'g'), chr(10))) l FROM d)),
units AS (SELECT doc_id, unit, part FROM parts UNION ALL SELECT doc_id, -1, text FROM d),
tf AS (SELECT doc_id, unit, term, ln(count(*)) + 1 tf FROM (SELECT doc_id, unit, unnest(regexp_extract_all(lower(part), '{licenses.TERM}')) term FROM units) WHERE term NOT IN {licenses.STOP} GROUP BY ALL),
tpl(t, name, file, part) AS (VALUES {", ".join(f"({k}, {quoted(a)}, {k >= len(licenses.TEMPLATES)}, {quoted(b)})" for k, (a, b) in enumerate((*licenses.TEMPLATES, *licenses.FILES)))}),
st AS (SELECT t, name, file, term, ln(count(*)) + 1 tf FROM (SELECT t, name, file, unnest(regexp_extract_all(lower(part), '{licenses.TERM}')) term FROM tpl) WHERE term NOT IN {licenses.STOP} GROUP BY ALL),
n AS (SELECT count(*) n FROM tpl),
df AS (SELECT term, count(*) df FROM st GROUP BY 1),
w AS (SELECT t, name, file, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) w FROM st JOIN df USING (term), n),
wn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY t)) u FROM w),
v AS (SELECT doc_id, unit, term, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1) v FROM tf LEFT JOIN df USING (term), n),
nv AS (SELECT doc_id, unit, sqrt(sum(v * v)) norm FROM v GROUP BY ALL),
sc AS (SELECT v.doc_id, v.unit, t, name, round(sum(v * u) / any_value(norm), 9) score FROM v JOIN wn ON wn.term = v.term AND wn.file = (v.unit < 0) JOIN nv ON nv.doc_id = v.doc_id AND nv.unit = v.unit GROUP BY ALL),
b AS (SELECT doc_id, unit < 0 is_file, score, name FROM sc WHERE score >= CASE WHEN unit < 0 THEN 0.8 ELSE 0.6 END QUALIFY row_number() OVER (PARTITION BY doc_id, unit < 0 ORDER BY score DESC, name) = 1),
x AS (SELECT d.doc_id, d.path, coalesce(regexp_matches(regexp_extract(d.path, '([^/]*)$', 1), '{licenses.NAMED}'), false) called, h.name hn, h.score hs, f.name fn, f.score fs FROM d LEFT JOIN b h ON h.doc_id = d.doc_id AND NOT h.is_file LEFT JOIN b f ON f.doc_id = d.doc_id AND f.is_file),
own AS (SELECT doc_id, path, coalesce(fn, hn) own_license, coalesce(fs, hs) own_score, coalesce(fn, CASE WHEN called THEN hn END) file_license, coalesce(fs, CASE WHEN called THEN hs END) file_score FROM x),
dirs AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) dir, file_license FROM own WHERE file_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY file_score DESC, file_license, path) = 1),
near AS (SELECT o.doc_id, dirs.dir, dirs.file_license lic FROM own o JOIN dirs ON starts_with(o.path, dirs.dir || '/') WHERE o.own_license IS NULL QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(dirs.dir) DESC) = 1)
SELECT o.doc_id, o.path, o.own_license, round(o.own_score, 6) own_score, o.file_license, near.lic inherited_license, near.dir inherited_from, coalesce(o.own_license, near.lic) license FROM own o LEFT JOIN near USING (doc_id)""",
    "op8_mixing": r"""
WITH w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 4))::INT bucket FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE wt FROM w GROUP BY 1),
o AS (SELECT *, 3.0 * source_size cap, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0 * source_size) OVER before, 0) open, sum(wt) OVER () - coalesce(sum(wt) OVER before, 0) rest FROM s
 WINDOW before AS (ORDER BY 3.0 * source_size / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / wt <= open / rest full_ FROM o),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE greatest(0, least(cap, wt * coalesce((SELECT open / rest FROM f WHERE NOT full_ ORDER BY cap / wt, source NULLS LAST LIMIT 1), 0))) END::DOUBLE target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size + 1e-12)) ELSE 0 END::BIGINT whole FROM t),
m AS (SELECT *, greatest(0, target - whole * source_size) more FROM g),
u AS (SELECT source, bucket, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) upto FROM w GROUP BY 1, 2),
c AS (SELECT m.source, u.bucket cut FROM m JOIN u ON u.source IS NOT DISTINCT FROM m.source WHERE abs(upto - more) < more QUALIFY row_number() OVER (PARTITION BY m.source ORDER BY abs(upto - more), u.bucket) = 1)
SELECT w.doc_id, w.size, m.source_size, round(m.target, 6) target, CASE WHEN w.size > 0 THEN w.size * (m.whole + (m.whole < 3 AND w.bucket <= coalesce(c.cut, -1))::BIGINT) ELSE 0 END::BIGINT taken
FROM w JOIN m ON m.source IS NOT DISTINCT FROM w.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM m.source""",
    "op10_covertree": """
WITH RECURSIVE x AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
ok AS (SELECT * FROM x WHERE e IS NOT NULL AND len(list_filter(e, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_sum(list_transform(e, lambda v: v * v)) > 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id, vec_id root FROM x UNION SELECT l.a, c.root FROM c JOIN l ON l.b = c.vec_id),
n AS (SELECT a vec_id, count(*) n FROM l GROUP BY 1)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT n_links, min(root) component_id, vec_id = min(root) kept FROM c LEFT JOIN n USING (vec_id) GROUP BY vec_id""",
}
