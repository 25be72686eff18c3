"""The subpackage's queries against their SQL: on the test tables, on edge rows and on vectors that do link."""

import duckdb
import numpy as np
import pytest

from scenespark.llm import licenses
from scenespark.llm.registry import ORACLE_SQL, QUERIES

from ..conftest import DATA
from .edges import TEXTS, documents


def same(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", *(("clicks", "sales") if sf_dir.startswith(DATA) else ())):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet{'' if sf_dir.startswith(DATA) else '/*.parquet'}')")
    plain = lambda rows: sorted(str(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r)) for r in rows)
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = got.select(*cols).collect()
    assert plain(rows) == plain(con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall())
    return rows


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    """Edge documents, and vectors in clusters whose cosines lie on both sides of 0.9.

    DuckDB's cosine refuses null components, which brute force tests instead.
    """
    path = str(tmp_path_factory.mktemp("edges"))
    # a directory (source and language) with a whole licence's text, whose other documents inherit it
    documents(spark, [*TEXTS, (20, licenses.FILES[0][1], "en", "a")]).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(25, 16))
    rows = [(k, (centres[k % 25] + rng.normal(size=16) * rng.choice([0.02, 0.25, 0.4])).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(40)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [float("inf")] + [1.0] * 15)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, f"{DATA}/sf0.001", name)


def test_manifest_of_edges_equals_sql(spark, edge_dir):
    same(spark, edge_dir, "op13_merkle")


def test_inherited_licences_equal_sql(spark, edge_dir):
    rows = same(spark, edge_dir, "op7_licenses")
    assert {r["doc_id"] for r in rows if r["inherited_license"]} >= {1, 4, 8} and {r["inherited_from"] for r in rows if r["inherited_license"]} == {"a/en"}


def test_mixing_of_edges_equals_sql(spark, edge_dir):
    same(spark, edge_dir, "op8_mixing")


def test_linked_vectors_equal_sql(spark, edge_dir):
    rows = same(spark, edge_dir, "op10_covertree")
    links, kept = sum(r["n_links"] for r in rows), sum(r["kept"] for r in rows)
    assert links > 400 and 25 < kept < 300
