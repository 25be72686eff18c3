"""Every query of the library against its SQL counterpart, and the entry module's contract."""

import ast
import os

import duckdb
import pytest

import __spark_entry__ as entry
from scenespark.cli import build_parser, config_of, main
from scenespark.operators.captions import call_models, caption, compare_models, prompts
from scenespark.plans.queries import ORACLE_SQL, QUERIES

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(str(tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert plain(got.select(*cols).collect()) == plain(want)


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_nothing_else_imports_the_optional_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{root}/scenespark"):
        for n in names:
            if n.endswith(".py") and not folder.startswith(f"{root}/scenespark/llm"):
                with open(f"{folder}/{n}") as f:
                    for node in ast.walk(ast.parse(f.read())):
                        named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                        assert not any("llm" in x or "corpus_pipeline" in x for x in named)


def test_cli(capsys):
    assert main(["list-embedders"]) == 0 and "phash" in capsys.readouterr().out
    args = build_parser().parse_args(["run", "video", "--sim-threshold", "0.5", "--no-ema", "--min-picks", "2"])
    cfg = config_of(args)
    assert (cfg.segmenter.sim_threshold, cfg.segmenter.use_ema, cfg.selector.min_picks, cfg.sampler.interval_sec) == (0.5, False, 2, 1.0)
    with pytest.raises(SystemExit):
        build_parser().parse_args([])


def test_fallbacks():
    def model(name, prompt):
        if name == "a":
            raise RuntimeError("error 403")
        if name == "b":
            raise RuntimeError("out of memory")
        return f"{name}:{prompt}"

    assert call_models("p", ["a", "c"], model) == ("c:p", "c", "")
    assert call_models("p", ["a", "b", "c"], model) == ("", "b", "out of memory")
    assert call_models("p", ["a"], model) == ("", "a", "error 403")


def test_captions(spark):
    from scenespark.plans.queries import keyed

    p = prompts(keyed(spark, SF)[1])
    out = caption(p, lambda name, prompt: f"{name} saw {prompt.count('FRAME')}").collect()
    assert all(r["text"] == f"default saw {r['frames_sent']}" and r["error"] == "" for r in out)
    assert {r["text"] for r in caption(p, None).collect()} == {"(captioning disabled)"}
    both = compare_models(p, ["x", "y"], lambda name, prompt: "ok" if name == "x" else 1 / 0)
    assert {(r["model"], r["text"], bool(r["error"])) for r in both.collect()} == {("x", "ok", False), ("y", "", True)}
