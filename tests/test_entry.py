import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from caselens.plans import catalogue, oracles

ROOT = Path(__file__).parents[1]
DATA = "/root/testdata/sf0.001"
SOME = ("case_context", "rule_response", "rule_precedence", "reassignment_loops", "negspace_telemetry", "investigation_uniformity", "suppressed", "trend_classification", "ols_effect", "cusum_daily", "baseline_stratified", "rule_book", "ols_adjusted", "drift_events", "page_by_key", "indexed_search")


def test_names():
    assert set(oracles.SQL) <= set(catalogue.QUERIES) <= set(entry.queries())
    assert len(catalogue.QUERIES) >= 50 and len(oracles.SQL) >= 40


def test_nothing_outside_imports_the_corpus_folder():
    for path in (ROOT / "caselens").rglob("*.py"):
        if "llm" not in path.parts:
            nodes = list(ast.walk(ast.parse(path.read_text())))
            names = [n.module or "" for n in nodes if isinstance(n, ast.ImportFrom)] + [a.name for n in nodes if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names]
            assert not any("llm" in n for n in names), path


def plain(rows):
    fine = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(str(tuple(fine(r[k]) for k in sorted(r))) for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(oracles.SQL[name])
    names = [c[0] for c in want.description]
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert plain(want) == plain(r.asDict() for r in catalogue.QUERIES[name](spark, DATA).collect())
