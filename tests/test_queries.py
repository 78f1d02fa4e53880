"""Every registered query of the engine against its SQL on the smallest tables, and the rules of the package."""

import ast
import os
from pathlib import Path

import duckdb
import pytest

from wayline import queries as q

SMALL = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    def plain(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = q.queries()[name](spark, SMALL)
    want = duck.execute(q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_package_rules():
    root = Path(q.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        names = {n.name for node in ast.walk(ast.parse(path.read_text())) if isinstance(node, ast.Import) for n in node.names} | {node.module or "" for node in ast.walk(ast.parse(path.read_text())) if isinstance(node, ast.ImportFrom)}
        assert not [n for n in names if n.split(".")[0] in ("matplotlib", "plotly", "dash") or "llm" in n.split(".")], path


@pytest.mark.parametrize("name", ["complete_flags_total", "complete_flags_max", "corridor_total", "corridor_speed", "segment_delay", "freeflow_percentile", "nearest_line_join", "segment_geometry", "weighted_by_time", "coverage_cost", "compare_raw_day"])
def test_plans_run_no_job(spark, name, monkeypatch):
    """Building an operator's plan computes nothing, once the files' schemas are known."""
    tables = {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("events", "customer", "supplier", "nation")}
    monkeypatch.setattr(q, "table", lambda session, folder, t: tables[t])
    context, group = spark.sparkContext, f"plan-{name}"
    context.setJobGroup(group, name)
    q.queries()[name](spark, SMALL)
    jobs = context.statusTracker().getJobIdsForGroup(group)
    context._jsc.clearJobGroup()
    assert not list(jobs)
