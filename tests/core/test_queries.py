"""Every registered query of the location operators against its SQL, at a small scale."""

import math

import duckdb
import pytest

from terraloom import queries_assessed, queries_data, queries_forms, queries_more, queries_sources, queries_sweeps  # noqa: F401
from terraloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda x: round(float(x), 5) + 0.0 if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted([tuple(value(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(rows, got.columns), plain(want.fetchall(), want.columns)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(math.isclose(p, q, rel_tol=1e-5, abs_tol=2e-5) if isinstance(p, float) and isinstance(q, float) else p == q for p, q in zip(x, y, strict=True)), (x, y)


def test_the_rest_works_without_the_text_operators():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in root.glob("terraloom/**/*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, ast.Import | ast.ImportFrom):
                    assert "llm" not in (getattr(node, "module", "") or "") and not any("llm" in a.name for a in node.names)
