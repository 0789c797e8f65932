import os

import duckdb
import pytest

from bytelake.plans import bytecode, expected


def rows(columns, values):
    return sorted(repr(tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in row)) for row in values), columns


@pytest.mark.parametrize("name", expected.SQL)
def test_equals_the_listing(spark, name):
    """Every query against SQL over a disassembler's listing of the same archives."""
    df = bytecode.QUERIES[name](spark, "/nowhere")
    columns = sorted(df.columns)
    mine = rows(columns, df.select(*columns).collect())
    found = duckdb.sql(expected.oracle_sql()[name])
    assert mine == rows(sorted(found.columns), found.select(*sorted(found.columns)).fetchall())


def test_queries_read_something(spark):
    empty = {n for n, q in bytecode.QUERIES.items() if n not in expected.SQL and q(spark, "/nowhere").isEmpty()}
    assert not empty and not os.path.exists("/nowhere")
    none = {n for n, sql in expected.oracle_sql().items() if not duckdb.sql(sql).limit(1).fetchall()}
    assert none == {"bc_s16_diagnostics", "bc_a4_diagnostics", "bc_w7_dead_runs", "bc_w9_after_return"}  # nothing in sound archives


def test_absent_archives_fail(monkeypatch):
    monkeypatch.setattr(bytecode, "ARCHIVES", ("no-such.jar",))
    with pytest.raises(FileNotFoundError, match="no-such.jar"):
        bytecode.jars_folder()
