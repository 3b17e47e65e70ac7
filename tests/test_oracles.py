"""Registered queries against their SQL, on the smallest tables."""

import math
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry

SF = DATA / "sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v) if not isinstance(v, datetime) else v.isoformat()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, views, name):
    df = entry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    result = views.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    want = [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[c]) for c in columns] for r in want)


def test_every_query_has_rows(spark):
    assert entry.entry(spark).count() > 0
    missing = set(entry.oracle_sql()) - set(entry.queries())
    assert not missing


def test_no_query_is_lost_to_an_import_error():
    """Where the training-data folders are there, so are all their queries."""
    folder = Path(entry.__file__).parent
    found = {n.split("_")[0] for n in entry.queries()}
    if (folder / "barloom" / "llm").is_dir():
        assert {f"op{i}" for i in range(1, 14)} <= found
    if (folder / "corpus_pipeline.py").is_file() and (folder / "barloom" / "llm").is_dir():
        assert "pipeline" in found
