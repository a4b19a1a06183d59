"""Every query of the package against its SQL on the smallest tables, and what the registry promises."""

import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as driver_entry
from keelson.plans import QUERIES, SQL

DATA = os.environ.get("KEELSON_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "is_finite"):
        return f"{float(value):.9g}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found == rows(want.columns, want.fetchall())
    assert found or name == "j12_expected_against_returned"


@pytest.mark.parametrize("missing", ["keelson.llm.entries", "public_tokenizers"])
def test_entry_points_work_without_the_corpus_subpackage(spark, monkeypatch, missing):
    """Without the subpackage, and where something that it needs is missing."""
    for name in [m for m in sys.modules if m.startswith(("keelson.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(driver_entry.queries()) == set(QUERIES) and set(driver_entry.oracle_sql()) == set(SQL)
    assert driver_entry.entry(spark).columns == ["path", "kind", "old_type", "new_type"]
