import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = ("events", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(cols, data):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols)]) for r in data)


@pytest.mark.parametrize("name", [k for k, (_, sql) in REGISTRY.items() if sql])
def test_twins(spark, duck, name):
    query, sql = REGISTRY[name]
    got = query(spark, SF)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    cols = sorted(names)
    assert rows(cols, [r.asDict() for r in got.collect()]) == rows(cols, [dict(zip(names, r)) for r in cur.fetchall()])


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["timestamp", "entity", "type"] and out.count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_removable_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tidemark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tidemark.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    again = importlib.reload(entry)
    assert set(again.queries()) == set(REGISTRY)
    monkeypatch.undo()
    importlib.reload(entry)
