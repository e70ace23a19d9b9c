import importlib
import sys

import pytest


@pytest.fixture
def entry():
    sys.modules.pop("__spark_entry__", None)
    yield importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)


def test_each_oracle_has_its_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "fact_history" in entry.oracle_sql()


def test_the_engine_stands_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("factlake.llm")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "factlake.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    from factlake.queries import ORACLES, QUERIES

    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    assert not any(m.startswith("factlake.llm.") for m in sys.modules)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_the_engine_stands_where_a_library_of_the_corpus_operators_lacks(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("factlake.llm")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    entry = importlib.import_module("__spark_entry__")
    from factlake.queries import QUERIES

    assert set(entry.queries()) == set(QUERIES)
    for name in [m for m in sys.modules if m.startswith("factlake.llm")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)


def test_entry_gives_rows_with_a_stable_schema(spark, entry):
    found = entry.entry(spark)
    assert found.dtypes == [("value", "string"), ("count", "bigint")] and found.count() > 0


def test_registered_queries_match_their_sql(spark, entry):
    """A few of them here; the driver compares all."""
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("events", "orders", "customer", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("push_outcomes", "fact_history", "groupby_at_t", "filter_include_inactive", "node_lifecycle", "apply_stats"):
        mine = entry.queries()[name](spark, sf_dir)
        columns = sorted(mine.columns)
        theirs = db.sql(entry.oracle_sql()[name])
        assert columns == sorted(theirs.columns)
        rows = lambda r, names: sorted(map(repr, (tuple(row[names.index(c)] for c in columns) for row in r)))
        assert rows([tuple(x) for x in mine.collect()], mine.columns) == rows(theirs.fetchall(), theirs.columns), name
