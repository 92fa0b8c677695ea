"""Registered queries against their SQL on the smallest tables; ALL_QUERIES=1 runs every one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
FEW = ("src_repo_url", "prj_context", "scn_findings", "ext_calls", "agg_repo", "jn_file_call", "pay_key", "str_scan", "ev_by_group")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FEW
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


def test_every_query_has_sql():
    from registry.oracle import ORACLE
    from registry.queries import QUERIES
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_data_queries_are_optional(monkeypatch):
    import builtins
    from registry.queries import QUERIES
    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(name=name)
        return real(name, *args, **kwargs)
    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(entry.queries()) == set(QUERIES) == set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "chain_location" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert check.compare(df.columns, [tuple(r) for r in df.collect()], columns, cursor.fetchall()) is None
    assert check.type_difference(df.dtypes, cursor.description) is None
