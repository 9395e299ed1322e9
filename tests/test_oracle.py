"""Every registered query against its DuckDB SQL (sf0.001 by default; set
CHURNLENS_ORACLE_SF to another driver folder, e.g. /root/testdata/sf0.01)."""

import os

import pytest

from compare_oracle import TYPE_MAP, duck, key, norm

SF = os.environ.get("CHURNLENS_ORACLE_SF", "/root/testdata/sf0.001")

import __spark_entry__ as E  # noqa: E402

from churnlens.plans.registry import QUERIES  # noqa: E402

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SF):
        pytest.skip("driver tables not present")
    return duck(SF)


def test_every_query_has_oracle_sql():
    assert set(E.oracle_sql()) >= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = con.sql(E.oracle_sql()[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: TYPE_MAP.get(t, t.upper()) for c, t in df.dtypes} == duck_types
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in cur.fetchall()), key=key)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["signup_month", "is_rejoin", "num_signup", "num_invol", "invol_rate"]
    assert df.count() >= 0
