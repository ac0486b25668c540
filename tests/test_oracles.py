"""A few registered queries of every area against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

SF = "/root/testdata/sf0.001"
NAMES = ["flt_narrow", "histogram", "max_window", "merge_objects", "memberships", "det_chains", "diff_objects", "packet_flows", "policy_flows", "decode_syslog",
         "secret_assignments", "vuln_exact", "vuln_constraint", "dep_graph", "surf_dangling", "surface_owner", "surf_scope", "trace_walk", "st_dedup", "policy_ports", "policy_diff", "observed_path", "bundle_closure",
         "scope_domain"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert cols == sorted(names)
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
