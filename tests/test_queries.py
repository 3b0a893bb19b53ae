"""Every query on the driver's tables, the smallest ones, against its SQL."""

import math
import os
import random
from pathlib import Path

import duckdb
import pytest

from lodework.plans.queries import ORACLES, QUERIES

#: Queries that SQL can't express, and the tests that hold their operators against brute force.
BRUTE = {"q23_cover": "test_operators.test_cover", "q38_scc_whole": "test_whole_graph", "q39_cycle_whole": "test_whole_graph"}
TABLES = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, TABLES)
    columns = sorted(out.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in out.collect()], key=str)
    if name in ORACLES:
        con = duckdb.connect()
        for p in Path(TABLES).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        found = con.sql(ORACLES[name])
        at = [found.columns.index(c) for c in columns]
        assert sorted(found.columns) == columns
        want = sorted([tuple(plain(r[i]) for i in at) for r in found.fetchall()], key=str)
        assert got == want
    else:
        assert name in BRUTE


def test_whole_graph(spark, tmp_path):
    """Strong components and shortest cycles of all next-line edges, by brute force; no line was returned, so the others have no edge."""
    r = random.Random(2)
    lines = [(o, n, r.randrange(1, 14)) for o in range(16) for n in range(1, r.randint(3, 5))]
    spark.createDataFrame([(*x, "A", "F") for x in lines], "l_orderkey long, l_linenumber long, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    at = {(o, n): p for o, n, p in lines}
    edges = {(p, at[o, n + 1]) for (o, n), p in at.items() if (o, n + 1) in at and at[o, n + 1] != p}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    scc = {a: min(b for x, b in reach if x == a and (b, a) in reach) for a, b in reach if (b, a) in reach and a != b}
    assert scc and QUERIES["q13_scc"](spark, str(tmp_path)).count() == 0
    assert {(x.id, x.component) for x in QUERIES["q38_scc_whole"](spark, str(tmp_path)).collect()} == set(scc.items())
    got = {x.component: (x.path, x.others) for x in QUERIES["q39_cycle_whole"](spark, str(tmp_path)).collect()}
    want = {}
    for c in set(scc.values()):
        members, layer, closed = sorted(k for k, v in scc.items() if v == c), [[c]], []
        while not closed:
            closed = sorted(p for p in layer if len(p) > 1 and (p[-1], c) in edges)
            layer = [[*p, b] for p in layer for a, b in edges if a == p[-1] and b in members and b not in p]
        want[c] = (",".join(map(str, closed[0])), ",".join(str(m) for m in members if m not in closed[0]))
    assert got == want
