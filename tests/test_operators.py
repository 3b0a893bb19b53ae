"""Operators against brute force on small random inputs, and hand cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodework.functions import scalars
from lodework.functions.tables import Scratch
from lodework.operators import checks, churn, findings, graph, repeats, symbols


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def random_edges(seed, nodes=12, n=22):
    r = random.Random(seed)
    return sorted({(r.randrange(nodes), r.randrange(nodes)) for _ in range(n)})


def brute_closure(edges):
    known = set(edges)
    while True:
        more = {(a, d) for a, b in known for c, d in edges if b == c} - known
        if not more:
            return known
        known |= more


@pytest.fixture(params=("one task", "rounds"))
def rounds(request, monkeypatch):
    """Small graphs are solved in one task; the rounds for large ones must give the same."""
    if request.param == "rounds":
        monkeypatch.setattr(graph, "LOCAL_EDGES", 3)


@pytest.mark.parametrize("seed", range(2))
def test_closure_reach_components(spark, scratch, seed, rounds):
    edges = random_edges(seed)
    e = spark.createDataFrame(edges, "src long, dst long")
    want = brute_closure(edges)
    assert set(map(tuple, graph.closure(e, scratch).collect())) == want
    assert {r[0] for r in graph.reach(e, spark.createDataFrame([(0,)], "id long"), scratch).collect()} == {0} | {b for a, b in want if a == 0}
    scc = {a: min([a, *(b for x, b in want if x == a and (b, a) in want)]) for a, b in want if a != b and (b, a) in want}
    got = dict(map(tuple, graph.strong_components(e, scratch).collect()))
    assert got == scc
    paths = {r.component: (r.path, r.others) for r in graph.shortest_cycles(e, spark.createDataFrame(list(got.items()) or [(0, 0)], "id long, component long").filter("id is not null") if got else graph.strong_components(e, scratch), scratch).collect()}
    for c in set(scc.values()):
        members = sorted(k for k, v in scc.items() if v == c)
        layer, best = [[c]], None
        while best is None:
            closed = sorted(p for p in layer if len(p) > 1 and (p[-1], c) in edges)
            best = closed[0] if closed else None
            layer = [[*p, b] for p in layer for a, b in edges if a == p[-1] and b in members and b not in p]
        assert paths[c] == (best, [m for m in members if m not in best])
    linked = dict(map(tuple, graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch).collect()))
    both = brute_closure([*edges, *((b, a) for a, b in edges)])
    assert all(linked[a] == min([a, *(y for x, y in both if x == a)]) for a in linked)


@pytest.mark.parametrize("seed", range(2))
def test_gated_reach(spark, scratch, seed, rounds):
    r = random.Random(seed)
    nodes = [(f"t{i}", None, None, False, False, i == 0) for i in range(5)]
    nodes += [(f"m{i}", f"t{r.randrange(5)}", f"n{r.randrange(6)}", True, r.random() < 0.15, False) for i in range(18)]
    ids = [n[0] for n in nodes]
    edges = [(r.choice(ids), r.choice(ids)) for _ in range(8)]
    uses = [(r.choice(ids), f"n{r.randrange(6)}") for _ in range(14)]
    children = [(n[1], n[0]) for n in nodes if n[1] and r.random() < 0.1]
    live = {n[0] for n in nodes if n[5]}
    while True:
        names = {n for s, n in uses if s in live}
        more = {d for s, d in edges if s in live} | {n[1] for n in nodes if n[0] in live and n[1]} | {c for p, c in children if p in live}
        more |= {n[0] for n in nodes if n[3] and n[2] in names and (n[4] or n[1] in live)}
        if more <= live:
            break
        live |= more
    got = graph.gated_reach(
        spark.createDataFrame(nodes, "id string, parent string, name string, is_member boolean, ungated boolean, root boolean"), spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame(uses, "src string, name string"), spark.createDataFrame(children, "parent string, child string"), scratch,
    )
    assert {x.id for x in got.collect()} == live


def brute_repeats(seqs, k, least):
    """Longest common extension of all sets of equal runs: by definition, over every run."""
    runs = {}
    for s, x in enumerate(seqs):
        for i in range(len(x)):
            for n in range(k, len(x) - i + 1):
                runs.setdefault(tuple(x[i : i + n]), []).append((s, i))
    out = set()
    for run, places in runs.items():
        if len(places) < least:
            continue
        right = {seqs[s][p + len(run)] if p + len(run) < len(seqs[s]) else ("end", s, p) for s, p in places}
        left = {seqs[s][p - 1] if p else ("begin", s) for s, p in places}
        if len(right) > 1 and len(left) > 1:
            out.add((len(run), tuple(sorted(places))))
    return out


def test_maximal_repeats(spark, scratch):
    r = random.Random(5)
    for _ in range(2):
        seqs = [[r.choice("abc") for _ in range(r.randint(3, 25))] for _ in range(4)]
        rows = [(s, p, 1, t) for s, x in enumerate(seqs) for p, t in enumerate(x)]
        t = spark.createDataFrame(rows, "id int, pos int, line int, token string")
        got = {(x.length, tuple((o.id, o.pos) for o in x.occurrences)) for x in repeats.maximal_repeats(repeats.token_sequences(t, "id"), "id", 3, scratch).collect()}
        assert got == brute_repeats(seqs, 3, 2)


def pipeline(spark, scratch, seqs, k, lines, least=2, token_lines=None):
    rows = [(s, p, token_lines[s][p] if token_lines else p + 1, str(t)) for s, x in enumerate(seqs) for p, t in enumerate(x)]
    t = spark.createDataFrame(rows, "id int, pos int, line int, token string")
    g = repeats.maximal_repeats(repeats.token_sequences(t, "id"), "id", k, scratch, least).withColumn("group", F.xxhash64("length", F.col("occurrences").cast("string")))
    kept = repeats.uncovered(repeats.ranked(repeats.snapped(scratch.save(g), repeats.token_lines(t, "id"), "id", k, lines)), scratch)
    return sorted((x.impact, x.n_tokens, [(o.id, o.pos) for o in x.occurrences]) for x in kept.collect())


def brute_cover(seqs, lines, k, least_lines, least=2):
    """The whole chain by definition: repeats, cut to lines that begin and end in all places, ranked, and kept while something is new."""
    groups = []
    for n, places in brute_repeats(seqs, k, least):
        begins = [o for o in range(n) if all(p + o == 0 or lines[s][p + o - 1] != lines[s][p + o] for s, p in places)]
        ends = [o for o in range(n) if all(p + o + 1 == len(seqs[s]) or lines[s][p + o + 1] != lines[s][p + o] for s, p in places)]
        if not begins or not ends or ends[-1] - begins[0] + 1 < k:
            continue
        lo, m = begins[0], ends[-1] - begins[0] + 1
        if min(lines[s][p + lo + m - 1] - lines[s][p + lo] + 1 for s, p in places) >= least_lines:
            groups.append((m, [(s, p + lo) for s, p in places]))
    taken, kept = set(), []
    for m, places in sorted(groups, key=lambda g: (-g[0] * (len(g[1]) - 1), -g[0], g[1])):
        if any(sum((s, p + j) in taken for j in range(m)) < 0.75 * m for s, p in places):
            kept.append((m * (len(places) - 1), m, places))
            taken |= {(s, p + j) for s, p in places for j in range(m)}
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_cover(spark, scratch, seed):
    r = random.Random(seed)
    seqs, lines = [], []
    for _ in range(4):
        x = [r.choice("pqrs") for _ in range(r.randint(6, 18))]
        seqs.append(x + (seqs[0][2:9] if seqs and r.random() < 0.7 else []))
        lines.append(sorted(r.randint(1, 9) for _ in seqs[-1]))
    k, least_lines = r.choice((2, 3)), r.choice((1, 2))
    assert pipeline(spark, scratch, seqs, k, least_lines, 2, lines) == brute_cover(seqs, lines, k, least_lines)


@pytest.mark.parametrize("seed", range(3))
def test_snapped_repeats(spark, scratch, seed):
    """Cut where they are found, repeats give the same groups as cut afterwards, and the same cover as by definition."""
    r = random.Random(seed)
    seqs, lines = [], []
    for _ in range(5):
        x = [r.choice("pq") for _ in range(r.randint(4, 16))]
        seqs.append(["p"] * 9 + x + (seqs[0][2:13] if seqs and r.random() < 0.7 else []))
        lines.append(sorted(r.randint(1, 9) for _ in seqs[-1]))
    k, least_lines = r.choice((2, 3)), r.choice((1, 2))
    t = spark.createDataFrame([(s, p, lines[s][p], str(x)) for s, seq in enumerate(seqs) for p, x in enumerate(seq)], "id int, pos int, line int, token string")
    tokens, marks = repeats.token_sequences(t, "id"), repeats.token_lines(t, "id")
    whole = scratch.save(repeats.maximal_repeats(tokens, "id", k, scratch).withColumn("group", F.xxhash64("length", F.col("occurrences").cast("string"))))
    found = scratch.save(repeats.snapped_repeats(tokens, marks, "id", k, scratch, 2, k, least_lines))
    columns = ["n_tokens", "n_lines", "occurrences"]
    got = sorted(map(str, found.select(columns).collect()))
    assert got and got == sorted(map(str, repeats.snapped(whole, marks, "id", k, least_lines).select(columns).collect()))
    assert found.select("group").distinct().count() == len(got)
    kept = repeats.uncovered(repeats.ranked(found), scratch).collect()
    assert sorted((x.impact, x.n_tokens, [(o.id, o.pos) for o in x.occurrences]) for x in kept) == brute_cover(seqs, lines, k, least_lines)


def test_a_text_that_repeats_itself(spark, scratch):
    """A task gets a stretch of repeated k-grams once for a k-gram, however often this is found there."""
    n = 1500
    docs = spark.createDataFrame([(i, "a " * n + f"b{i}") for i in range(3)], "id int, text string")
    rows = repeats._families(repeats.text_sequences(docs, "id", "text"), "id", 50, scratch, 2).selectExpr("octet_length(chain) c", "size(start) s").collect()
    assert [(x.c, x.s) for x in rows] == [(8 * (n - 49), n - 49)] * 3
    found = repeats.maximal_repeats(repeats.text_sequences(docs, "id", "text"), "id", 50, scratch).collect()
    assert sorted((x.length, len(x.occurrences)) for x in found) == [(m, 3 * (n - m + 1)) for m in range(50, n + 1)]


def test_suffixes_in_order(monkeypatch):
    """Cut out or ranked, suffixes share the same with their neighbours."""
    r = random.Random(8)
    for _ in range(20):
        chains = [b"".join(r.choice("ab").encode() * 8 for _ in range(r.choice((1, 3, 40)))) for _ in range(r.randint(1, 6))]
        at = [(c, o) for c, x in enumerate(chains) for o in range(len(x) // 8) if r.random() < 0.7] or [(0, 0)]
        of, off = np.array(at, np.int64).T
        texts = [chains[c][8 * o :] for c, o in at]
        for most in (1 << 20, 0):
            monkeypatch.setattr(repeats, "CUT_BYTES", most)
            order, shared = repeats.suffixes_in_order(chains, of, off)
            got = [texts[i] for i in order]
            assert got == sorted(texts)
            assert shared.tolist() == [0] + [next((i for i in range(min(len(x), len(y)) // 8) if x[8 * i] != y[8 * i]), min(len(x), len(y)) // 8) for x, y in zip(got, got[1:])]


def test_lines_and_sequences_of_texts(spark):
    """Texts and tables of their tokens give the same lines, k-grams and repeats."""
    texts = ["a b\n\nc a b c\n a b", None, "", "\n\n", "x a b\n c a b\x0bc a", "é a b\tc\r\na b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tokens = repeats.text_tokens(docs, "id", "text")
    assert sorted(map(str, repeats.token_lines(tokens, "id").collect())) == sorted(str(x) for x in repeats.text_lines(docs, "id", "text").collect() if x["line"])
    found = []
    for s in (repeats.text_sequences(docs, "id", "text"), repeats.token_sequences(tokens, "id")):
        groups = {}
        for x in repeats.kgrams(s, "id", 2).collect():
            groups.setdefault(x.gram, []).append((x.id, x.pos))
        found.append(sorted(map(sorted, groups.values())))
    assert found[0] == found[1] and [(0, 0), (0, 3), (0, 6), (4, 1), (4, 4), (5, 1), (5, 4)] in found[0]


def test_churn_and_hotspots(spark):
    day = 86400
    e = spark.createDataFrame([("a", 400 * day), ("b", 310 * day), ("c", 220 * day), ("d", 500 * day)], "path string, s long")
    got = {r.path: round(r.weight, 4) for r in churn.decayed(e, ["path"], F.col("s"), 400 * day).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 0.25, "d": 1.0}
    rows = spark.createDataFrame([("a/b", 2.0, 5, 10), ("a-b", 2.0, 5, 10), ("c", 0.0, 5, 10), ("d", 1.0, 0, 0), ("e", 1.0, 5, 10)], "path string, weight double, complexity int, lines int")
    hot = churn.top(churn.hotspots(rows, "path", "weight", "complexity", "lines"), 10).collect()
    assert [(h.path, h.score) for h in hot] == [("a/b", 100.0), ("a-b", 100.0), ("e", 50.0)]
    assert churn.hotspots(rows.filter("path = 'c'"), "path", "weight", "complexity", "lines").count() == 0


def test_decayed_stream(spark, tmp_path):
    from lodework.streaming.churn import decayed_stream

    day = 86400
    spark.createDataFrame([("a", 0), ("a", 90 * day)], "path string, s long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = decayed_stream(spark.readStream.schema("path string, s long").parquet(f"{tmp_path}/in"), "path", "s")
    q = stream.writeStream.outputMode("update").format("memory").queryName("decay_test").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.path, r.weight, r["at"]) for r in spark.table("decay_test").collect()] == [("a", 1.5, 90 * day)]


def test_checks(spark):
    d = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 0, 99)], "id int, a int, b int")
    got = sorted((r.id, r.kind, r.severity) for r in checks.tripped(d, ["id"], {"x": (F.col("a"), 10), "y": (F.col("b"), 0)}).collect())
    assert got == [(1, "y", 5.0), (2, "x", 1.1), (2, "y", 5.0), (3, "y", 99.0)]
    assert checks.suffixed(spark.createDataFrame([("f", "m", 1), ("f", "m", 2), ("f", "n", 3)], "f string, n string, k int"), ["f"], "n", F.col("k")).select("n").orderBy("k").collect() == [("m/1",), ("m/2",), ("n",)]


def test_findings(spark):
    lines = [("a", 1, "x(); // lodework:off"), ("a", 5, "// lodework:off-next r1,r2 why"), ("b", 2, '"http://h // lodework:off"'), ("b", 3, "// lodework:off nothing-known"), ("c", 1, "// lodework:offx")]
    marks = findings.markers(spark.createDataFrame(lines, "file string, line int, content string"), rules=["r1", "r2"])
    assert sorted(map(str, ((m.file, m.line, m.rule) for m in marks.collect()))) == sorted(map(str, [("a", 1, None), ("a", 6, "r1"), ("a", 6, "r2")]))
    assert [(m.file, m.line, m.rule) for m in findings.unknown_rules(spark.createDataFrame(lines, "file string, line int, content string"), ["r1", "r2"]).collect()] == [("b", 3, "nothing-known")]
    f = spark.createDataFrame([("a", 1, "r3"), ("a", 6, "r1"), ("a", 6, "r3"), ("a", 9, "large-file"), ("b", 3, "r1")], "file string, line int, kind string")
    assert sorted(map(tuple, findings.unmarked(f, marks).collect())) == [("a", 6, "r3"), ("b", 3, "r1")]
    now = spark.createDataFrame([("k", "a", 5), ("k", "a", 9), ("k", "b", 1)], "kind string, name string, metric int")
    old = spark.createDataFrame([("k", "a", 7), ("k", "a", 4), ("k", "z", 1)], "kind string, name string, metric int")
    assert sorted(map(tuple, findings.over_baseline(now, old).collect())) == [("k", "a", 9), ("k", "b", 1)]
    assert [tuple(x) for x in findings.stale_records(old, now).collect()] == [("k", "z", 1)]


def test_globs_and_rounding(spark):
    cases = {"src/**": "src/a/b.cs", "*.cs": "a/b.cs", "gen/": "gen/x/y", "**/x.cs": "x.cs", "a?c": "abc", "{a,b}.cs": "b.cs", "[!a]b": "cb"}
    d = spark.createDataFrame(list(cases.items()), "g string, p string")
    for g, p in cases.items():
        assert d.filter(F.col("g") == g).select(scalars.any_glob(F.col("p"), [g]).alias("m")).first().m, (g, p)
    assert scalars.glob_regex("../x") is None
    v = spark.createDataFrame([(1.005, 2.5, -2.5)], "a double, b double, c double").select(scalars.rounded(F.col("a"), 2), scalars.rounded(F.col("b"), 0), scalars.rounded(F.col("c"), 0)).first()
    assert tuple(v) == (1.0, 3.0, -3.0)


def test_symbols(spark, scratch):
    rows = [(1, 2, "X", 1, True, ["a"]), (1, 0, "X", 4, False, ["b"]), (0, 5, "Y", 2, False, ["a"])]
    d = spark.createDataFrame(rows, "f int, i int, k string, m int, g boolean, u array<string>")
    got = symbols.dense_ids(symbols.merged(d, ["k"], ["f", "i"], first=["m"], bits=[], flags=["g"], unions=["u"]), scratch).orderBy("symbol_id").collect()
    assert [(r.k, r.symbol_id, r.m, r.g, r.u) for r in got] == [("Y", 0, 2, False, ["a"]), ("X", 1, 4, True, ["a", "b"])]
