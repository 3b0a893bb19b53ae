"""The training-data operators against brute force, and on nulls, ties, repeated rows, clashing columns and empty tables."""

import base64
import hashlib
import json
import math
import os
import random
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
import zstandard

from lodework.llm import embedding_dedup, language_id, minhash_dedup, quality_rules, secret_scan, sentence_pieces, source_mixing, substring_dedup, token_ids, toxicity
from lodework.llm.common import Scratch
from lodework.operators.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 6))) for _ in range(80)]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice((0, 1, 3, 4, 5, 30, 120)))]
        text = r.choice((" ", "  ", "\n", "\t\x0b")).join(words)
        if i % 4 == 0:
            text += " " + passage
        if i % 7 == 0 and rows:
            text = (rows[-1][1] or "") + " x"
        rows.append((i * 3, text, "en", f"s{i % 3}", len(text)))
    return rows + [(1, None, None, None, None), (4, "", "fr", None, 0), (7, " \n\t ", "fr", "s0", 4), rows[5], rows[5], (500, "w " * 3000, "en", "s1", 6000), (501, "x" * 5000, "en", "s1", 5000)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_ids(spark, rows, docs, empty):
    shards = Scratch(spark, "t").save(token_ids.encode_documents(docs, token_ids.default_tokenizer(), shard_tokens=200), "shards")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_ids.read_documents(shards).collect())
    from tokenizers import Tokenizer

    lib, at, want = Tokenizer.from_file(token_ids.default_tokenizer()), 0, []
    assert [g[1] for g in got] == sorted(r[0] for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], r[1])
    for _, doc, *_ in got:
        ids = lib.encode(by_id[doc] or "", add_special_tokens=False).ids + [0]
        want.append((at, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_ids.read_documents(Scratch(spark, "t").save(token_ids.encode_documents(empty, token_ids.default_tokenizer()), "none")).count() == 0


def test_token_ids_of_control_characters():
    from tokenizers import Tokenizer

    lib, texts = Tokenizer.from_file(token_ids.default_tokenizer()), ["one, two", "a \0b", "\0b", "one \1, two", "\1,", "a \1", "b, \0\1"]
    for order in (texts, texts[::-1]):
        encoder = token_ids.Encoder(token_ids.default_tokenizer())
        for t in order * 2:
            assert np.frombuffer(encoder([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_token_pieces_and_random_access(tmp_path):
    from tokenizers import Tokenizer

    lib, encode = Tokenizer.from_file(token_ids.default_tokenizer()), token_ids.Encoder(token_ids.default_tokenizer(), cache_pieces=5)
    for t in ["a  b", "x\n\ny", " a", "a ", "a\n", "it's we'll  ok", "<|endoftext|> a", "é² ½ a", "日本 語", "a\tb", "", "\n", "a\x1cb", "don't\n'quoted 's x", "1 2\n3 a1b2 !!! a_b __ 'S", "foo$$$ bar!!. x__ y--' z"]:
        assert encode([t, t])[1] == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    ids = np.random.default_rng(0).integers(0, 1 << 26, 3000).astype("u4")
    ids[::3] %= 200
    path = tmp_path / "x.shard"
    path.write_bytes(token_ids.encode_shard([None, -5], [10, 3000], ids))
    shard = token_ids.Shard.open(path)
    assert [shard[i] for i in range(3000)] == ids.tolist() == shard.ids().tolist() and shard.keys == [None, -5]
    with pytest.raises(IndexError):
        shard[3000]


def brute_substrings(rows, k):
    docs = sorted((r[0], WORD.findall(r[1] or "")) for r in rows)
    first = {}
    for d, w in docs:
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = []
    for d, w in docs:
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("pack_bytes", (300, 1 << 22))
@pytest.mark.parametrize("k", (4, 50))
def test_substrings(spark, rows, docs, k, pack_bytes):
    got = substring_dedup.substring_dedup(docs, Scratch(spark, "t"), window=k, pack_bytes=pack_bytes).collect()
    assert sorted(map(tuple, got)) == brute_substrings(rows, k)


def test_substrings_edges(spark, empty):
    assert substring_dedup.substring_dedup(empty, Scratch(spark, "t")).count() == 0
    same = " ".join(map(str, range(60)))
    odd = spark.createDataFrame([(None, same), (2, same), (2, same), (3, same), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(odd, Scratch(spark, "t"), with_text=True).collect()}
    assert got == {(None, 0, same), (2, 0, same), (3, 60, ""), (None, 0, "")}


def brute_near(rows):
    sets = {}
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(d, set()).update({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids, comp = sorted(sets), {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                x, y = sets[a], sets[b]
                if comp[a] != comp[b] and x and y and 100 * len(x & y) >= 75 * len(x | y):
                    low = min(comp[a], comp[b])
                    comp[a] = comp[b] = low
                    changed = True
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in ids}


def test_near_duplicates(spark):
    r, rows = random.Random(3), []
    base = [r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(150)]
    for i in range(80):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 4, 9))):
            w[r.randrange(len(w))] = str(i)
        rows.append((i + 10, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    rows += [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "b a"), (6, "only these four words"), (7, " \n"), rows[0]]
    want = brute_near(rows)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == want
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    assert sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in minhash_dedup.near_duplicates(odd, Scratch(spark, "t")).collect()) == [(-1, -1, True), (-1, -1, True), (1, 1, True)]
    assert minhash_dedup.near_duplicates(odd.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("block", (7, 2048))
def test_one_key_in_blocks(spark, monkeypatch, block):
    """Under a key that all share, documents of different components meet once, those of one component never."""
    bands = minhash_dedup.Bands()
    sig = np.zeros(bands.bands, np.uint64).tobytes()
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = spark.createDataFrame([(i, 100, 0 if i < 20 else i % 3 + 1, sig) for i in range(40)], "id long, n long, component long, bands binary")
    met = minhash_dedup.tasks(minhash_dedup.keys_of(rows, bands).filter("band = 0")).collect()
    groups, pairs = {}, []
    for r in met:
        groups.setdefault((r.g, r.lo, r.hi), []).append(r)
    of = {r.id: r.component for r in rows.collect()}
    for g in groups.values():
        pairs += [(min(x.id, y.id), max(x.id, y.id)) for x in g for y in g if of[x.id] != of[y.id] and ((x.side, y.side) == (0, 1) or x.side == y.side == 2 and x.id < y.id)]
    assert sorted(pairs) == [(a, b) for a in range(40) for b in range(a + 1, 40) if of[a] != of[b]]
    if block == 7:  # twenty of one component never travel to more than the blocks of the others
        assert max(sum(r.id == i for r in met) for i in range(20)) == 3


@pytest.mark.parametrize("block", (64, 2048))
def test_many_components_under_one_band(spark, monkeypatch, block):
    """Two thousand documents share one band; what leaves the tasks grows with the documents, not with their pairs, and every link is found."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng, bands = np.random.default_rng(3), minhash_dedup.Bands()
    n, sets, sigs = 2000, [], []
    perms = bands.permutations()
    for i in range(n):  # families of 20 around one set each; half of a family is linked to its first member, all are linked through others
        base = np.random.default_rng(i // 20).integers(0, 1 << 63, 100).astype(np.uint64)
        drop = (i % 20) * 2
        x = np.unique(np.concatenate([base[drop:], np.arange(i // 20 * 1000, i // 20 * 1000 + drop).astype(np.uint64)]))
        v = minhash_dedup.signature(x, bands, perms).copy()
        v[0] = 7
        sets.append(x)
        sigs.append(v.tobytes())
    at = rng.permutation(n).tolist()
    reps = spark.createDataFrame([(at[i], len(sets[i]), sigs[i]) for i in range(n)], "id long, n long, bands binary")
    labels, full = spark.createDataFrame([(i, i) for i in range(n)], "id long, component long"), spark.createDataFrame([(at[i], sets[i].tobytes()) for i in range(n)], "id long, set binary")
    scratch = Scratch(spark, "t")
    links = minhash_dedup.remaining_links(reps, labels, full, bands, scratch)
    got = dict(map(tuple, components(links, scratch).collect()))
    family = {}
    for i in range(n):
        family.setdefault(i // 20, []).append(at[i])
    assert {got[v] for v in at} == {min(f) for f in family.values()} and all(got[v] == min(f) for f in family.values() for v in f)
    assert links.count() <= 96 * n and scratch.spark.read.parquet(scratch.latest["needed"]).filter("band = 0").count() <= n * (2 + n // block)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    comp = {v: v for e in edges for v in e}
    for _ in range(60):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    assert got == {v: c for v, c in comp.items() if v in got} and all(c == v for v, c in comp.items() if v not in got)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 16))
    vectors = [(base[i % 20] + rng.normal(size=16) * 0.12).tolist() for i in range(200)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, vectors[0]), (901, [2 * x for x in vectors[0]]), (902, None), (903, [0.0] * 16), (904, [math.nan] + [1.0] * 15), (906, [math.inf] + [0.0] * 15), (907, []), (905, None)]
    # Other lengths link among themselves; components may be too large or small to be squared.
    more = [(920, [1.0, 2.0, 3.0]), (921, [1e200, 2e200, 3e200]), (922, [1e-200, 2e-200, 3.1e-200]), (923, [3.0, -1.0, 0.0]), (924, [5e-324]), (925, [1e308]), (926, [-1.0])]
    rows += [*more, (920, more[0][1])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t")).collect()}
    ids = [i for i, _ in rows[:202]]
    x = np.array([v for _, v in rows[:202]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T) >= 0.9
    np.fill_diagonal(link, False)
    comp = np.array(ids)
    for _ in range(20):
        comp = np.minimum(comp, np.where(link, comp[None, :], 10**6).min(axis=1))
    assert [got[i].n_links for i in ids] == link.sum(axis=1).tolist()
    assert [got[i].component_id for i in ids] == comp.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(902, 908))
    assert [(got[i].n_links, got[i].component_id) for i in range(920, 927)] == [(3, 920), (3, 920), (3, 920), (0, 923), (1, 924), (1, 924), (0, 926)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), Scratch(spark, "t")).count() == 0
    clash = spark.createDataFrame([(1, [1.0, 0.0], 7, 8), (2, [1.0, 0.1], 7, 8), (None, [1.0, 0.0], 7, 8)], "vec_id long, embedding array<float>, n_links long, id long")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_duplicates(clash, Scratch(spark, "t")).collect()) == [(0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("kind", ("float", "double"))
def test_embedding_pairs_found_one_way(spark, kind):
    """Few probes: pairs are missed, but what is found counts for both ends, in blocks too."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16)).astype(np.float32).astype(np.float64)
    x[600:] = (x[:600] + 0.35 * rng.normal(size=(600, 16))).astype(np.float32 if kind == "float" else np.float64)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, x[3].tolist())], f"vec_id long, embedding array<{kind}>")
    index = embedding_dedup.Index(probes=2, growth=0.0, least_cells=60, queries=16, codes=64)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(data, Scratch(spark, "t"), index=index).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T) >= 0.9
    np.fill_diagonal(link, False)
    apart = [i for i in range(600) if link[i].sum() == 1 and link[i + 600].sum() == 1 and link[i, i + 600] and i != 3]
    found = [i for i in apart if got[i].component_id == got[i + 600].component_id]
    assert len(apart) > 100 and len(found) > len(apart) / 2
    assert all(got[i].n_links == got[i + 600].n_links == 1 for i in found)
    assert all(got[i].n_links == got[i + 600].n_links == 0 for i in set(apart) - set(found))


def test_embedding_recall_by_cells():
    """Of pairs at the threshold, unclustered: the worst case."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, g, at = unit(rng.normal(size=(3000, 64))), rng.normal(size=(3000, 64)), np.arange(3000)
    b = 0.9 * a + np.sqrt(1 - 0.81) * unit(g - (g * a).sum(axis=1, keepdims=True) * a)
    for n in (10**4, 10**5, 10**6):
        index = embedding_dedup.Index()
        cells = index.cells(n)
        centers = embedding_dedup._kmeans(unit(rng.normal(size=(max(4096, 8 * cells), 64))), cells, 4)
        u, v = (embedding_dedup._nearest(x, centers, index.probed(cells)) for x in (a, b))
        assert ((u == v[at, 0][:, None]).any(axis=1) | (v == u[at, 0][:, None]).any(axis=1)).mean() > 0.995


def test_rotation_code_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + 0.3 * rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = embedding_dedup.rotation(64, 4)
    bits, factors = embedding_dedup.codes(x, turn)
    a, b = embedding_dedup.candidates(x, bits, factors, turn, 0.9, 4.0)
    exact = np.argwhere(x @ x.T >= 0.9)
    found = set(zip(a.tolist(), b.tolist()))
    assert all((i, j) in found for i, j in exact.tolist()) and len(found) < len(exact) + 400 * 400 / 50
    signs = np.where(np.unpackbits(bits, axis=1) == 1, 1, -1) / 8.0
    estimate = ((x @ turn.T) @ signs.T) / factors[None, :]
    assert abs((estimate - x @ x.T).mean()) < 0.005


def test_mix(spark, docs, rows, empty):
    got = source_mixing.mix(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in source_mixing.mix(docs.repartition(5), Scratch(spark, "t")).collect())
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == len(WORD.findall(r.text or ""))
        by.setdefault((r.source, r.source_size, r.target), []).append(r)
    assert len(by) == len({r[3] for r in rows})
    for (_, size, target), rs in by.items():
        assert sum(r.size for r in rs) == size and abs(sum(r.taken for r in rs) - target) <= 1
    assert math.isclose(sum(k[2] for k in by), 1.5 * sum(k[1] for k in by))
    assert source_mixing.mix(empty, Scratch(spark, "t")).count() == 0
    clash = docs.withColumn("size", docs.doc_id).withColumn("taken", docs.doc_id)
    assert source_mixing.mix(clash, Scratch(spark, "t")).count() == len(rows)


def test_mix_without_keys(spark):
    """A third of the rows without a key, and one key that many rows share: budgets are met, and reruns agree."""
    r = random.Random(4)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, " ".join("w" * r.randint(1, 9) for _ in range(r.randint(0, 40))), f"s{i % 2}") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(str, source_mixing.mix(table.repartition(n), Scratch(spark, "t")).collect())) for n in (1, 6))
    assert one == two
    got = source_mixing.mix(table, Scratch(spark, "t"), with_text=False)
    assert "text" not in got.columns
    for x in got.groupBy("source", "target").agg({"taken": "sum"}).collect():
        assert abs(x["sum(taken)"] - x.target) <= 1


@pytest.mark.parametrize("query", (token_ids, substring_dedup, minhash_dedup))
def test_clashing_columns(spark, query):
    """Columns that have the names of results or of steps in between change nothing."""
    rows = [(1, "a b c d e f g " * 10), (2, "a b c d e f g " * 10), (3, None), (4, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clash = plain.selectExpr("*", *[f"doc_id as {c}" for c in ("id", "pack", "n", "bands", "key", "h", "start", "n_tokens", "component_id", "n_words", "part")])

    def run(docs):
        s = Scratch(spark, "t")
        if query is token_ids:
            return token_ids.read_documents(s.save(token_ids.encode_documents(docs, token_ids.default_tokenizer()), "shards"))
        return substring_dedup.substring_dedup(docs, s) if query is substring_dedup else minhash_dedup.near_duplicates(docs, s)

    assert sorted(map(str, run(clash).collect())) == sorted(map(str, run(plain).collect()))
    if query is token_ids:
        assert run(clash.limit(0)).count() == 0


def test_mix_against_sql(spark, docs, rows):
    con = duckdb.connect()
    con.register("documents", __import__("pandas").DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    want = sorted(con.sql(source_mixing.ORACLE).fetchall())
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in source_mixing.mix(docs, Scratch(spark, "t")).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_piece_caches_are_bounded_in_bytes():
    """Words of rare characters take many bytes each; also within one text, what is remembered stays under the bound, and ids are the library's."""
    r, limit = random.Random(4), 0.01
    p = sentence_pieces.Pieces(sentence_pieces.default_model(), cache=limit)
    for _ in range(3):
        text = " ".join("".join(chr(r.randrange(0x1F300, 0x1F640)) + r.choice("ab") * 2 for _ in range(20)) for _ in range(3000))
        assert p.encode(text) == p.lib.encode(text)
        held = sum(sys.getsizeof(w) + sys.getsizeof(i) for x in (p.words, p.older) for w, i in x.items())
        assert 0 < held <= limit * 96_000_000
        assert sum(map(sys.getsizeof, p.heads.values())) <= limit * 48_000_000
    text = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(4, 12))) for _ in range(2000))
    assert p.encode(text) == p.lib.encode(text) and all(x is p.own.get(x, x) for v in p.heads.values() for x in v)


def test_sentence_pieces():
    p = sentence_pieces.Pieces(sentence_pieces.default_model())
    for t in [r[1] or "" for r in corpus(5)] + ["  a  b\n\tc é ﬁ", "日本語 x", "   ", "▁a▁", "x" * 500, "ab" * 300 + " !" * 40, "\U0001f600 hi\n\n"]:
        assert p.encode(t) == p.lib.encode(t) and p.decode(p.encode(t)) == p.lib.decode(p.lib.encode(t))
    r = random.Random(2)
    for _ in range(60):
        s = "".join(r.choice("abcdetinhre▁ß") for _ in range(r.randint(1, 300)))
        lattice, ids, i = sentence_pieces.Lattice(p), [], 0
        while i < len(s):
            j = i + r.randint(1, 9)
            ids += lattice.feed(s[i:j])
            i = j
            assert len(lattice.text) < 200
        assert ids + lattice.close() == p.ids_of(p.merged(s))


def test_window_of_long_texts():
    """The path of the query: texts without boundaries, whole, in a window of a few longest pieces."""
    r = random.Random(8)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "a", "etaoinshrdlu", "é日本语abc", "ab1-"):
        p = sentence_pieces.Pieces(sentence_pieces.default_model())
        text = "".join(r.choice(alphabet) for _ in range(20000))
        assert p.encode(text) == p.lib.encode(text)
        assert p.lattice.widest <= 8 * p.longest
    p.kind = sentence_pieces.UNIGRAM
    p.lattice.widest = 0
    p.lattice.whole("".join(r.choice("etaoinshr") for _ in range(20000)))
    assert p.lattice.widest <= 8 * p.longest


def test_unigram_lattice_is_viterbi():
    p = sentence_pieces.Pieces(sentence_pieces.default_model())
    p.kind = sentence_pieces.UNIGRAM
    r = random.Random(4)
    p.id = {w: i for i, w in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "bb"])}
    p.score = {w: -r.random() * 5 for w in p.id}
    p.longest, p.byte_id = 3, {}
    for _ in range(100):
        s = "".join(r.choice("abcx") for _ in range(r.randint(1, 40)))
        best = [0.0] + [-math.inf] * len(s)
        for i in range(1, len(s) + 1):
            for n in (1, 2, 3):
                if n <= i:
                    w = s[i - n : i]
                    score = p.score.get(w, p.unknown_score if n == 1 else None)
                    if score is not None:
                        best[i] = max(best[i], best[i - n] + score)
        lattice = sentence_pieces.Lattice(p)
        path = []
        p.ids_of = lambda x, path=path: path.extend(x) or []
        lattice.feed(s)
        lattice.close()
        assert "".join(path) == s and math.isclose(sum(p.score.get(w, p.unknown_score) for w in path), best[-1])


def test_sentence_piece_tables(spark, docs, rows, empty):
    out = sentence_pieces.encode_documents(docs, sentence_pieces.default_model())
    back = sentence_pieces.decode_documents(out, sentence_pieces.default_model())
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r[0], r[1] or "") for r in rows)
    assert all(r.round_trip for r in out.collect()) and sentence_pieces.encode_documents(empty, sentence_pieces.default_model()).count() == 0


def brute_base(t):
    kinds = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0))
    out = []
    for order, (kind, pattern, flags) in enumerate(kinds):
        for m in re.finditer(pattern, t, flags):
            if kind == "assign" and any(ord(c) > 127 for c in m[1]):
                continue
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secrets(spark):
    texts = [None, "", "é token = 'abcdef12'", "secret: token: abcdefgh", "AKIA" + "X9" * 12 + "b", "0123456789abcdef" * 3, "PassWord:short", "api_key=ABCDEF api-key=abcdefg APIKEY: 'x1y2z3'", 'k = "Xy12-abcd-99QQ"\nauth_token_value = k', '{"client_secret_value": "aB3$dE5fG7hJ9k"}', 'signing_private_key = "Ab1" + "cD2eF3gH4i"', "the token of the key: value is plain", "x" * 100000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("old"))
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert "lexed" in got[8].spans and "lexed" in got[9].spans and "lexed" in got[10].spans and got[11].spans == ""
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[0] is None and clean[2] == "é [SECRET]'" and "Xy12" not in clean[8] and clean[11] == texts[11]


KEY = "Zk9xQ2vLmT7pRw4s"
#: Texts, and the literals that are bound to sensitive names in them.
BINDINGS = [
    (f'private_access = "{KEY}"', [f'"{KEY}"']), (f'api_access: "{KEY}"', [f'"{KEY}"']), (f'{"x" * 130}_passphrase = "{KEY}"', [f'"{KEY}"']),
    (f'x = "{KEY}"\nmy_auth = x', [f'"{KEY}"']), (f'my_auth = x\nx = "{KEY}"', [f'"{KEY}"']), (f'x = "{KEY}"\nx = f()\nmy_auth = x', []),
    (f'a = "{KEY}"\nb = a\nc = b\ncredential = c', [f'"{KEY}"']), ('a = b\nb = a\ncredential = a', []), (f'f(x="{KEY}")\nmy_auth = x', []),
    ("p = 'Zk9xQ'\nq = '2vLmT7pRw4s'\ncredential = p + q", ["'Zk9xQ'", "'2vLmT7pRw4s'"]), ('signing_private_key = "Ab1" + "cD2eF3gH4i"', ['"Ab1"', '"cD2eF3gH4i"']),
    ('{"client_secret_value": "aB3$dE5fG7hJ9k"}', ['"aB3$dE5fG7hJ9k"']), (f"<credentials>{KEY}</credentials>", [KEY]), (f'<add key="DbPwd" value="{KEY}"/>', [f'"{KEY}"']),
    (f"- name: DB_CREDENTIAL\n  value: {KEY}\n", [KEY]), (f'setenv("PRIVATE_KEY", "{KEY}")', [f'"{KEY}"']), (f"curl --auth-bearer {KEY} http://x", [KEY]),
    (f"private_key: |\n  -----BEGIN PRIVATE KEY-----\n  {KEY}\n  -----END PRIVATE KEY-----\nother: 1", [f"-----BEGIN PRIVATE KEY-----\n  {KEY}\n  -----END PRIVATE KEY-----"]),
    (f"PRIVATE_KEY=$(cat <<EOF\n{KEY}\nEOF\n)", [KEY]), (f'let authBearer: String = "{KEY}";', [f'"{KEY}"']), (f"conn[\"pwd\"] = '{KEY}'", [f"'{KEY}'"]),
    (f"# credential = '{KEY}'", [f"'{KEY}'"]), (f'credential = """{KEY}"""', [f'"""{KEY}"""']), (f"don't use credential = '{KEY}', it's bad", [f"'{KEY}'"]),
    (f'passphrase = "{KEY}".strip()', [f'"{KEY}"']), (f'credential = get("{KEY}")', []), (f"credential = env['X'] or '{KEY}'", []), ('key = "hello there all friends 123"', []),
    ("the token of the key: value is plain", []), ("passphrase = undefined", []), (f'plain_name = "{KEY}"', []), (f"# x = '{KEY}'\nmy_auth = x", []),
]


@pytest.mark.parametrize("text,want", BINDINGS)
def test_bindings(text, want):
    assert [text[a:b] for a, b, _ in secret_scan.lexed_spans(text)] == want


def test_constants_against_brute_force():
    """Random programs of constants, against a walk over all that each name can mean."""
    r = random.Random(6)
    for _ in range(200):
        names, lines = ["a", "b", "c", "my_credential", "auth_token_value"], []
        for i in range(r.randint(1, 12)):
            lines.append((r.choice(names), r.choice((f'"{KEY}{i}"', f'"{KEY}{i}"', r.choice(names), r.choice(names), "f()"))))
        text = "\n".join(f"{n} = {v}" for n, v in lines)
        want, work = set(), [i for i, (n, _) in enumerate(lines) if n in names[3:]]
        seen = set()
        while work:
            i = work.pop()
            if i in seen:
                continue
            seen.add(i)
            v = lines[i][1]
            if v.startswith('"'):
                want.add(v)
            elif v in names:
                before, after = [j for j in range(i) if lines[j][0] == v], [j for j in range(i + 1, len(lines)) if lines[j][0] == v]
                work += before[-1:] or after[:1]
        assert {text[a:b] for a, b, _ in secret_scan.lexed_spans(text)} == want, text


def test_secrets_of_long_and_odd_texts(spark, empty):
    import time

    began = time.time()
    many = "".join(f'api_access_{i} = "{KEY}{i}"\n' for i in range(40000))
    base, spans = secret_scan.scan(many + "token = 'abcdef12'\n" * 20000)
    assert len(base) == 20000 and len(spans) == 60000
    for t in ("x" * 10**6, "'" * 10**5 + " key", '"' * 100001 + " key =", '"""' * 30001 + " key", "a.b-" * 10**5 + " key", "-" * 10**5 + " key", "<a>" * 10**5 + "key", "key: " * 10**5, "x = y\ny = x\n" * 20000 + "auth_token=x", "key=<<A\n" * 20000, "<key>" + "b" * 10**6):
        secret_scan.scan(t)
    assert time.time() - began < 120  # seconds; quadratic steps would take hours
    assert secret_scan.secret_scan(empty).count() == 0 == secret_scan.redact(empty).count()
    rows = [(1, "token = 'abcdef12'", "a", 1), (1, "token = 'abcdef12'", "a", 1), (2, None, "b", 2)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, __text string, __row long")
    got = sorted(map(tuple, secret_scan.redact(clash).collect()), key=str)
    assert got == sorted([(1, "[SECRET]'", "a", 1), (1, "[SECRET]'", "a", 1), (2, None, "b", 2)], key=str)
    assert [r.n_assign for r in secret_scan.secret_scan(clash.withColumnRenamed("__row", "spans")).orderBy("doc_id").collect()] == [1, 1, 0]


def test_toxicity(spark):
    r, rows, labels = random.Random(0), [], []
    for i in range(300):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 60))]
        if i % 5 == 0:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(("zorg", "vilify", "Vilifying"))
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2, int(i % 5 == 0)))
    rows += [(900, None), (901, ""), (902, "12 !!")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, labels[0], (903, 1, 1), (None, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks.filter("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [i for i in range(300) if i % 3 == 1]
    assert np.mean([got[i].predicted == int(i % 5 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].predicted == 0 == got[901].predicted
    spans = [rows[i][1][int(a) : int(b)].lower() for i in held if got[i].predicted for a, b, _ in (s.split(":") for s in got[i].offending.split(","))]
    assert set(spans) <= {"zorg", "vilify", "vilifying"}
    none = toxicity.toxicity(docs, toxicity.fit(docs, marks.limit(0)))
    assert none.count() == len(rows)


def brute_marginals(unary, change):
    """By all state sequences."""
    from itertools import product

    total, one = 0.0, np.zeros(len(unary))
    for states in product((0, 1), repeat=len(unary)):
        e = math.exp(sum(u * y for u, y in zip(unary, states)) + sum(change[a, b] for a, b in zip(states, states[1:])))
        total += e
        one += e * np.array(states)
    return one / total


def test_chain_marginals_against_enumeration():
    change, rng = np.array([[0.2, -0.4], [-0.3, 0.7]]), np.random.default_rng(0)
    for sizes in ((1,), (7,), (3, 1, 9, 2, 8)):
        unary = rng.normal(size=sum(sizes)) * 2
        begins = np.cumsum((0, *sizes[:-1]))
        want = np.concatenate([brute_marginals(part, change) for part in np.split(unary, begins[1:])])
        assert np.allclose(toxicity.marginals(unary, begins, change), want)
    # A long text against the same recursion token by token.
    unary, a, forward = rng.normal(size=5000) * 3, np.ones(2) / 2, []
    step = lambda u: np.exp(change) * np.exp([0.0, u])[None, :]
    a = np.exp([0.0, unary[0]])
    for i, u in enumerate(unary):
        a = a @ step(u) if i else a
        a = a / a.sum()
        forward.append(a)
    b, want = np.ones(2), []
    for i in range(4999, -1, -1):
        p = forward[i] * b
        want.append(p[1] / p.sum())
        b = step(unary[i]) @ b
        b = b / b.sum()
    assert np.allclose(toxicity.marginals(unary, np.array([0]), change), want[::-1])


def test_unary_weights_of_tokens():
    """Every token has features: its own, its neighbours' and its pair's; a text doesn't see the one before."""
    m = toxicity.ToxicityModel({"bad": 4.0, "ba*": 9.0, "mea*": 3.0, "before=bad": 0.5, "after=mean": 0.25, "shape=upper": 1.0, "end=ean": 0.125}, bias=-1.5)
    pair = int(toxicity.pair_hashes(np.array([toxicity.word_hash("ok"), toxicity.word_hash("BAD")], np.uint64))[0])
    m.pairs = {pair: 2.0}
    unary, begins = m.unary([["ok", "BAD", "x"], [], ["x", "mean"], ["BAD"]])
    assert begins.tolist() == [0, 3, 5]
    assert np.allclose(unary + 1.5, [0, 4 + 1 + 2, 0.5, 0.25, 3.125, 5])
    r, words = random.Random(3), ["a", "A", "Mean", "MEANEST", "évidente", "x" * 15, "Straße", "badly", "bad"]
    m = toxicity.ToxicityModel({f: r.random() for w in words for fs in toxicity.features(w) for f in fs}, bias=0.0)
    for w in words:
        assert np.allclose(m.unary([[w]])[0], sum(m.weights[f] for f in toxicity.features(w)[0]))
        assert np.allclose(m.unary([["q", w, "q"]])[0][[0, 2]] - m.unary([["q"]])[0], [sum(m.weights[f] for f in toxicity.features(w)[2]), sum(m.weights[f] for f in toxicity.features(w)[1])])


def test_chain_learns_context():
    """A word that is offending only after another one: the lexicon can't know, the chain does."""
    r = random.Random(1)
    windows = []
    for _ in range(400):
        words = [r.choice(("sun", "moon", "star", "rain")) for _ in range(10)]
        labels = [0] * 10
        at = r.randrange(1, 10)
        words[at - 1], words[at] = r.choice((("you", "fool"), ("april", "fool")))
        labels[at] = int(words[at - 1] == "you")
        windows.append((words, labels))
    m = toxicity.ToxicityModel()
    toxicity.train_chain(windows, m)
    bad, good = m.tag(["rain you fool sun", "rain april fool sun"])
    assert bad[2] > 0.8 and good[2] < 0.2


def test_toxicity_edges(spark, empty):
    model = toxicity.ToxicityModel({"vile": 12.0}, calibration=(-3.0, 4.0, 0.0, 8.0))
    long = "fine " * 200000 + "vile " * 3
    rows = [(1, None, 5), (1, None, 5), (2, "", 5), (3, long, 5), (3, long, 5), (4, "Vile VILE vile", 5)]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.doc_id)] == [1, 1, 2, 3, 3, 4]
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score and by[4].predicted == 1 and by[4].offending.startswith("0:4:") and by[3].offending.count(",") == 2
    assert toxicity.toxicity(empty, model).count() == 0 and toxicity.toxicity(empty, model).columns[-3:] == ["score", "predicted", "offending"]
    # Labels of one class, of no class, repeated and null ones.
    marks = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, score int"), marks).weights == {}


def test_bounded_sample(spark):
    """One key may hold most rows and texts may be long: what is gathered stays bounded, and the same on every run."""
    from lodework.llm.common import bounded_sample, chosen

    rows = [("a", 7, "x" * 10)] * 3000 + [("a", i, "y" * 100) for i in range(100, 160)] + [("b", i, "z") for i in range(5)] + [("b", 50, None), (None, 1, "q")] + [(f"rare{i}", i, "w") for i in range(3)]
    table = spark.createDataFrame(rows, "g string, k long, t string")
    runs = []
    for part in (1, 5):
        some, counts = chosen(table.repartition(part), "g", "k", 10000, "s", most_groups=2)
        runs.append(bounded_sample(some, "g", "k", "t", 20, 1000, Scratch(spark, "t")))
        assert counts == {"a": 3060, "b": 6}
    assert runs[0] == runs[1] and set(runs[0]) == {"a", "b"}
    assert len(runs[0]["b"]) == 5 and len({k for k, _ in runs[0]["a"]}) == len(runs[0]["a"]) and sum(len(t) for _, t in runs[0]["a"]) <= 1000


def test_language(spark, empty):
    r = random.Random(0)
    parts = {"aa": ["thor", "ing", "the", "and"], "bb": ["ción", "los", "que", "ñar"], "cc": ["heit", "und", "sch", "über"]}
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))), lang) for i, lang in enumerate(sorted(parts) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !", "aa"), (902, "", None), rows[3]], "doc_id long, text string, lang string")
    model = language_id.fit(docs.filter("doc_id % 5 <> 0"))
    got = {x.doc_id: x for x in language_id.identify(docs, model).collect()}
    held = [x for x in rows if x[0] % 5 == 0]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and all(0 <= x.score <= 1 for x in got.values())
    assert language_id.identify(docs, language_id.fit(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
    # Brute force: the smallest of each text's lengths, compressed by the library with each dictionary.
    for i, t, _ in rows[:60]:
        sizes = []
        for lang, data in sorted(model.dictionaries.items()):
            shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False)
            sizes.append((len(packer.compress(language_id.normal(t).encode())), lang))
        sizes.sort()
        assert got[i].lang_pred == sizes[0][1] and got[i].accepted == ((sizes[1][0] - sizes[0][0]) / sizes[0][0] >= language_id.MARGIN)
    long = spark.createDataFrame([(1, rows[0][1] * 3000, "old"), (1, rows[0][1] * 3000, "old"), (2, None, None)], "doc_id long, text string, score string")
    assert [(x.doc_id, x.lang_pred) for x in sorted(language_id.identify(long, model).collect(), key=lambda x: x.doc_id)] == [(1, "aa"), (1, "aa"), (2, "und")]
    assert language_id.identify(empty, model).count() == 0


def brute_quality(t):
    t = t or ""
    w, seen, places, lines, dup = WORD.findall(t), {}, set(), set(), 0
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places |= {j for i in at for j in (i, i + 1, i + 2)}
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(places), len(w) < 50 or 100 * len(places) > 50 * len(w)


def test_quality(spark, rows, docs, empty):
    more = spark.createDataFrame([(800, "a b c\na b c\n\n a b c\n#$%", 1), (801, "one two " * 40, 2)], "doc_id long, text string, ratio int")
    got = quality_rules.quality_rules(docs.select("doc_id", "text").unionByName(more.drop("ratio"))).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text) and (not r.kept or not r.base_failed)
    assert quality_rules.quality_rules(more).count() == 2 and quality_rules.quality_rules(empty).count() == 0
    r = random.Random(0)
    noise, prose = "".join(chr(r.randrange(33, 127)) + (" " if i % 9 == 0 else "") for i in range(6000)), " ".join("".join(r.choice("aeioust") for _ in range(r.randint(2, 8))) for _ in range(900))
    slow = " ".join(str(i % 400) for i in range(4000))
    got = {x.doc_id: x.reason for x in quality_rules.quality_rules(spark.createDataFrame([(1, noise * 1), (2, prose), (3, slow)], "doc_id long, text string")).collect()}
    assert got[2] == "" and got[3] in ("repeats", "repetitive") and got[1] in ("", "incompressible")


def test_quality_bands(spark):
    r = random.Random(3)
    cut = lambda s, k: " ".join(s[i : i + k] for i in range(0, len(s), k))
    made = {
        "base64": lambda n: cut(base64.b64encode(r.randbytes(n)).decode(), 8),
        "base64 lines": lambda n: cut(base64.b64encode(r.randbytes(n)).decode(), 76),
        "ascii": lambda n: cut("".join(chr(r.randrange(33, 127)) for _ in range(n)), 9),
        "template": lambda n: "".join(f"Item {r.randrange(10**6)} of product {r.randrange(1000)} costs {r.randrange(100)} dollars and ships in {r.randrange(9)} days.\n" for _ in range(n // 40)),
        "prose": lambda n: " ".join("".join(r.choice("eeeetttaaaooinnsshhrrdlcumwfgypbvk") for _ in range(r.randint(1, 9))) for _ in range(n)),
    }
    rows = [(f"{what} {n}", f(n)[:n]) for what, f in made.items() for n in (600, 1500, 4500, 9000, 40000, 100000)]
    got = {x.name: x.reason for x in quality_rules.quality_rules(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert {k: v for k, v in got.items() if k.startswith(("base64", "ascii")) and v not in ("words", "incompressible")} == {}
    assert all(got[f"base64 {n}"] == got[f"ascii {n}"] == "incompressible" for n in (1500, 4500, 9000, 40000, 100000)) and got["base64 lines 9000"] == "incompressible"
    assert {k: v for k, v in got.items() if k.startswith("template") and v not in ("words", "repeats", "repetitive")} == {}
    assert {k: v for k, v in got.items() if k.startswith("prose") and not k.endswith(("40000", "100000")) and v} == {}
    bands = quality_rules.Bands()
    said = lambda text: quality_rules._judge(text.encode(), bands, zstandard.ZstdCompressor(level=bands.level))[3]
    assert all(said(dict(rows)[f"template {n}"]) == "repetitive" for n in (1500, 4500, 9000, 40000, 100000)) and said(cut(r.randbytes(20000).hex(), 8)) == "incompressible"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_quality_bands_keep_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = quality_rules.quality_rules(docs).filter("not base_failed")
    assert got.count() > 0 == got.filter("not kept").count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    rows = []
    for i in range(40):
        words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 200))]
        rows.append((i, " ".join(words) + (" token = 'abcdef123456'" if i % 3 == 0 else ""), "en", f"s{i % 4}", 0))
    rows += [(100 + i, rows[i][1], "en", "s9", 0) for i in range(10)] + [(200, None, None, None, None), (201, "", "en", None, 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    clash = table.selectExpr("*", "doc_id as size", "doc_id as taken", "doc_id as ratio", "doc_id as kept", "doc_id as spans", "doc_id as component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, clash, str(tmp_path))
        assert after.columns == clash.columns and after.filter("size <> doc_id or taken <> doc_id or kept <> doc_id").count() == 0 < after.count()
        assert stage(spark, clash.limit(0), str(tmp_path)).count() == 0
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(x.round_trip for x in out)
    # Brute force: quality, near duplicates, masks; then the mix's own budgets.
    kept = [x for x in rows if not brute_quality(x[1])[5]]
    comp = brute_near(kept)
    kept = [x for x in kept if comp[x[0]][2]]
    pieces = sentence_pieces.Pieces(sentence_pieces.default_model())
    texts = {x[0]: x[1].replace("token = 'abcdef123456", "[SECRET]") for x in kept}
    assert {x.doc_id for x in out} <= set(texts)
    for x in out:
        text = pieces.decode(np.frombuffer(x.ids, "<u4").tolist())
        assert texts[x.doc_id].startswith(text) and len(text) > 0
    sizes = {d: len(WORD.findall(t)) for d, t in texts.items()}
    taken = sum(len(WORD.findall(pieces.decode(np.frombuffer(x.ids, "<u4").tolist()))) for x in out)
    assert abs(taken - 1.5 * sum(sizes.values())) <= 8
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "secret_scan", "source_mixing", "sentence_pieces"]
