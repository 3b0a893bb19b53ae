"""Embedding near-dedup (operator 4): randomised-rotation binary codes with correction factors.

Every vector is normalised, rotated by one random rotation and stored as the signs of its
coordinates and one factor, the inner product of the rotated vector with its code. For a query q the
inner product of the rotated q with the code, over the factor, estimates the cosine without
bias. Of a pair at cosine s the estimate's standard error is sqrt(1 - s^2) * sqrt(1 - f^2) / (f * sqrt(d - 1)),
f the factor and d the length: so pairs at the threshold or above lie, but for `confidence` standard
errors, over a bound that is known before they are seen. Pairs over it, and only these, are computed
exactly in double precision.

Which pairs are estimated at all is up to an inverted index: each vector lies in the cell of its
nearest centroid and probes several nearest cells, more of them the more cells there are. What travels
to the probed cells is a code (an 8-byte id, a bit a coordinate and the factor); a query goes to its own
cell alone, in one byte a coordinate, whose rounding the bound allows for. Full vectors
travel only to tasks in which the bound has chosen them. A cell is split into blocks of queries and blocks of
codes, so no task holds more than one of each. A pair is found when either end probes the cell of the
other; of two such tasks one owns it, which counts it for both ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.llm.common import Scratch
from lodework.operators.graph import components


@dataclass(frozen=True)
class Index:
    """cells: density * sqrt(vectors), at least least_cells; centroids are fitted on at most sample_a_cell vectors a cell (at least 4,096), every vector is indexed."""

    threshold: float = 0.9
    #: Cells that a vector probes: `probes`, or growth * cells**0.4 if that is more.
    probes: int = 12
    growth: float = 1.9
    density: float = 0.5
    least_cells: int = 8
    sample_a_cell: int = 8
    #: Standard errors of an estimate that its bound allows for.
    confidence: float = 4.0
    queries: int = 4096
    codes: int = 32768
    seed: int = 4

    def cells(self, n: int) -> int:
        return max(self.least_cells, int(self.density * n**0.5))

    def probed(self, cells: int) -> int:
        return min(cells, max(self.probes, int(np.ceil(self.growth * cells**0.4))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their norms, scaled by their largest component first so that nothing over- or underflows; which of them have a norm."""
    finite = np.isfinite(v).all(axis=1)
    most = np.abs(np.where(finite[:, None], v, 0.0)).max(axis=1, initial=0.0)
    ok = finite & (most > 0)
    scaled = np.where(ok[:, None], v, 1.0)
    # Powers of two leave every bit of the components as it is; two steps, as 2^-e can overflow.
    shift = np.frexp(np.where(ok, most, 1.0))[1][:, None]
    scaled = np.ldexp(np.ldexp(scaled, -(shift // 2)), shift // 2 - shift)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), ok


def _hash_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's double bits; -0.0 is 0.0."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    place = np.arange(1, x.shape[1] + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        two = [_mix(_mix(bits + place * np.uint64(c)) * (place * np.uint64(2) + np.uint64(1))).sum(axis=1, dtype=np.uint64) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
        return tuple(_mix(t).view(np.int64) for t in two)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length in a column of lists; null lists and null components are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.values
    values, holes = np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64), np.asarray(column.offsets)
    sizes = np.where(np.asarray(column.is_valid()), np.diff(holes), 0)
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, rows, values[holes[rows][:, None] + np.arange(n)]


def _vectors(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, dim, h1, h2, v): the normalised vectors with a 128-bit key; dim 0 where a row links with nothing. v is floats if these hold the input, else doubles. Narrow."""
    short = vectors.schema[embedding].dataType.elementType.simpleString() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            dim, h1, h2, out = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            for size, rows, raw in _by_length(b.column(1)):
                x, ok = _unit(raw)
                ok &= np.asarray(b.column(0).is_valid())[rows]
                dim[rows[ok]] = size
                h1[rows[ok]], h2[rows[ok]] = _hash_rows(x[ok])
                data = raw[ok].astype(np.float32) if short else raw[ok]
                for r, v in zip(rows[ok].tolist(), data, strict=True):
                    out[r] = v.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dim), pa.array(h1), pa.array(h2), pa.array(out, pa.binary())], names=["id", "dim", "h1", "h2", "v"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    return rows.mapInArrow(run, "id long, dim int, h1 long, h2 long, v binary")


def _read(packed: list[bytes], dim: int) -> np.ndarray:
    """Normalised vectors of the form that travels."""
    kind = np.float32 if packed and len(packed[0]) == 4 * dim else np.float64
    return _unit(np.frombuffer(b"".join(packed), kind).reshape(-1, dim).astype(np.float64))[0]


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(4):
        near = _nearest(x, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    out, n = [], min(n, len(centers))
    for i in range(0, len(x), 1024):
        s = -(x[i : i + 1024] @ centers.T)
        top = np.argpartition(s, n - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


_turns: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int) -> np.ndarray:
    if (dim, seed) not in _turns:
        _turns.clear()
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
        _turns[dim, seed] = q * np.sign(np.diag(r))
    return _turns[dim, seed]


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (packed) of the rotated vectors, and their inner products with the codes."""
    r = x @ turn.T
    return np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / np.sqrt(x.shape[1])


def candidates(queries: np.ndarray, bits: np.ndarray, factors: np.ndarray, turn: np.ndarray, threshold: float, confidence: float, rounding: float | np.ndarray = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs whose estimate reaches what pairs at the threshold stay over, but for `confidence` standard errors and the rounding of the queries (their errors' norms)."""
    dim = queries.shape[1]
    signs = np.where(np.unpackbits(bits, axis=1, count=dim) == 1, 1.0, -1.0).astype(np.float32) / np.float32(np.sqrt(dim))
    rotated = (queries @ turn.T).astype(np.float32)
    factors = factors.astype(np.float64)
    error = confidence * np.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0.0, 1 - factors**2)) / np.sqrt(max(1, dim - 1))
    least = (threshold * factors - error).astype(np.float32) - np.float32(1e-5)
    slack = np.broadcast_to(np.asarray(rounding, np.float32), (len(queries),))[:, None]
    return np.nonzero(rotated @ signs.T + slack >= least[None, :])


def _roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of nodes with these ids, linked by (a, b): the least id that links reach."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def _centers(rows: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """Of each length of vectors the centroids of its cells; lengths that need one cell have none and are not gathered."""
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * index.least_cells).collect()}
    out, test = {}, F.lit(False)
    most = {d: max(4096, index.sample_a_cell * index.cells(n)) for d, n in counts.items()}
    for d, n in counts.items():
        test |= (F.col("dim") == d) & (F.pmod(F.col("h1"), F.lit(1 << 52)) < int((1 << 52) * min(1.0, 1.1 * most[d] / n)))
    if not counts:
        return out
    picked: dict[int, dict] = {}
    for r in rows.filter(test).groupBy("dim", "h1", "h2").agg(F.min("v").alias("v")).toLocalIterator():  # about 1.1 * most rows a length, of distinct vectors
        picked.setdefault(r["dim"], {})[r["h1"], r["h2"]] = r["v"]
    for d, found in picked.items():
        x = _read([bytes(found[k]) for k in sorted(found)[: most[d]]], d)
        out[d] = _kmeans(x, min(index.cells(counts[d]), len(x)), index.seed)
    return out


def near_duplicates(vectors: DataFrame, scratch: Scratch, key: str = "vec_id", embedding: str = "embedding", index: Index = Index()) -> DataFrame:
    """Per row: key, n_links (other rows linked directly), component_id and kept; other columns are dropped, whatever their names.

    A link is a cosine >= threshold of vectors of one length, whatever length that is and however large or
    small their components are. Vectors that are null, empty or zero, that hold null or non-finite
    components, or whose key is null link with nothing. Equal vectors are one class and go through the index once;
    every row counts, repeated ones too. An empty table gives an empty result.
    """
    rows = _vectors(vectors, key, embedding)
    good = rows.filter("dim > 0")
    models = _centers(good, index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, v = b.column(0).to_numpy(), b.column(5).to_pylist()
            cells: list = [[0]] * b.num_rows
            for d, centers in models.items():
                rows = np.flatnonzero(dims == d)
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    for r, c in zip(part.tolist(), _nearest(_read([v[j] for j in part], d), centers, index.probed(len(centers))).tolist(), strict=True):
                        cells[r] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    kinds = "dim int, h1 long, h2 long, rep long, many long, v binary"
    classes = good.groupBy("dim", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("many"), F.min("v").alias("v"))
    classes = classes.mapInArrow(place, kinds + ", cells array<int>").withColumn("cid", F.monotonically_increasing_id())
    classes = scratch.save(classes, "classes")
    # One row a cell.
    sizes = classes.select("dim", F.posexplode("cells").alias("n", "cell")).groupBy("dim", "cell").agg(F.count_if(F.col("n") == 0).alias("q"), F.count("*").alias("c"))
    blocks = {(r["dim"], r["cell"]): (-(-r["q"] // index.queries), -(-r["c"] // index.codes)) for r in sizes.filter((F.col("q") > index.queries) | (F.col("c") > index.codes)).toLocalIterator()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes to the probed cells and queries to their own, in one row for each task that they go to."""
        for b in batches:
            dims, cids = b.column(0).to_numpy(), b.column(1).to_numpy()
            v, cells = b.column(2).to_pylist(), b.column(3).to_pylist()
            out: dict[tuple, list] = {}
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = _read([v[j] for j in rows], d)
                bits, factors = codes(x, rotation(d, index.seed))
                scale = np.abs(x).max(axis=1) / 127
                small = np.rint(x / scale[:, None]).astype(np.int8)
                for j, r in enumerate(rows.tolist()):
                    cid, mine = int(cids[r]), cells[r]
                    code, query = bits[j].tobytes() + np.float32(factors[j]).tobytes(), small[j].tobytes() + np.float32(scale[j]).tobytes()
                    number = cids[r : r + 1].tobytes()
                    for at, cell in enumerate(mine):
                        nq, nc = blocks.get((d, cell), (1, 1))
                        for qb in range(nq):
                            out.setdefault((d, cell, qb, cid % nc, True), []).append(number + code)
                        if not at:
                            for cb in range(nc):
                                out.setdefault((d, cell, cid % nq, cb, False), []).append(number + query)
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array([b"".join(x) for x in out.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["dim", "cell", "qb", "cb", "is_code", "data"])

    def estimate(group: pa.Table) -> pa.Table:
        """Which vectors a task needs: (cid, is_code) of all ends of pairs over the bound."""
        dim, is_code = group.column("dim")[0].as_py(), group.column("is_code").to_numpy()
        data, width = group.column("data").to_pylist(), (dim + 7) // 8
        coded, queried = (np.frombuffer(b"".join(x for x, c in zip(data, is_code, strict=True) if c == side), np.uint8).reshape(-1, n) for side, n in ((True, 12 + width), (False, 12 + dim)))
        ids, qids = (np.ascontiguousarray(t[:, :8]).view(np.int64)[:, 0] for t in (coded, queried))
        bits, factors = coded[:, 8 : 8 + width], np.ascontiguousarray(coded[:, 8 + width :]).view(np.float32)[:, 0]
        scale = np.ascontiguousarray(queried[:, 8 + dim :]).view(np.float32)[:, 0].astype(np.float64)
        q = np.ascontiguousarray(queried[:, 8 : 8 + dim]).view(np.int8) * scale[:, None]
        need_q, need_c, turn = np.zeros(len(q), bool), np.zeros(len(ids), bool), rotation(dim, index.seed)
        for i in range(0, len(q), 512):
            for k in range(0, len(ids), 8192):
                s, t = candidates(q[i : i + 512], bits[k : k + 8192], factors[k : k + 8192], turn, index.threshold, index.confidence, scale[i : i + 512] * np.sqrt(dim) / 2)
                other = qids[i + s] != ids[k + t]
                need_q[i + s[other]] = need_c[k + t[other]] = True
        found = np.concatenate([qids[need_q], ids[need_c]])
        head = {c: pa.array(np.full(len(found), group.column(c)[0].as_py(), np.int32)) for c in ("cell", "qb", "cb")}
        return pa.table({"cid": found, **head, "is_code": np.arange(len(found)) >= need_q.sum()})

    sent = classes.select("dim", "cid", "v", "cells").mapInArrow(send, "dim int, cell int, qb int, cb int, is_code boolean, data binary")
    needed = sent.groupBy("dim", "cell", "qb", "cb").applyInArrow(estimate, "cid long, cell int, qb int, cb int, is_code boolean")
    needed = scratch.save(needed, "needed").join(classes.select("cid", "dim", "rep", "many", "v", "cells"), "cid")

    def confirm(group: pa.Table) -> pa.Table:
        """Links of a task: (cid, rep, number of rows linked, least rep that links reach)."""
        dim, side = group.column("dim")[0].as_py(), group.column("is_code").to_numpy()
        everything = group.column("v").to_pylist()
        qi, ci = np.flatnonzero(~side), np.flatnonzero(side)
        cid, rep, many = (group.column(c).to_numpy() for c in ("cid", "rep", "many"))
        x, q, turn = _read([everything[j] for j in ci], dim), _read([everything[j] for j in qi], dim), rotation(dim, index.seed)
        home = np.array([c[0] for c in group.column("cells").to_pylist()], np.int32)
        probed = [np.array(c, np.int32) for c in group.column("cells").to_pylist()]
        bits, factors = codes(x, turn)
        nodes, at = np.unique(cid, return_inverse=True)
        name = np.zeros(len(nodes), np.int64)
        name[at] = rep
        links, ends = np.zeros(len(nodes), np.int64), [np.zeros((2, 0), np.int64)]
        for i in range(0, len(q), 512):
            s, t = candidates(q[i : i + 512], bits, factors, turn, index.threshold, index.confidence)
            a, b = qi[i + s], ci[t]
            # A pair that the query's own probes lead to as well is counted in the view of the smaller query.
            back = np.zeros(len(a), bool)
            for j in np.unique(a).tolist():
                mine = a == j
                back[mine] = np.isin(home[b[mine]], probed[j])
            ok = (cid[a] != cid[b]) & (~back | (cid[a] < cid[b]))
            s, t, a, b = s[ok], t[ok], a[ok], b[ok]
            ok = np.concatenate([np.einsum("ij,ij->i", q[i + s[j : j + 65536]], x[t[j : j + 65536]]) >= index.threshold for j in range(0, len(s), 65536)] or [np.zeros(0, bool)])
            a, b = a[ok], b[ok]
            np.add.at(links, at[a], many[b])
            np.add.at(links, at[b], many[a])
            ends.append(np.unique(np.stack([at[a], at[b]]), axis=1))
        a, b = np.concatenate(ends, axis=1)
        root = _roots(a, b, name)
        some = np.flatnonzero(links)
        return pa.table({"cid": nodes[some], "rep": name[some], "links": links[some], "root": root[some]})

    met = needed.groupBy("dim", "cell", "qb", "cb").applyInArrow(confirm, "cid long, rep long, links long, root long")
    met = scratch.save(met, "met")
    scratch.drop("needed")
    links = met.groupBy("cid").agg(F.sum("links").alias("links"))
    per_class = classes.select("cid", "dim", "h1", "h2", "rep", "many").join(links, "cid", "left").select("dim", "h1", "h2", "rep", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per_row = scratch.save(rows.select("id", "dim", "h1", "h2").join(per_class, ["dim", "h1", "h2"], "left").select("id", "rep", "n_links"), "rows")
    same = per_row.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    labels = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(same), scratch)
    scratch.drop("classes", "met")
    out = per_row.join(labels, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), Scratch(spark, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
u AS (SELECT vec_id, e, sqrt(array_inner_product(e, e)) AS n FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE x.n > 0 AND y.n > 0 AND array_inner_product(x.e, y.e) / (x.n * y.n) >= 0.9),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.v = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
