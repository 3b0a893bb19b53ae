"""MinHash near-dedup (operator 5): min-max hashing, banding and exact confirmation.

Under each permutation a document keeps both the least and the greatest value of its shingles:
two values that agree with the probability of the similarity for one evaluation. Bands of
`rows` values make keys; documents that share a key are candidates.

No group is ever compared pairwise as a whole. First every document of a key is compared
with the key's smallest document only, and confirmed links are joined to components. What
can still be missing is a link between documents of one key in different components; only these
meet next, in blocks, and each task returns no more links than join what it found linked. Pairs within a
component need no look, so a group of near copies of any size costs about one comparison for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.functions import words as W
from lodework.llm.common import Scratch, partitions, raw, slices
from lodework.operators.graph import components


@dataclass(frozen=True)
class Bands:
    """rows values of one byte make a band (8: one integer); a pair of similarity s shares one of the bands with 1 - (1 - s^rows)^bands.

    With 8 and 96 that is 0.99996 at 0.75 and 0.9999999 at 0.8, and 0.0004 at 0.22.
    """

    rows: int = 8
    bands: int = 96
    shingle: int = 5
    percent: int = 75
    seed: int = 5

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.rows * self.bands // 2
        return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles: k words, or all of fewer words; A-Z lower-cased."""
    data = W.LOWER[data]
    starts, ends, first = W.words(data, offsets)
    hashes = W.word_hashes(data, starts, ends)
    full, out = W.windows(hashes, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        else:
            out.append(W.windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, bands: Bands, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The lowest byte of each least and then of each greatest value, eight of them, a band, to an integer."""
    x, (a, b) = (shingles >> np.uint64(32)).astype(np.uint32), perms
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 1024):
        h = a[:, None] * x[None, i : i + 1024]
        h += b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    v = W.mix(np.concatenate([low, high]).astype(np.uint64) + np.arange(2 * len(a), dtype=np.uint64) * np.uint64(1 << 33))
    return v.astype(np.uint8).view(np.uint64)


def spread(signatures: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the bands of many signatures, as an array (documents, bands): the band's values and its number, mixed."""
    return W.mix(W.mix(signatures.reshape(-1, bands.bands)) ^ np.arange(1, bands.bands + 1, dtype=np.uint64))


def _set_key(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        two = [W.mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return tuple(int(x.astype(np.int64)) for x in two)


def features(docs: DataFrame, bands: Bands, key: str, text: str) -> DataFrame:
    """Per row: id, n_shingles, a 128-bit key of the set, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = bands.permutations()
        for batch in slices(batches):
            sets = shingle_sets(*raw(batch.column(1)), bands.shingle)
            keys = [_set_key(s) for s in sets]
            bins = [signature(s, bands, perms).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(bins, pa.binary())], names=["id", "n", "k1", "k2", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, k1 long, k2 long, bands binary")


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key and id: which are a key's first, and for the others the id and its key's first id."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    center = ids[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))] if len(keys) else ids
    other = ~first & (ids != center)
    return order[first], ids[other], center[other]


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    both = np.unique(np.stack([a, b], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def star_edges(reps: DataFrame, buckets: int, bands: Bands, rows_at_once: int = 4096) -> DataFrame:
    """(a, b): each document with the smallest one of a key that both have.

    Keys travel as arrays, one row for a range of keys and rows_at_once documents, and of the
    documents of one key in such a row only the smallest goes on: a key that a third of all
    documents share brings one entry for each row to the task of its range.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, data):
            ids = np.repeat(np.array(ids, np.int64), bands.bands)
            keys = spread(np.frombuffer(b"".join(data), np.uint64), bands).reshape(-1)
            firsts, a, b = _stars(keys, ids)
            a, b = _pairs(a, b)
            out = [(-1 - int(a[0]) % 64, a.tobytes(), b.tobytes())] if len(a) else []  # settled here
            keys, ids = keys[firsts], ids[firsts]  # sorted by key
            at = (keys >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            out += [(int(at[i]), keys[i:j].tobytes(), ids[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "x", "y"])

        ids, data = [], []
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                data.append(b)
                if len(ids) >= rows_at_once:
                    yield flush(ids, data)
                    ids, data = [], []
        if ids:
            yield flush(ids, data)

    def edges(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def meet(group: pa.Table) -> pa.Table:
        x = b"".join(group.column("x").to_pylist())
        if group.column("bucket")[0].as_py() < 0:
            a, b = np.frombuffer(x, np.int64), np.frombuffer(b"".join(group.column("y").to_pylist()), np.int64)
            return pa.Table.from_batches([edges(*_pairs(a, b))])
        keys = np.frombuffer(x, np.uint64)
        ids = np.frombuffer(b"".join(group.column("y").to_pylist()), np.int64)
        _, a, b = _stars(keys, ids)
        return pa.Table.from_batches([edges(*_pairs(a, b))])

    emitted = reps.select("id", "bands").mapInArrow(emit, "bucket int, x binary, y binary")
    return emitted.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def full_sets(ids: DataFrame, docs: DataFrame, bands: Bands, key: str, text: str) -> DataFrame:
    """(id, set) of the documents with these ids: the one shuffle of texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*raw(batch.column(1)), bands.shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    return texts.mapInArrow(make, "id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ok.append(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), bands.percent))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a long, b long")


#: Documents of one key that are compared with each other, or with as many others, in one task.
BLOCK = 2048


def keys_of(labelled: DataFrame, bands: Bands) -> DataFrame:
    """(key, band, id, component) of every band of (id, component, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = spread(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64), bands).reshape(-1).view(np.int64)
            ids, of = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), bands.bands) for i in (0, 1))
            band = np.tile(np.arange(bands.bands, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (data, band, ids, of)], names=["key", "band", "id", "component"])

    return labelled.select("id", "component", "bands").mapInArrow(run, "key long, band int, id long, component long")


def tasks(rows: DataFrame) -> DataFrame:
    """(g, lo, hi, side, key, band, id): who meets whom under the keys that hold two components or more.

    Documents of one component never meet. A key's largest component is dealt to blocks of its own,
    which meet the blocks of the rest but not each other, so a large component with some
    others beside it travels once for each block of these. Blocks of the rest meet each other. Keys of up to
    BLOCK documents are one block, and many of them one group. side: 0 meets 1, 2 meets 2.
    """
    mixed = rows.groupBy("key").agg(F.min("component").alias("from"), F.max("component").alias("to")).filter("from < to").select("key")
    sizes = rows.join(mixed, "key").groupBy("key", "component").agg(F.count("*").alias("n"))  # partitioned by the key already
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("big"), F.sum("n").alias("many"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("key", F.col("big.component").alias("large"), blocks(F.col("big.n")).alias("nl"), blocks(F.col("many") - F.col("big.n")).alias("nr"), (F.col("many") > BLOCK).alias("split"))
    is_large = F.col("component") == F.col("large")
    rows = rows.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("id"), F.when(is_large, F.col("nl")).otherwise(F.col("nr"))).cast("int"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    meeting = lambda lo, hi, side: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), side.cast("int").alias("side"))
    b = F.col("b")
    of_rest = F.concat(
        each("nr", lambda j: meeting(F.least(b, j), F.greatest(b, j), F.when(b == j, 2).when(b < j, 0).otherwise(1))), each("nl", lambda j: meeting(b, -1 - j, F.lit(0)))
    )
    of_large = each("nr", lambda i: meeting(i, -1 - b, F.lit(1)))
    who = F.when(~F.col("split"), F.array(meeting(F.lit(0), F.lit(0), F.lit(2)))).when(is_large, of_large).otherwise(of_rest)
    g = F.when(F.col("split"), F.col("key")).otherwise(F.pmod(F.col("key"), F.lit(4 * partitions(rows.sparkSession))))
    return rows.select(g.alias("g"), F.inline(who), "key", "band", "id")


def _candidates(group: pa.Table, bands: Bands, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a task, in parts, that differ in component (of, which may change between the parts), share a key under the first band that both have, and are similar enough by size and signature.

    The signatures must agree nearly as often as the similarity makes them (4.5 standard deviations below;
    3 pairs in a million are missed at the limit, none in practice above).
    """
    total, s = bands.rows * bands.bands, bands.percent / 100
    chance = s + (1 - s) / 256
    least = total * chance - 4.5 * (total * chance * (1 - chance)) ** 0.5
    key, ids, n, band, side = (group.column(c).to_numpy() for c in ("key", "id", "n", "band", "side"))
    sig = np.frombuffer(b"".join(group.column("bands").to_pylist()), np.uint64).reshape(-1, bands.bands)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[i:j]
        left, right = rows[side[rows] != 1], rows[side[rows] != 0]
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            ok = of[part][:, None] != of[right][None, :]
            ok &= (side[part][:, None] != 2) | (ids[part][:, None] < ids[right][None, :])
            x, y = n[part][:, None], n[right][None, :]
            ok &= 100 * np.minimum(x, y) >= bands.percent * np.maximum(x, y)
            for earlier in range(int(band[rows[0]])):
                ok &= sig[part, earlier][:, None] != sig[right, earlier][None, :]
            a, b = np.nonzero(ok)
            for k in range(0, len(a), 4096):
                p, q = part[a[k : k + 4096]], right[b[k : k + 4096]]
                good = (sig[p].view(np.uint8) == sig[q].view(np.uint8)).sum(axis=1) >= least
                if good.any():
                    yield p[good], q[good]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * both >= percent * (len(x) + len(y) - both)


def remaining_links(reps: DataFrame, labels: DataFrame, sets: DataFrame, bands: Bands, scratch: Scratch) -> DataFrame:
    """(a, b): links between the components (labels: id, component) of documents that share a key, enough of them to join all that are linked.

    Tasks look at signatures first and say which documents they need; only these documents' full sets
    come to the tasks, which confirm pairs until they have joined what is linked. What leaves a task is its
    needs and its joining links, never pairs: as many rows as it has documents at most.
    """
    known = scratch.save(reps.join(labels, "id").select("id", "n", "component", "bands"), "known")
    rows = tasks(keys_of(known, bands))

    def needs(group: pa.Table) -> pa.Table:
        wanted = np.zeros(group.num_rows, bool)
        for a, b in _candidates(group, bands, group.column("component").to_numpy()):
            wanted[a] = wanted[b] = True
        return group.select(["g", "lo", "hi", "side", "key", "band", "id"]).filter(pa.array(wanted))

    schema = "g long, lo int, hi int, side int, key long, band int, id long"
    with_signature = rows.join(known.select("id", "n", "component", "bands"), "id").select("g", "lo", "hi", "side", "key", "band", "id", "n", "component", "bands")
    needed = scratch.save(with_signature.groupBy("g", "lo", "hi").applyInArrow(needs, schema), "needed")

    def confirm(group: pa.Table) -> pa.Table:
        ids, of = group.column("id").to_numpy(), np.array(group.column("component").to_numpy())
        full, out = group.column("set"), []
        for a, b in _candidates(group, bands, of):
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                if of[p] != of[q] and similar(np.frombuffer(full[p].as_py(), np.uint64), np.frombuffer(full[q].as_py(), np.uint64), bands.percent):
                    of[of == max(of[p], of[q])] = min(of[p], of[q])  # joined here: later pairs between them need no look
                    out.append((int(ids[p]), int(ids[q])))
        return pa.table({"a": pa.array([e[0] for e in out], pa.int64()), "b": pa.array([e[1] for e in out], pa.int64())})

    whole = needed.join(known.select("id", "n", "component", "bands"), "id").join(sets, "id").select("g", "lo", "hi", "side", "key", "band", "id", "n", "component", "bands", "set")
    return whole.groupBy("g", "lo", "hi").applyInArrow(confirm, "a long, b long")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that repeat an id with one set go once; those left in other batches do no harm, as no document is compared with itself."""
    for b in batches:
        keys = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("id", "k1", "k2")]
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        yield b.select(["id", "n", "bands"]).take(pa.array(np.sort(order[new])))


def near_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id and kept.

    Null and empty texts and texts without words have an empty set and link with nothing. Rows with a
    null key link with nothing, have a null component and are kept. Repeated keys are one document
    that holds the links of all its rows. Documents with equal sets are linked at once, by one
    aggregation, and only the smallest of them goes through the bands. Other columns are dropped, whatever
    their names. Long texts are hashed whole. An empty table gives an empty result.
    """
    rows = scratch.save(features(docs, bands, key, text), "features")
    full = rows.filter("n > 0 and id is not null")
    # Written first, so that nothing in the join's stage needs the rows of a key together and a very large class is split.
    classes = scratch.save(full.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")
    copies = scratch.save(full.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "rep"), "copies")
    reps = full.join(copies.filter("id = rep").select("id").distinct(), "id", "left_semi").mapInArrow(_once, "id long, n long, bands binary")
    reps = scratch.save(reps, "reps")
    entries = reps.count() * bands.bands
    buckets = 1 << max(4, (max(entries // 2_000_000, 2 * partitions(docs.sparkSession)) - 1).bit_length())
    stars = scratch.save(star_edges(reps, buckets, bands), "stars")
    ends = scratch.save(stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct(), "ends")
    sets = scratch.save(full_sets(ends, docs, bands, key, text), "sets")
    links = scratch.save(confirmed(stars, sets, bands), "links")
    part = components(links, scratch)
    labels = scratch.save(ends.join(part, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    more = scratch.save(remaining_links(reps, labels, sets, bands, scratch), "more")
    scratch.drop("classes", "reps", "stars", "ends", "sets", "labels", "known", "needed")
    same = copies.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    final = components(links.unionByName(more).unionByName(same), scratch)
    out = rows.select("id", "n").join(final, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, Scratch(spark, "minhash"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept: one of each group."""
    found = near_duplicates(docs, Scratch(spark, "minhash-stage"))
    kept = found.filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i : i + 4], 'string_agg', ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, sym.b FROM reach JOIN sym ON reach.r = sym.a),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""
