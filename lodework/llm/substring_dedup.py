"""Substring dedup (operator 2): fixed-block anchors, rolling probes, extension to whole repeats.

Non-overlapping blocks of `block` words of every document are the index. Every rolling window of
as many words probes it. A window of `window` >= 2 * block - 1 words holds a whole block of
the document it is compared with, so both places of every repeat that matters contain a word
position whose hash is an anchor of one document and occurs in another: a hit. Hits are then
extended: all windows of `window` words around a hit are hashed with 128 bits, the first
document of each is found, and the windows that an earlier document holds are joined to the
maximal runs that they cover.

Documents are kept in packs of a few MB, in the order of their ids. A pack sends each hash once,
as five bytes, to the task of its range, whatever number of its documents share it; a
passage that most documents hold brings one entry a pack. Since packs are ordered, the smallest pack
of a hash says which document is first, and within a pack its own rows do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.functions import words as W
from lodework.llm.common import Scratch, partitions, raw, slices

#: Bytes of text after which a pack is closed, at the next change of the id.
PACK_BYTES = 4 << 20
#: Entries that meet in one task.
ENTRIES = 2_000_000
SECOND_BASE = 0xA0761D6478BD642F


def pack_documents(docs: DataFrame, key: str, text: str, pack_bytes: int) -> DataFrame:
    """(pack, n_words, ids, ends, texts) in ascending order of the key. Rows of one key share a pack."""
    ordered = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("id is not null").repartitionByRange("id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, seq = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def close():
            nonlocal ids, texts, size, seq
            ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
            data = b"".join(texts)
            n = len(W.words(np.frombuffer(data, np.uint8), np.concatenate([[0], ends]))[0])
            row = ((part << 32) + seq, n, np.array(ids, np.int64).tobytes(), ends.tobytes(), packer.compress(data))
            ids, texts, size, seq = [], [], 0, seq + 1
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["pack", "n_words", "ids", "ends", "texts"])

        for batch in slices(batches):
            data, offsets = raw(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                if size >= pack_bytes and doc != ids[-1]:
                    yield close()
                ids.append(doc)
                texts.append(data[offsets[i] : offsets[i + 1]].tobytes())
                size += len(texts[-1])
        if ids:
            yield close()

    return ordered.mapInArrow(run, "pack long, n_words long, ids binary, ends binary, texts binary")


class Pack:
    """Words and hashes of one pack."""

    def __init__(self, ids: bytes, ends: bytes, texts: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(texts) if texts else b""
        self.offsets = np.concatenate([[0], np.frombuffer(ends, np.int64)])
        data = np.frombuffer(self.data, np.uint8)
        starts, stops, self.first = W.words(data, self.offsets)
        self.hashes = W.word_hashes(data, starts, stops)
        self.of = W.text_of(self.first)
        #: Rows of one id have one rank.
        self.rank = np.concatenate([[0], np.cumsum(np.diff(self.ids) != 0)]) if len(self.ids) else self.ids
        self.long = np.diff(self.first)

    def windows(self, k: int, least: int) -> np.ndarray:
        """Word positions that begin a window of k words in a text of `least` words or more."""
        at = np.flatnonzero(W.inside(self.first, k))
        return at[self.long[self.of[at]] >= least]


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _five(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def probes(packs: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """Per pack and range of hashes: the distinct hashes of its rolling windows, and which of them are anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, ends, texts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                p = Pack(ids, ends, texts)
                at = p.windows(block, window)
                if not len(at):
                    continue
                h = W.windows(p.hashes, block)[at] >> np.uint64(24 - bits)
                anchor = (at - p.first[p.of[at]]) % block == 0
                order = np.argsort(h)
                begin = _groups(h[order])
                keys, flags = h[order][begin], np.logical_or.reduceat(anchor[order], begin)
                bucket = (keys >> np.uint64(40)).astype(np.int64)
                cuts = np.append(_groups(bucket), len(keys))
                rows = [(int(bucket[i]), number, _five(keys[i:j]), np.packbits(flags[i:j]).tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "pack", "keys", "flags"])

    return packs.select("pack", "ids", "ends", "texts").mapInArrow(run, "bucket int, pack long, keys binary, flags binary")


def _by_pack(bucket: int, packs: np.ndarray, keys: np.ndarray, write) -> pa.Table:
    order = np.argsort(packs, kind="stable")
    cuts = np.append(_groups(packs[order]), len(order))
    rows = [(int(packs[order[i]]), bucket, write(keys[order[i:j]])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"pack": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "keys": pa.array([r[2] for r in rows], pa.binary())})


def hits(probed: DataFrame) -> DataFrame:
    """(pack, bucket, keys): the hashes of each pack that are an anchor of an earlier pack, or its own anchors that a later pack has."""

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("pack")
        blobs = group.column("keys").to_pylist()
        keys = _from_five(b"".join(blobs))
        sizes = [len(b) // 5 for b in blobs]
        packs = np.repeat(group.column("pack").to_numpy(), sizes)
        anchor = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(group.column("flags").to_pylist(), sizes, strict=True)]).view(bool)
        order = np.argsort(keys, kind="stable")
        begin = _groups(keys[order])
        counts = np.diff(np.append(begin, len(keys)))
        far = np.iinfo(np.int64).max
        first = np.repeat(np.minimum.reduceat(np.where(anchor, packs, far)[order], begin), counts)
        last = np.repeat(np.maximum.reduceat(packs[order], begin), counts)
        mine = packs[order]
        active = order[(first < mine) | ((first == mine) & (last > mine))]
        return _by_pack(group.column("bucket")[0].as_py(), packs[active], keys[active], _five)

    return probed.groupBy("bucket").applyInArrow(meet, "pack long, bucket int, keys binary")


def _collected(packs: DataFrame, found: DataFrame) -> DataFrame:
    """Each pack with what was found for it: at most its own hashes."""
    per_pack = found.groupBy("pack").agg(F.collect_list(F.struct("bucket", "keys")).alias("found"))
    return packs.select("pack", "ids", "ends", "texts").join(per_pack, "pack", "left").select("pack", "ids", "ends", "texts", F.col("found.bucket").alias("buckets"), F.col("found.keys").alias("keys"))


def _first_rows(p: Pack, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of windows by hash, and for each of them, in that order, the first of its run of equal ones."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, bool)
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order


def extended(joined: DataFrame, window: int, block: int, bits: int, out_bits: int) -> DataFrame:
    """Per pack and range: the distinct 128-bit hashes of its windows that contain a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, ends, texts, buckets, blobs in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                p = Pack(ids, ends, texts)
                at = p.windows(block, window)
                if not len(at):
                    continue
                h = W.windows(p.hashes, block)[at] >> np.uint64(24 - bits)
                known = np.sort(np.concatenate([_from_five(k) | np.uint64(b << 40) for b, k in zip(buckets, blobs, strict=True)])) if buckets else np.zeros(0, np.uint64)
                hit = np.zeros(len(p.hashes) + 1, np.int64)
                if len(known):
                    hit[at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]] = 1
                where = p.windows(window, window)
                sums = np.concatenate([[0], np.cumsum(hit)])
                where = where[sums[where + window - block + 1] > sums[where]]
                if not len(where):
                    continue
                h1, h2 = W.windows(p.hashes, window)[where], W.windows(p.hashes, window, SECOND_BASE)[where]
                order, first = _first_rows(p, h1, h2)
                own = order[first == np.arange(len(order))]
                h1, h2 = h1[own], h2[own]
                bucket = (h1 >> np.uint64(64 - out_bits)).astype(np.int64)
                cuts = np.append(_groups(bucket), len(own))
                rows = [(int(bucket[i]), number, np.stack([h1[i:j], h2[i:j]], 1).tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "pack", "keys"])

    return joined.mapInArrow(run, "bucket int, pack long, keys binary")


def repeats(windows: DataFrame) -> DataFrame:
    """(pack, bucket, keys): the windows of each pack that an earlier pack has."""

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("pack")
        blobs = group.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
        packs = np.repeat(group.column("pack").to_numpy(), [len(b) // 16 for b in blobs])
        order = np.lexsort((keys[:, 1], keys[:, 0]))  # stable: packs ascend within equal keys
        a, b = keys[order, 0], keys[order, 1]
        again = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        later = order[again]
        return _by_pack(group.column("bucket")[0].as_py(), packs[later], keys[later], lambda x: x.tobytes())

    return windows.groupBy("bucket").applyInArrow(meet, "pack long, bucket int, keys binary")


def _covered(p: Pack, window: int, blobs: list[bytes]) -> np.ndarray:
    """Which words are removed."""
    where = p.windows(window, window)
    marks = np.zeros(len(p.hashes) + 1, np.int64)
    if len(where):
        h1, h2 = W.windows(p.hashes, window)[where], W.windows(p.hashes, window, SECOND_BASE)[where]
        order, first = _first_rows(p, h1, h2)
        rank = p.rank[p.of[where]]
        # Within a run of equal windows, rows of the pack are in the order of their ranks.
        again = np.zeros(len(where), bool)
        again[order] = rank[order] > rank[order[first]]
        if blobs:
            known = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
            known = known[np.argsort(known[:, 0], kind="stable")]
            at = np.minimum(np.searchsorted(known[:, 0], h1), len(known) - 1)
            same = known[at, 0] == h1
            again |= same & (known[at, 1] == h2)
            for i in np.flatnonzero(same & (known[at, 1] != h2)):  # two windows with one first half
                j = at[i]
                while j < len(known) and known[j, 0] == h1[i]:
                    again[i] |= known[j, 1] == h2[i]
                    j += 1
        at = where[again]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + window, -1)
    return np.cumsum(marks)[:-1] > 0


def kept_words(joined: DataFrame, window: int, key: str, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ends, texts, blobs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5)), strict=True):
                p = Pack(ids, ends, texts)
                gone = _covered(p, window, blobs or [])
                out = ([], [], [], [])
                for i in range(len(p.ids)):
                    a, b = p.first[i], p.first[i + 1]
                    found, mask = p.data[p.offsets[i] : p.offsets[i + 1]].split(), gone[a:b]
                    n = int(mask.sum())
                    text = b" ".join(compress(found, (~mask).tolist()) if n else found)
                    for column, x in zip(out, (len(found), n, hashlib.sha256(text).hexdigest(), text.decode() if with_text else None), strict=True):
                        column.append(x)
                made = [pa.array(p.ids), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())] + ([pa.array(out[3], pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(made, names=[key, "n_words", "n_removed", "kept_sha256"] + (["kept_text"] if with_text else []))

    return joined.mapInArrow(run, f"`{key}` long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))


def substring_dedup(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", window: int = 50, block: int | None = None, with_text: bool = False, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256 and, if asked, the kept words as text.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller
    key, all judged on the input. Null and empty texts have no words. Rows with a null key are
    nobody's smaller document and lose nothing. Rows of one key never remove from each other. Texts of any
    length are taken whole. Other columns are dropped, whatever their names. An empty table gives an empty result.
    """
    block = block or (window + 1) // 2
    packs = scratch.save(pack_documents(docs, key, text, pack_bytes), "packs")
    total = packs.agg(F.sum("n_words")).first()[0] or 0
    least = max(16, 2 * partitions(docs.sparkSession))
    bits = min(24, (max(total // ENTRIES, least) - 1).bit_length())
    found = scratch.save(hits(probes(packs, window, block, bits)), "hits")
    # Packs without a hit in another pack can still repeat within themselves; kept_words sees to that.
    windows = extended(_collected(packs, found), window, block, bits, bits)
    again = scratch.save(repeats(windows), "repeats")
    scratch.drop("hits")
    out = kept_words(_collected(packs, again), window, key, with_text)
    rest = docs.filter(F.col(key).isNull()).select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.concat_ws(" ", split)
    rest = rest.select(key, F.size(split).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"), *([kept.alias("kept_text")] if with_text else []))
    return out.unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, Scratch(spark, "substrings"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, list_aggregate(ws[i : i + 49], 'string_agg', ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT win, min(doc_id) AS first_doc FROM s GROUP BY win),
d AS (SELECT DISTINCT s.doc_id, s.i + j.j AS pos FROM s JOIN f USING (win), (SELECT unnest(range(0, 50)) AS j) j WHERE f.first_doc < s.doc_id),
g AS (SELECT doc_id, list(pos) AS gone FROM d GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(coalesce(list_aggregate(CASE WHEN gone IS NULL THEN ws ELSE list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE ws[i] END), lambda x: x IS NOT NULL) END, 'string_agg', ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
