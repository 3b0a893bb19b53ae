"""Token-ID output (operator 1): directly addressable codes.

Ids are cut into 8-bit chunks, the lowest first. Level 0 holds the first chunk of every id;
a bitmap beside it says which ids go on; level 1 holds the second chunk of those, and so on.
A rank directory over each bitmap finds the place of an id's next chunk, so any token of a
shard is read with a few array accesses and no block is ever decoded.

Files. The Spark writer stores rows (part, seq, start_in_part, n_docs, n_tokens, payload) as
Parquet, in the order of the keys; a payload is one self-contained shard and can be stored as a
plain file (`Shard.open`). Parts follow each other in key order; so do the shards of a part.
"""

from __future__ import annotations

import functools
import json
import os
import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodework.llm.common import Scratch, slices

MAGIC = b"LWDAC1\0\0"
#: Tokens after which a shard is closed; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 20
#: One entry of a rank directory covers so many bits.
RANK_BITS = 512
#: Pieces of text whose ids a worker keeps.
CACHE_PIECES = 600_000
#: Pieces with one of these go through the library with their whole text.
ODD = r"[\s\u180e\u200b\ufeff\0]"


class Encoder:
    """Whole texts to ids with the tokenizers library.

    Byte-level BPE never merges across its pre-tokens, and a single blank or newline between two
    words always begins one. So a text is split there, and the ids of known pieces come from a
    bounded cache. An unknown word of letters, which is one pre-token, goes to the library's
    model, any other unknown piece to its encoder. Any other kind of tokenizer, and any text with
    other white space or special tokens, goes through the library whole.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and pre.get("use_regex", True)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.odd = re.compile("|".join([ODD, *added])).search
        self.most, self.cache = cache_pieces, {}
        if self.byte_level:
            self.model, self.newline = self.lib.model, self._whole(["\n"])[0]
            # The byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 and up.
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [i for i in range(256) if i not in set(printable)]
            self.letters = {**{i: chr(i) for i in printable}, **{i: chr(256 + n) for n, i in enumerate(rest)}}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """The ids of one pre-token."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _piece(self, piece: str) -> bytes | None:
        """The ids of a piece: as it stands after a blank, with its newline, or, after \0, at the beginning of a text. None if it is odd."""
        if piece.isalpha():
            return self._word(" " + piece)
        stem = piece.rstrip(string.punctuation)
        if stem.isalpha():
            tail = piece[len(stem) :]
            ids, marks = self.cache.get(stem), self.cache.get("\1" + tail)
            if ids is None:
                ids = self.cache[stem] = self._word(" " + stem)
            if marks is None:
                marks = self.cache["\1" + tail] = self._word(tail)
            return ids + marks
        head, word = piece[:1], piece[1:]
        if head not in ("\n", "\0"):
            return None if not piece or self.odd(piece) else self._whole([" " + piece])[0]
        if not word or self.odd(word):
            return None
        ids = self._word(word) if word.isalpha() else self._whole([word])[0]
        return self.newline + ids if head == "\n" else ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text the ids as little-endian unsigned 32-bit integers."""
        if not self.byte_level:
            return [x for k in range(0, len(texts), 64) for x in self._whole(texts[k : k + 64])]
        if len(self.cache) > self.most:
            self.cache.clear()
        cache, get, out, rest = self.cache, self.cache.get, [b""] * len(texts), []
        for i, t in enumerate(texts):
            if not t:
                continue
            if "\0" in t or "\1" in t:  # the marks of the cache
                rest.append(i)
                continue
            pieces = ("\0" + t.replace("\n", " \n")).split(" ")
            got = list(map(get, pieces))
            if None in got:
                at = -1
                try:
                    while True:
                        at = got.index(None, at + 1)
                        ids = get(pieces[at])
                        if ids is None:
                            ids = self._piece(pieces[at])
                            if ids is None:
                                rest.append(i)
                                break
                            cache[pieces[at]] = ids
                        got[at] = ids
                except ValueError:
                    out[i] = b"".join(got)
            else:
                out[i] = b"".join(got)
        for k in range(0, len(rest), 64):
            for i, ids in zip(rest[k : k + 64], self._whole([texts[i] for i in rest[k : k + 64]]), strict=True):
                out[i] = ids
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps it, and its cache, from task to task."""
    return Encoder(path)


def _bitmap(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits, and the number of ones before each RANK_BITS of them."""
    packed = np.packbits(bits, bitorder="little")
    ones = np.add.reduceat(bits, np.arange(0, len(bits), RANK_BITS), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
    return packed, np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)[:-1]]) if len(ones) else ones


def encode_shard(keys: list, ends: list[int], ids: np.ndarray) -> bytes:
    """A shard of documents with these keys (integers or None) that end at these tokens."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        packed, ranks = _bitmap(more)
        levels.append(struct.pack("<QQQ", len(rest), len(packed), len(ranks)) + (rest & 0xFF).astype(np.uint8).tobytes() + packed.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    known = np.array([k is not None for k in keys], np.uint8)
    head = struct.pack("<8sQQQ", MAGIC, len(keys), len(ids), len(levels))
    return head + known.tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(ends, "<u8").tobytes() + b"".join(levels)


class Shard:
    """Reads a shard; `shard[i]` is any token, in time that does not depend on the shard's size."""

    def __init__(self, data):
        magic, n_docs, self.n_tokens, n_levels = struct.unpack_from("<8sQQQ", data, 0)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = 32

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known, keys = take(np.uint8, n_docs), take("<i8", n_docs)
        self.keys = [int(k) if ok else None for k, ok in zip(keys, known, strict=True)]
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n, n_packed, n_ranks = struct.unpack_from("<QQQ", data, at)
            at += 24
            self.levels.append((take(np.uint8, n), take(np.uint8, n_packed), take("<u4", n_ranks)))

    @classmethod
    def open(cls, path: str | Path) -> Shard:
        return cls(np.memmap(path, np.uint8, "r"))

    def __len__(self) -> int:
        return self.n_tokens

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for shift, (chunks, packed, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * shift)
            byte, bit = i >> 3, i & 7
            if not packed[byte] >> bit & 1:
                break
            first = (i // RANK_BITS) * RANK_BITS >> 3
            i = int(ranks[i // RANK_BITS]) + int(np.bitwise_count(packed[first:byte]).sum()) + int(packed[byte] & ((1 << bit) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All tokens, level by level."""
        out = self.levels[0][0].astype(np.uint32)
        where = np.arange(self.n_tokens)
        for shift in range(1, len(self.levels)):
            _, packed, _ = self.levels[shift - 1]
            where = where[np.unpackbits(packed, count=len(where), bitorder="little").view(bool)]
            out[where] |= self.levels[shift][0].astype(np.uint32) << np.uint32(8 * shift)
        return out


SHARDS = "part int, seq int, start_in_part long, n_docs long, n_tokens long, payload binary"


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shards of all rows in ascending order of the key (nulls first, equal keys by text).

    One shuffle, of the texts, by ranges of (key, hash of the text): rows that share one key don't
    gather in one task. Null and empty texts have the end id alone; texts of any length are encoded whole.
    Repeated rows are encoded one by one. Other columns are dropped, whatever their names. An empty table gives
    no shards. tokenizer is a file's path that every executor can read.
    """
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = ordered.withColumn("h", F.xxhash64("text")).repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text").select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        keys, ends, data, n, seq, start = [], [], [], 0, 0, 0

        def close():
            nonlocal keys, ends, data, n, seq, start
            payload = encode_shard(keys, ends, np.frombuffer(b"".join(data), "<u4"))
            row = [[part], [seq], [start], [len(keys)], [n], [payload]]
            seq, start = seq + 1, start + n
            keys, ends, data, n = [], [], [], 0
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "seq", "start_in_part", "n_docs", "n_tokens", "payload"])

        for batch in slices(batches):
            for k, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                data += [ids, end]
                n += (len(ids) + len(end)) // 4
                keys.append(k)
                ends.append(n)
                if n >= shard_tokens:
                    yield close()
        if keys:
            yield close()

    return ordered.mapInArrow(write, SHARDS)


def with_starts(shards: DataFrame) -> DataFrame:
    """Shards with the number of tokens before them. The totals that are summed and broadcast are one row a part, of which there are as many as write tasks."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return shards.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def read_documents(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document of the shards: key, start, n_tokens and the crc32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(payload.as_buffer())
                data = memoryview(shard.ids().astype("<u4").tobytes())
                begins = np.concatenate([[0], shard.ends[:-1]])
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), shard.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, pa.int64()), pa.array(start + begins), pa.array(shard.ends - begins), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return with_starts(shards).select("start", "payload").mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(Scratch(spark, "token-ids").save(encode_documents(docs, default_tokenizer()), "shards"))
