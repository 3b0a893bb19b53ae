"""Quality rules (operator 10): word and line counts, and bands of zstandard ratios.

A text is compressed whole and in fixed chunks. Text that says little compresses very well,
noise such as base64 or random characters hardly compresses; both leave the band that prose of
that length lies in. Short texts carry too little context for a ratio to mean much, so the limits
depend on the length, and texts under the shortest length are judged by the counts alone. Hex
digits compress as well as prose of less than 16 KB does, so only longer runs of them leave the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.functions import words as W
from lodework.llm.common import raw, slices

SYMBOL = np.zeros(256, np.uint8)
SYMBOL[list(b"#*$%&|<>")] = 1
#: Bytes that begin a code point and lie in a word.
LETTER = (~W.SEPARATOR & ((np.arange(256) & 0xC0) != 0x80)).astype(np.uint8)
BLANK = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits of raw bytes over compressed bytes, by length in bytes: (shortest length, least ratio, greatest ratio).

    The last row whose length a text reaches holds; shorter texts have no limits. The limits lie between
    prose (the least and greatest ratios of each language) and base64 cut into words or templated lines.
    `chunk` bytes make a chunk; `chunk_least` and `chunk_greatest` are the limits of a chunk's
    ratio, and a text is rejected when more than `chunk_share` of its full chunks pass them.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (256, 1.14, 2.6), (320, 1.2, 2.6), (384, 1.24, 2.7), (512, 1.31, 2.7), (768, 1.38, 2.8), (1024, 1.45, 3.0),
        (2048, 1.55, 3.2), (4096, 1.65, 3.3), (8192, 1.75, 3.4), (16384, 2.05, 3.4), (65536, 2.05, 3.6),
    )
    chunk: int = 4096
    chunk_least: float = 1.65
    chunk_greatest: float = 3.4
    chunk_share: float = 0.5
    level: int = 1

    def limits(self, n: int) -> tuple[float, float]:
        found = (0.0, float("inf"))
        for at, least, greatest in self.whole:
            if n >= at:
                found = (least, greatest)
        return found


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long, reason string"


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def repeated_words(hashes: np.ndarray, first: np.ndarray, k: int = 3) -> np.ndarray:
    """Per text, the words that lie in a window of k words found twice or more in that text."""
    where = np.flatnonzero(W.inside(first, k))
    keys = W.mix(W.windows(hashes, k)[where] ^ W.mix(W.text_of(first)[where].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for j in range(k):
        covered[where[twice] + j] = True
    return _per_text(covered, first)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def _judge(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, str]:
    if not text:
        return 0.0, 0, 0, ""
    ratio = len(text) / len(packer.compress(text))
    full = len(text) // bands.chunk
    low = high = 0
    for i in range(full):
        r = bands.chunk / len(packer.compress(text[i * bands.chunk : (i + 1) * bands.chunk]))
        low, high = low + (r < bands.chunk_least), high + (r > bands.chunk_greatest)
    least, greatest = bands.limits(len(text))
    if ratio > greatest or high > bands.chunk_share * full > 0:
        return ratio, low + high, full, "repetitive"
    if ratio < least or low > bands.chunk_share * full > 0:
        return ratio, low + high, full, "incompressible"
    return ratio, low + high, full, ""


def quality_rules(docs: DataFrame, text: str = "text", bands: Bands = Bands(), min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Each row of docs with the columns of SCHEMA; no shuffle, memory bounded by one batch.

    Null texts count as empty: no words, so base_failed. Repeated rows are judged one by one.
    A column of docs that has the name of a result is replaced by the result.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    keep = [c for c in docs.columns if c == text or c not in names]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = raw(column)
            starts, ends, first = W.words(data, offsets)
            n = np.diff(first)
            repeat = repeated_words(W.word_hashes(data, starts, ends), first)
            failed = (n < min_words) | (100 * repeat > max_repeat_percent * n)
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            said = [_judge(t, bands, packer) for t in texts]
            reason = [("words" if n[i] < min_words else "repeats") if failed[i] else said[i][3] for i in range(len(texts))]
            out = [n, _per_text(LETTER[data], offsets), _per_text(SYMBOL[data], offsets), [_dup_lines(t) for t in texts], repeat, failed, [not x for x in reason], [x[0] for x in said], [x[1] for x in said], [x[2] for x in said], reason]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            kept = [x.cast(pa.string()) if pa.types.is_large_string(x.type) else x for x in kept]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=keep + names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [SCHEMA])
    return docs.select(*keep).mapInArrow(judge, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, unchanged."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"))  # whatever the columns are called
    return quality_rules(packed, text="__text").filter("kept").select("__row.*")
