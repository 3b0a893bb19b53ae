"""Language identification (operator 9): the zstandard dictionary that compresses a text best.

Each language has one raw-content dictionary, cut from a bounded sample of texts of that
language. A text is compressed with each of them; repeated wording of its own language makes
the right one smallest. Differences of a few bytes say nothing, so a margin is reported and
rows under it are not accepted.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.llm.common import Scratch, bounded_sample, chosen, with_columns

#: Bounds of what is fitted on: texts a language, bytes of them, and characters of each language's dictionary, which is cut from them.
SAMPLE_TEXTS, SAMPLE_BYTES, DICTIONARY_CHARS = 600, 4 << 20, 100_000
#: zstandard's level, for texts of every length.
LEVEL = 12
#: Narrower than this (bytes saved over the second best, as a share of the best) is not accepted.
MARGIN = 0.02


@dataclass
class LanguageModel:
    dictionaries: dict[str, bytes]
    margin: float = MARGIN
    level: int = LEVEL

    def packers(self) -> dict[str, zstandard.ZstdCompressor]:
        made = {}
        for lang, data in sorted(self.dictionaries.items()):
            shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=self.level)
            made[lang] = zstandard.ZstdCompressor(dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
        return made


def normal(text: str) -> str:
    """Lower-case words of letters, joined by one space: marks, digits and layout say little of a language."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES, chars: int = DICTIONARY_CHARS, seed: str = "language") -> LanguageModel:
    """Dictionaries from at most sample_texts whole texts a language, those of the smallest hashes of the key.

    The dictionary holds the pairs of words and the words that most texts of the sample share
    last, where zstandard reaches them at least cost, and whole sample texts before them.
    Rows with null text, key or label are left out; repeated rows of a key count once.
    """
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    sample = bounded_sample(chosen(rows, "lang", "key", sample_texts, seed)[0], "lang", "key", "text", sample_texts, sample_bytes, Scratch(docs.sparkSession, "language"))
    return LanguageModel({lang: _dictionary([normal(t) for _, t in x], chars) for lang, x in sample.items()})


def _dictionary(texts: list[str], chars: int) -> bytes:
    """Passages, then words, then pairs of words, the most shared at the end."""
    seen, pairs = Counter(), Counter()
    for t in texts:
        w = t.split()
        seen.update(set(w))
        pairs.update(set(zip(w, w[1:], strict=False)))
    share, out, used = chars // 4, [], 0
    ranked = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1] * len(x[0]), x[0]))]
    pair_text = [" ".join(p) for p, n in sorted(pairs.items(), key=lambda x: (-x[1] * len(x[0][0] + x[0][1]), x[0])) if n > 1]
    for group in (ranked, pair_text):
        part, size = [], 0
        for w in group:
            if size > share:
                break
            part.append(w)
            size += len(w) + 1
        out.append(" ".join(reversed(part)))
        used += size
    rest, size = [], 0
    for t in texts:
        if size > chars - used:
            break
        rest.append(t)
        size += len(t)
    return " ".join([*rest, *out, ""]).encode()


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred, score and accepted for every row; no shuffle.

    Null texts and texts without a letter are `und` with score 0. Ties go to the first language
    by name. With no dictionary (nothing to learn from) every row is `und`. Texts of any length are compressed
    whole, at one level. Repeated rows are judged one by one; a column that has the name of a result is
    replaced, other columns stay. An empty table gives an empty result.
    """

    def begin():
        packers = model.packers()

        def one(t):
            if not model.dictionaries or not any(c.isalpha() for c in t):
                return "und", 0.0, False
            data = normal(t).encode()
            sizes = sorted((len(p.compress(data)), lang) for lang, p in packers.items())
            gap = (sizes[1][0] - sizes[0][0]) / max(1, sizes[0][0]) if len(sizes) > 1 else 1.0
            weights = [math.exp(-50.0 * (s - sizes[0][0]) / max(1, sizes[0][0])) for s, _ in sizes]
            return sizes[0][1], 1.0 / sum(weights), gap >= model.margin

        return lambda texts: list(zip(*map(one, texts), strict=True)) if texts else [[], [], []]

    return with_columns(docs, text, {"lang_pred": pa.string(), "score": pa.float64(), "accepted": pa.bool_()}, begin)


def remainder(key: str, n: int):
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % n


def crc(key) -> int:
    return zlib.crc32(str(key).encode())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = fit(docs.filter(~held).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
