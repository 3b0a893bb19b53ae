"""SentencePiece encoding and decoding (operator 3): a streaming Viterbi pass over the pieces.

The lattice keeps only a window of the text. A future piece can begin at one of the last
`longest` positions alone; as soon as the backpointer paths of all of these run through one
boundary, everything before it is settled: its ids are committed and the text is dropped.

Unigram models: the path of the greatest sum of scores. BPE models rank merges, and their
greatest sum is in general another segmentation than the merges give, so there the path is
kept to pairs of neighbours that the merges themselves would leave side by side; exactly one
predecessor of every position qualifies, and the ids are those of the library's encoder.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodework.llm.common import with_columns

SPACE = "▁"
#: Bytes of the words and of the beginnings of words that a worker remembers, with ENTRY for a place in a dict, and pairs of neighbouring pieces.
CACHE_WORDS, CACHE_HEADS, CACHE_PAIRS = 96_000_000, 48_000_000, 150_000
ENTRY = 80
#: The share of them in a stage of a pipeline, where each of an executor's workers keeps them beside what other stages have left.
STAGE_CACHE = 0.25
#: Lengths of beginnings of words whose part of the lattice is remembered, as many words share them.
HEADS = (10, 8, 6, 4)
UNIGRAM, BPE = 1, 2
#: The library's distance of an unknown character's score below the least score.
UNKNOWN_PENALTY = 10.0


def _model_type(proto: bytes) -> int:
    """trainer_spec (field 2) . model_type (field 3) of a serialized model; unigram where it is absent."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        i = 0

        def varint() -> int:
            nonlocal i
            value = shift = 0
            while True:
                b = data[i]
                i += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while i < len(data):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            elif tag & 7 == 2:
                n = varint()
                yield tag >> 3, data[i : i + n]
                i += n
            else:
                i += 8 if tag & 7 == 1 else 4

    for field, value in fields(proto):
        if field == 2 and isinstance(value, bytes):
            return next((int(v) for f, v in fields(value) if f == 3 and isinstance(v, int)), UNIGRAM)
    return UNIGRAM


class Pieces:
    """A model's vocabulary; encode() and decode() of whole texts."""

    def __init__(self, path: str | None = None, proto: bytes | None = None, cache: float = 1.0):
        """cache: times the usual sizes of the caches, which are CACHE_WORDS and CACHE_HEADS bytes and what CACHE_PAIRS take."""
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto) if proto else sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        special = [self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i) for i in range(n)]
        byte = [self.lib.is_byte(i) for i in range(n)]
        names = [self.lib.id_to_piece(i) for i in range(n)]
        self.kind = _model_type(self.lib.serialized_model_proto())
        self.id = {p: i for i, p in enumerate(names) if not special[i] and not byte[i]}
        self.own = {p: p for p in self.id}  # caches hold these strings, never copies of them
        self.score = {p: self.lib.get_score(i) for p, i in self.id.items()}
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if byte[i]}
        self.unknown_id = self.lib.unk_id()
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.id), default=1)
        self.table = [b"" if self.lib.is_control(i) else bytes([int(names[i][3:5], 16)]) if byte[i] else b" \xe2\x81\x87 " if i == self.unknown_id else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.starts_with_blank = self.lib.normalize("a").startswith(SPACE)
        #: Where no piece has a blank after another character, a blank after one is a boundary of every path.
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if not any(SPACE in p.lstrip(SPACE) for p in self.id) else lambda t: [t]
        self.most_words, self.most_heads, self.most_pairs = (int(cache * n) for n in (CACHE_WORDS, CACHE_HEADS, CACHE_PAIRS))
        self.word_bytes = self.head_bytes = 0
        self.words, self.older, self.pairs, self.spines, self.whole, self.heads = {}, {}, {}, {}, {}, {}
        #: Lengths of the pieces that end in two given characters, the longest first; shorter ones are tried always.
        ends: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        #: Neighbouring characters that some piece holds; between any others lies a boundary of every path.
        self.joints = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.lengths = {e: (*sorted(n, reverse=True), 1) for e, n in ends.items()}

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """The parts that lie at one end of a piece while it is merged, the smallest first, each with the score of the merge that takes it up."""
        known = self.spines.get((piece, right))
        if known is None:
            parts, known = list(piece), [(piece[-1] if right else piece[0], 0.0)]
            while len(parts) > 1:
                best, at = max(((self.score.get(parts[i] + parts[i + 1], -math.inf), -i) for i in range(len(parts) - 1)))
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                end = parts[-1] if right else parts[0]
                if end != known[-1][0]:
                    known[-1] = (known[-1][0], best)
                    known.append((end, 0.0))
            known[-1] = (known[-1][0], -math.inf)
            self.spines[piece, right] = known
        return known

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b, each of them a result of its own merges, side by side.

        They don't if two parts that ever face each other there make a piece that comes before the merges
        that take these parts up; of equal merges the left one comes first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            left, right, i, j, known = self._spine(a, True), self._spine(b, False), 0, 0, True
            while True:
                (x, up), (y, down) = left[i], right[j]
                crossing = self.score.get(x + y)
                if crossing is not None and crossing > up and crossing >= down:
                    known = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    break
                if up >= down:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = known
        return known

    def ids_of(self, path: Iterable[str]) -> list[int]:
        out, unknown = [], False
        for p in path:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in p.encode()]
            elif not unknown:
                out.append(self.unknown_id)
            unknown = i is None
        return out

    def normalize(self, text: str) -> str:
        return self.lib.normalize(text)

    def alone(self, piece: str) -> bool:
        """Whether the merges make a piece of its own text."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = len(self.merged(piece)) == 1
        return known

    def _remember(self, word: str, ids: bytes) -> None:
        """Two generations of at most half of the bytes each: words in use outlive a change."""
        if len(word) > 64:
            return
        size = getsizeof(word) + getsizeof(ids) + ENTRY
        if self.word_bytes + size > self.most_words // 2:
            self.words, self.older, self.word_bytes = {}, self.words, 0
        self.words[word] = ids
        self.word_bytes += size

    def _word(self, word: str) -> bytes:
        if word[1:].isalpha():
            return self.lattice.whole(word)
        joints, begin, out = self.joints, 0, []
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in joints:
                part = word[begin:i]
                ids = self.words.get(part) or self.older.get(part)
                if ids is None:
                    ids = self.lattice.whole(part)
                if part not in self.words:
                    self._remember(part, ids)
                out.append(ids)
                begin = i
        return b"".join(out)

    @functools.cached_property
    def lattice(self) -> Lattice:
        return Lattice(self)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. Between boundaries that every path shares, words come from the cache."""
        words = self.cut(self.normalize(text))
        got = list(map(self.words.get, words))
        at = -1
        for _ in range(got.count(None)):
            at = got.index(None, at + 1)
            word = words[at]
            got[at] = ids = self.words.get(word) or self.older.get(word) or self._word(word)
            if word not in self.words:
                self._remember(word, ids)
        return b"".join(got)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.starts_with_blank and text.startswith(" ") else text


@functools.cache
def pieces_of(path: str, cache: float = 1.0) -> Pieces:
    """One for each worker process, which keeps it, and its caches, from task to task."""
    return Pieces(path, cache=cache)


class Lattice:
    """The window of one stream: feed() returns the ids that new text settles, close() the rest.

    whole() feeds a text of any length in parts of four times the longest piece, so the window holds one part and
    what the paths of the last positions don't agree on yet.
    """

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self._reset()

    def _reset(self) -> None:
        self.text, self.piece, self.total = "", [""], [0.0]

    def _merges(self) -> None:
        """The last piece of each prefix: the merges of a prefix end in exactly one of the pieces that end there."""
        p, text, piece = self.p, self.text, self.piece
        own, pairs, lengths = p.own.get, p.pairs, p.lengths
        fresh = len(piece) == 1 and not self.before
        if fresh:
            for n in HEADS:
                if len(text) >= n:
                    known = p.heads.get(text[:n])
                    if known is not None:
                        piece.extend(known)
                        break
        had = len(piece) - 1
        for i in range(len(piece), len(text) + 1):
            found = text[i - 1]
            for n in lengths.get(text[i - 2 : i], (1,)) if i > 1 else (1,):
                if n > i:
                    continue
                s = own(text[i - n : i])
                if s is None:
                    continue
                before = piece[i - n] or self.before
                if before:
                    ok = pairs.get((before, s))
                    if ok is None:
                        ok = p.neighbours(before, s)
                else:
                    ok = p.alone(s)
                if ok:
                    found = s
                    break
            piece.append(found)
        if fresh and len(text) <= 64:
            for n in HEADS:
                if had < n <= len(text):
                    head, parts = text[:n], piece[1 : n + 1]
                    size = getsizeof(head) + getsizeof(parts) + ENTRY
                    if p.head_bytes + size > p.most_heads:
                        p.heads.clear()
                        p.head_bytes = 0
                    p.heads[head] = parts
                    p.head_bytes += size

    def _scores(self) -> None:
        """The last piece of the best path to each position."""
        p, text = self.p, self.text
        for i in range(len(self.piece), len(text) + 1):
            best, found = None, text[i - 1]
            for n in range(min(p.longest, i), 0, -1):
                s = text[i - n : i]
                score = p.score.get(s)
                if score is None:
                    if n > 1:
                        continue
                    score = p.unknown_score
                score += self.total[i - n]
                if best is None or score > best:
                    best, found = score, s
            self.piece.append(found)
            self.total.append(best)

    #: The piece that was committed last; empty at the beginning.
    before = ""
    #: The longest window that a stream has held so far.
    widest = 0

    def feed(self, text: str) -> list[int]:
        self.text += text
        self.widest = max(self.widest, len(self.text))
        if self.p.kind == BPE:
            self._merges()
        else:
            self._scores()
        return self._settled() if len(self.text) > 2 * self.p.longest else []

    def _path(self, at: int) -> list[str]:
        out = []
        while at:
            out.append(self.piece[at])
            at -= len(self.piece[at])
        return out[::-1]

    def _settled(self) -> list[int]:
        n = len(self.text)
        alive = set(range(max(0, n - self.p.longest + 1), n + 1))
        while len(alive) > 1:  # all paths go back until they meet
            last = max(alive)
            alive.remove(last)
            alive.add(last - len(self.piece[last]))
        at = alive.pop()
        if not at:
            return []
        path = self._path(at)
        self.before = path[-1]
        self.text, self.piece, self.total = self.text[at:], ["", *self.piece[at + 1 :]], [0.0, *(x - self.total[at] for x in self.total[at + 1 :])]
        return self.p.ids_of(path)

    def whole(self, text: str) -> bytes:
        """The ids of a stream of one text, as little-endian unsigned 32-bit integers."""
        if self.p.kind != BPE or len(text) > 2 * self.p.longest:
            out, step = array("I"), 4 * self.p.longest
            for i in range(0, len(text), step):
                out.extend(self.feed(text[i : i + step]))
            out.extend(self.close())
            return out.tobytes()
        self.text, self.piece = text, [""]
        self._merges()
        get, piece, at, ids = self.p.id.get, self.piece, len(text), []
        while at:
            i = get(piece[at])
            if i is None:
                ids = self.p.ids_of(self._path(len(text)))[::-1]
                break
            ids.append(i)
            at -= len(piece[at])
        self._reset()
        return array("I", ids[::-1]).tobytes()

    def close(self) -> list[int]:
        out = self.p.ids_of(self._path(len(self.text)))
        self._reset()
        self.before = ""
        return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str, text: str = "text", keep_ids: bool = True, cache: float = 1.0) -> DataFrame:
    """docs without the text, with n_ids, ids_crc32, round_trip (the decoded ids are the text) and, if asked, ids (little-endian 32-bit).

    No shuffle; a worker holds one batch, the vocabulary and bounded caches. Null and empty texts
    have no ids, texts of any length are encoded whole. Repeated rows are encoded one by one; a column with a
    result's name is replaced, other columns stay. An empty table gives an empty result.
    """

    def begin():
        pieces = pieces_of(model, cache)

        def one(t):
            data = pieces.encode_bytes(t) if t else b""
            return (len(data) // 4, zlib.crc32(data), pieces.decode(memoryview(data).cast("I")) == t) + ((data,) if keep_ids else ())

        n = 4 if keep_ids else 3
        return lambda texts: list(zip(*map(one, texts), strict=True)) if texts else [[]] * n

    kinds = {"n_ids": pa.int64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_()}
    return with_columns(docs, text, kinds | ({"ids": pa.binary()} if keep_ids else {}), begin)


def decode_documents(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded without the ids, with the decoded text. Null ids give an empty text."""
    keep = [c for c in encoded.columns if c not in (ids, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, text])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema] + [f"`{text}` string"])
    return encoded.select(*keep, ids).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, default_model())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids: their columns but the text, and n_ids, ids_crc32, round_trip and ids."""
    return encode_documents(docs, default_model(), cache=STAGE_CACHE)
