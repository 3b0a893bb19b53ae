"""Toxicity (operator 8): a linear-chain conditional random field over words.

Only documents are labelled, so the tokens are labelled first: words and word beginnings that
toxic documents of the training rows hold far oftener than the others make a lexicon, and a
token of a toxic document that matches it is an offending one. A two-state chain is trained on
these labels by gradient ascent on the penalised log-likelihood. Every token has features, whether the lexicon
knows it or not: the word, its beginnings and ending, its shape and length, the words beside it and
the pair that it makes with the one before; the change of state has weights of its own. Forward-backward
gives each token's marginal; a document's marginals are aggregated (their sum, largest and
density) and calibrated, out of fold, to a probability at the true rate of toxic documents.

The chain is run over all tokens of many texts at once: texts follow each other, a step into a new text
forgets the state, and blocks of tokens are crossed with products of their 2 x 2 steps.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.functions.words import mix
from lodework.llm.common import Scratch, bounded_sample, chosen, with_columns
from lodework.llm.language_id import remainder

#: Bounds of what is fitted on: labelled documents of each class, and bytes of their texts.
SAMPLE_DOCS, SAMPLE_BYTES = 2500, 48 << 20
TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of beginnings of words in the lexicon and among the features.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A lexicon feature occurs in so many toxic documents at least, at e^MIN_LIFT times the clean ones' rate.
MIN_DOCS, MIN_LIFT = 5, 2.5
WINDOW, EPOCHS, RATE, RIDGE = 8, 30, 0.2, 2e-4
#: Features that occur in fewer tokens of the training windows have no weight.
MIN_TOKENS = 3
#: Marginals under this are not added up; a text counts this many tokens more when density is taken.
BACKGROUND, FEW = 0.1, 30
#: Words whose features' weights a worker remembers.
WORDS = 300_000


def stems(word: str) -> list[str]:
    """A lower-case word and its beginnings."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def features(raw: str) -> tuple[list[str], list[str], list[str]]:
    """Features of a token by itself, as the one before another token, and as the one after."""
    w = raw.lower()
    shape = "upper" if raw.isupper() and len(raw) > 1 else "title" if raw[:1].isupper() else "lower"
    return [*stems(w), "end=" + w[-3:], "shape=" + shape, f"length={min(len(w), 12)}"], ["before=" + w, "before=" + w[:4] + "*"], ["after=" + w, "after=" + w[:4] + "*"]


def word_hash(raw: str) -> int:
    w = raw.lower().encode()
    return zlib.crc32(w) | zlib.crc32(w, 0x9E3779B9) << 32


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Of each token but the first of the array the pair with the token before it."""
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:])


def marginals(unary: np.ndarray, begins: np.ndarray, change: np.ndarray) -> np.ndarray:
    """P(state 1) of each token of texts that follow each other and begin at these tokens; unary is state 1's weight over state 0's.

    In blocks of tokens, side by side: products of the steps of each block, the state carried from block
    to block, and then through each block, forwards and backwards.
    """
    n = len(unary)
    if not n:
        return np.zeros(0)
    width = int(min(64, max(1, np.ceil(np.sqrt(n)))))
    rows = -(-n // width)
    e = np.ones(rows * width)
    e[:n] = np.exp(np.clip(unary, -30, 30))
    fresh = np.zeros(rows * width, bool)
    fresh[begins], fresh[n:] = True, True
    c = np.exp(change)
    step = np.empty((rows * width, 2, 2))
    step[:, :, 0] = np.where(fresh[:, None], 1.0, c[None, :, 0])
    step[:, :, 1] = np.where(fresh[:, None], 1.0, c[None, :, 1]) * e[:, None]
    step = step.reshape(rows, width, 2, 2)
    through = step[:, 0]
    for k in range(1, width):
        through = through @ step[:, k]
        through /= through.sum(axis=(1, 2), keepdims=True)
    come, go = np.empty((rows, 2)), np.empty((rows, 2))
    parts = through.tolist()
    a, b = 1.0, 0.0
    for r, ((p, q), (s, t)) in enumerate(parts):
        come[r] = a, b
        a, b = a * p + b * s, a * q + b * t
        a, b = a / (a + b), b / (a + b)
    a = b = 1.0
    for r in range(rows - 1, -1, -1):
        (p, q), (s, t) = parts[r]
        go[r] = a, b
        a, b = p * a + q * b, s * a + t * b
        a, b = a / (a + b), b / (a + b)
    forward = np.empty((rows, width, 2))
    for k in range(width):
        come = np.einsum("ri,rij->rj", come, step[:, k])
        come /= come.sum(axis=1, keepdims=True)
        forward[:, k] = come
    for k in range(width - 1, -1, -1):
        forward[:, k] *= go
        go = np.einsum("rij,rj->ri", step[:, k], go)
        go /= go.sum(axis=1, keepdims=True)
    forward = forward.reshape(-1, 2)[:n]
    return forward[:, 1] / forward.sum(axis=1)


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    pairs: dict[int, float] = field(default_factory=dict)
    bias: float = -6.0
    change: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)
    _memo: dict = field(default_factory=dict, repr=False)
    _tables: tuple | None = field(default=None, repr=False)
    _lifts: np.ndarray = field(default_factory=lambda: np.zeros((1024, 3)), repr=False)
    _hashes: np.ndarray = field(default_factory=lambda: np.zeros(1024, np.uint64), repr=False)

    def _learn(self, words: set[str]) -> None:
        memo = self._memo
        if len(memo) + len(words) > WORDS:
            memo.clear()
        if len(memo) + len(words) > len(self._lifts):
            more = max(len(self._lifts), len(words))
            self._lifts, self._hashes = np.concatenate([self._lifts, np.zeros((more, 3))]), np.concatenate([self._hashes, np.zeros(more, np.uint64)])
        if self._tables is None:
            self._tables = self._by_kind()
        word, start, end, shape, length, *sides = self._tables
        for raw in words:
            if raw in memo:
                continue
            w = raw.lower()
            n = len(w)
            own = word.get(w, 0.0) + end.get(w[-3:], 0.0) + shape[0 if n > 1 and raw.isupper() else 1 if raw[0].isupper() else 2] + length[min(n, 12)]
            for k in BEGINNINGS:
                if k >= n:
                    break
                own += start.get(w[:k], 0.0)
            head = w[:4]
            self._lifts[len(memo)] = own, sides[0].get(w, 0.0) + sides[1].get(head, 0.0), sides[2].get(w, 0.0) + sides[3].get(head, 0.0)
            self._hashes[len(memo)] = word_hash(raw)
            memo[raw] = len(memo)

    def _by_kind(self) -> tuple:
        """The weights by kind of feature, so that those of a word are looked up without writing their names."""
        word, start, end, shape, length, sides = {}, {}, {}, [0.0] * 3, [0.0] * 13, [{}, {}, {}, {}]
        for f, x in self.weights.items():
            name, _, value = f.rpartition("=")
            if name in ("before", "after"):
                sides[2 * (name == "after") + value.endswith("*")][value.removesuffix("*")] = x
            elif name == "end":
                end[value] = x
            elif name == "shape":
                shape[("upper", "title", "lower").index(value)] = x
            elif name == "length":
                length[int(value)] = x
            else:
                (start if f.endswith("*") else word)[f.removesuffix("*")] = x
        return word, start, end, shape, length, *sides

    def unary(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Weights of state 1 of all tokens of the texts, one after the other, and where each text with tokens begins."""
        flat = [w for t in texts for w in t]
        missing = set(flat) - self._memo.keys()
        if missing:
            if len(self._memo) + len(missing) > WORDS:
                missing = set(flat)
            self._learn(missing)
        at = np.fromiter(map(self._memo.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = (np.cumsum(sizes) - sizes)[sizes > 0]
        out = self.bias + self._lifts[at, 0]
        if len(at) > 1:
            joined = np.ones(len(at) - 1, bool)
            joined[begins[1:] - 1] = False
            out[1:] += np.where(joined, self._lifts[at[:-1], 1], 0.0)
            out[:-1] += np.where(joined, self._lifts[at[1:], 2], 0.0)
            if self.pairs:
                known = np.array(sorted(self.pairs), np.uint64)
                values = np.array([self.pairs[int(k)] for k in known])
                h = pair_hashes(self._hashes[at])
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out[1:] += np.where(joined & (known[place] == h), values[place], 0.0)
        return out, begins

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """The marginals of the tokens of each text."""
        tokens = [TOKEN.findall(t) for t in texts]
        unary, begins = self.unary(tokens)
        p = marginals(unary, begins, self.change)
        return np.split(p, np.cumsum([len(t) for t in tokens])[:-1]) if texts else []

    @staticmethod
    def evidence(p: np.ndarray) -> list[float]:
        """Sum, largest and density of the marginals; what every token has of background, and few tokens, say little."""
        total = float(p[p >= BACKGROUND].sum())
        return [1.0, float(np.log1p(total)), float(p.max(initial=0.0)), float(np.sqrt(total / (len(p) + FEW)))]

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if not marginals:
            return np.zeros(0)
        z = np.array([self.evidence(p) for p in marginals]) @ np.array(self.calibration)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def lexicon(docs: list[tuple[str, int]]) -> set[str]:
    """Words and beginnings in MIN_DOCS toxic documents or more, at e^MIN_LIFT times the others' rate."""
    seen, n = (Counter(), Counter()), [0, 0]
    for text, toxic in docs:
        n[toxic] += 1
        seen[toxic].update({f for w in set(TOKEN.findall(text.lower())) for f in stems(w)})
    rate = lambda f, y: np.log((seen[y][f] + 0.5) / (n[y] + 1))
    return {f for f, k in seen[1].items() if k >= MIN_DOCS and rate(f, 1) - rate(f, 0) >= MIN_LIFT}


def _windows(docs: list[tuple[str, int]], lex: set[str]) -> list[tuple[list[str], list[int]]]:
    """Token windows around matches, and as many documents' beginnings without any, with their labels."""
    out, known = [], {}
    for text, toxic in docs:
        tokens = TOKEN.findall(text)
        hits = []
        for i, w in enumerate(tokens):
            if w not in known:
                known[w] = any(f in lex for f in stems(w.lower()))
            if known[w]:
                hits.append(i)
        last = -1
        for i in hits:
            if i > last:
                a, last = max(0, i - WINDOW), min(len(tokens), i + WINDOW)
                out.append((tokens[a:last], [int(known[w] and toxic == 1) for w in tokens[a:last]]))
        if not hits and tokens:
            middle = max(0, len(tokens) // 2 - WINDOW)
            out.append((tokens[middle : middle + 2 * WINDOW], [0] * len(tokens[middle : middle + 2 * WINDOW])))
    return out


def train_chain(windows: list[tuple[list[str], list[int]]], model: ToxicityModel, epochs: int = EPOCHS) -> None:
    """Set the model's weights, bias and change so that they maximise the penalised log-likelihood of the windows."""
    longest, n = max(len(y) for _, y in windows), len(windows)
    valid, gold = np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
    names: dict = {}
    rows, cols, memo = [], [], {}

    def add(i: int, t: int, fs) -> None:
        for f in fs:
            rows.append(i * longest + t)
            cols.append(names.setdefault(f, len(names)))

    for i, (words, y) in enumerate(windows):
        valid[i, : len(y)], gold[i, : len(y)] = True, y
        for w in words:
            if w not in memo:
                memo[w] = (*features(w), word_hash(w))
        pairs = pair_hashes(np.array([memo[w][3] for w in words], np.uint64)).tolist() if len(words) > 1 else []
        for t, w in enumerate(words):
            add(i, t, memo[w][0])
            if t:
                add(i, t, memo[words[t - 1]][1])
                add(i, t, [pairs[t - 1]])
            if t + 1 < len(words):
                add(i, t, memo[words[t + 1]][2])
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    often = np.bincount(cols, minlength=len(names)) >= MIN_TOKENS
    number = np.cumsum(often) - 1
    rows, cols = rows[often[cols]], number[cols[often[cols]]]
    kept = [f for f, ok in zip(names, often.tolist(), strict=True) if ok]
    w, bias, change = np.zeros(len(kept)), -2.0, np.zeros((2, 2))
    m = [np.zeros(len(kept) + 5), np.zeros(len(kept) + 5)]
    for epoch in range(1, epochs + 1):
        unary = np.zeros((n, longest, 2))
        unary[:, :, 1] = bias + np.bincount(rows, w[cols], n * longest).reshape(n, longest)
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0] = unary[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(valid[:, t, None], np.logaddexp(a[:, t - 1, 0, None] + change[0], a[:, t - 1, 1, None] + change[1]) + unary[:, t], a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = b[:, t + 1] + unary[:, t + 1]
            b[:, t] = np.where(valid[:, t + 1, None], np.logaddexp(change[:, 0] + nxt[:, 0, None], change[:, 1] + nxt[:, 1, None]), b[:, t + 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p1 = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * valid
        err = (gold - p1) * valid
        dchange = np.zeros((2, 2))
        for t in range(1, longest):
            ok = valid[:, t]
            for i in (0, 1):
                for j in (0, 1):
                    e = np.exp(a[:, t - 1, i] + change[i, j] + unary[:, t, j] + b[:, t, j] - z)
                    dchange[i, j] += np.sum(((gold[:, t - 1] == i) & (gold[:, t] == j) & ok) - e * ok)
        grad = np.concatenate([np.bincount(cols, err.reshape(-1)[rows], len(kept)), [err.sum()], dchange.reshape(-1)]) / n
        theta = np.concatenate([w, [bias], change.reshape(-1)])
        grad -= RIDGE * theta
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.999 * m[1] + 0.001 * grad**2
        theta += RATE * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.999**epoch)) + 1e-8)
        w, bias, change = theta[: len(kept)], float(theta[len(kept)]), theta[len(kept) + 1 :].reshape(2, 2)
    model.weights = {f: x for f, x in zip(kept, w.tolist(), strict=True) if isinstance(f, str) and abs(x) > 1e-4}
    model.pairs = {f: x for f, x in zip(kept, w.tolist(), strict=True) if not isinstance(f, str) and abs(x) > 1e-4}
    model.bias, model.change = bias, change


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        beta += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * beta), -3, 3)
    return beta


def _chain(windows: list) -> ToxicityModel:
    model = ToxicityModel()
    if windows:
        train_chain(windows, model)
    return model


def _in_tasks(spark: SparkSession):
    """A map() whose calls are tasks on executors; what they are given are windows, some MB at most."""

    def each(f, items: list) -> list:
        def run(batches):
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pickle.dumps(f(items[i]))], pa.binary())], names=["id", "model"])

        rows = spark.range(0, len(items), 1, len(items)).mapInArrow(run, "id long, model binary").collect()
        return [pickle.loads(r["model"]) for r in sorted(rows, key=lambda r: r["id"])]

    return each


def train(docs: list[tuple[str, int]], weights: tuple[float, float] = (1.0, 1.0), each=lambda f, items: list(map(f, items))) -> ToxicityModel:
    """Fit on (whole text, 0 or 1) pairs; weights say how many documents a clean and a toxic one stand for.

    Half of them make the lexicon and the chain that the other half is scored with for calibration; the final
    chain has all. The three chains are trained side by side where `each` does that.
    """
    if not docs or len({y for _, y in docs}) < 2:
        return ToxicityModel()
    halves = (docs[::2], docs[1::2])
    first, second, model = each(_chain, [_windows(part, lex) if (lex := lexicon(part)) else [] for part in (*halves, docs)])
    x, y = [], []
    for m, scored in ((first, halves[1]), (second, halves[0])):
        for i in range(0, len(scored), 64):
            x += [m.evidence(p) for p in m.tag([t for t, _ in scored[i : i + 64]])]
        y += [v for _, v in scored]
    model.calibration = tuple(_calibrate(np.array(x), np.array(y, float), np.array([weights[v] for v in y])).tolist())
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Train on at most sample_docs whole texts of each class, and sample_bytes of them.

    Rows with null text, key or label are left out; repeated labels of a key count once, as toxic if one of
    them is. A class that is sampled is weighted by its size, so calibration follows the true rate
    however large the table is.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__toxic"))
    picked, counts = chosen(known, "__toxic", "__key", sample_docs, "toxicity")
    # About 1.2 * sample_docs rows of each class, of keys alone.
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(picked), "__key")
    found = bounded_sample(texts, "__toxic", "__key", "text", sample_docs, sample_bytes, Scratch(docs.sparkSession, "toxicity"))
    rows = sorted(((zlib.crc32(("toxicity:" + str(k)).encode()), str(k), t, y) for y, part in found.items() for k, t in part))
    weights = tuple(counts.get(y, 0) / max(1, len(found.get(y, ()))) for y in (0, 1))
    least = min((w for w in weights if w > 0), default=1.0)
    return train([(t, y) for *_, t, y in rows], tuple(w / least for w in weights), _in_tasks(docs.sparkSession))


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the text, with score, predicted and offending spans (start:end:marginal) of every row; no shuffle.

    Null and empty texts hold no token and get the calibrated score of that. Texts of any length are
    scored whole. Repeated rows are scored one by one; a column that has the name of a result is replaced, other
    columns stay. An empty table gives an empty result.
    """

    def begin():
        def spans(t, p):
            return ",".join(f"{m.start()}:{m.end()}:{x:.3f}" for m, x in zip(TOKEN.finditer(t), p.tolist(), strict=True) if x >= 0.5)

        def work(texts):
            tagged = model.tag(texts)
            scores = model.scores(tagged)
            return [scores.tolist(), (scores >= threshold).astype(int).tolist(), [spans(t, p) if p.max(initial=0.0) >= 0.5 else "" for t, p in zip(texts, tagged, strict=True)]]

        return work

    return with_columns(docs, text, {"score": pa.float64(), "predicted": pa.int32(), "offending": pa.string()}, begin)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = fit(docs, labels.filter(remainder("doc_id", 3) != 1))
    return toxicity(docs.select("doc_id", held.alias("held_out"), "text"), model)
