"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.common import crc32_mod, without

BINS = 1 << 18
_WORD = re.compile(r"\w+")


def lowered(text: str) -> str:
    """Lower case of the same length, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def features(word: str) -> list[int]:
    """Bins of a token's features: itself, its first and last three letters, its length class, and one that all tokens share."""
    return [0, *(1 + zlib.crc32(f.encode()) % (BINS - 1) for f in (f"w={word}", f"p={word[:3]}", f"s={word[-3:]}", f"n={min(len(word), 12)}"))]


class Packed:
    """Sequences laid out by time step, the longer ones first, so that a step of all is one slice."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(steps), side="left")
        self.starts = np.concatenate([[0], np.cumsum(self.active)])

    def places(self, rank: int) -> np.ndarray:
        """Of the rank-th longest sequence's tokens."""
        return self.starts[: self.lengths[rank]] + rank


def marginals(emission: np.ndarray, packed: Packed, start: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over two tags, by odds of tag 1 against tag 0.

    emission: log odds of each token; moves: 2 x 2 log weights. Gives the forward odds, the backward odds and the marginal probability of tag 1.
    """
    m = np.exp(moves)
    x = np.exp(np.clip(emission, -30, 30))
    forward, backward = np.empty_like(x), np.ones_like(x)
    s, a = packed.starts, packed.active
    for t in range(len(a)):
        now = slice(s[t], s[t] + a[t])
        if t == 0:
            forward[now] = x[now] * np.exp(start)
        else:
            r = forward[s[t - 1] : s[t - 1] + a[t]]
            forward[now] = x[now] * (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
    for t in range(len(a) - 1, 0, -1):
        now = slice(s[t], s[t] + a[t])
        y = x[now] * backward[now]
        backward[s[t - 1] : s[t - 1] + a[t]] = (m[1, 0] + m[1, 1] * y) / (m[0, 0] + m[0, 1] * y)
    odds = forward * backward
    return forward, backward, odds / (1.0 + odds)


class Crf:
    """Tags 0 (clean) and 1 (toxic). weights: of the features, as log odds of tag 1."""

    def __init__(self):
        self.weights = np.zeros(BINS)
        self.start, self.moves = 0.0, np.zeros((2, 2))
        self.calibration = np.array([0.0, 1.0, 0.0])

    def fit(self, texts: list[list[str]], tags: list[np.ndarray], epochs: int = 4, rate: float = 0.5, batch: int = 64, decay: float = 1e-5) -> Crf:
        """Adaptive gradient ascent on the log likelihood of the tags."""
        index: dict[str, int] = {}
        ids = [np.array([index.setdefault(w, len(index)) for w in t], np.int32) for t in texts]
        bins = np.array([features(w) for w in index], np.int64).reshape(-1, 5)
        order = sorted((k for k in range(len(ids)) if len(ids[k])), key=lambda k: -len(ids[k]))
        batches = [order[k : k + batch] for k in range(0, len(order), batch)]
        square, square_moves, square_start = np.full(BINS, 1e-8), np.full((2, 2), 1e-8), 1e-8
        rng = np.random.Generator(np.random.PCG64(9))
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                part = batches[k]
                packed = Packed(np.array([len(ids[d]) for d in part]))
                flat, y = np.empty((packed.starts[-1], 5), np.int64), np.empty(packed.starts[-1])
                for rank, d in enumerate(packed.order):
                    at = packed.places(rank)
                    flat[at], y[at] = bins[ids[part[d]]], tags[part[d]]
                emission = self.weights[flat].sum(axis=1)
                forward, backward, p = marginals(emission, packed, self.start, self.moves)
                grad = np.bincount(flat.ravel(), np.repeat(y - p, 5), BINS)
                grad -= decay * self.weights * len(part)
                first = slice(0, packed.active[0])
                grad_start = (y[first] - p[first]).sum()
                later = np.arange(packed.active[0], packed.starts[-1])
                step = np.repeat(np.arange(1, len(packed.active)), packed.active[1:])
                before = packed.starts[step - 1] + (later - packed.starts[step])
                m, z = np.exp(self.moves), np.exp(np.clip(emission[later], -30, 30)) * backward[later]
                r = forward[before]
                pair = np.stack([m[0, 0] * np.ones_like(r), m[0, 1] * z, r * m[1, 0], r * m[1, 1] * z])
                pair /= pair.sum(axis=0)
                seen = np.bincount((2 * y[before] + y[later]).astype(np.int64), minlength=4)
                grad_moves = (seen - pair.sum(axis=1)).reshape(2, 2)
                square += grad**2
                square_moves += grad_moves**2
                square_start += grad_start**2
                self.weights += rate * grad / np.sqrt(square)
                self.moves += 0.1 * rate * grad_moves / np.sqrt(square_moves)
                self.start += 0.1 * rate * grad_start / np.sqrt(square_start)
        return self

    def calibrate(self, summaries: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression of document labels on the summaries, by Newton's method with a small ridge."""
        x, b = np.column_stack([np.ones(len(summaries)), summaries]), np.zeros(summaries.shape[1] + 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
            b = b + np.linalg.solve(h, x.T @ (labels - p) - 1e-2 * b)
        self.calibration = b


class Scorer(dict):
    """Token -> log odds of its features, of a bounded number of tokens, for batches of whole texts."""

    def __init__(self, model: Crf, max_words: int = 120_000):
        super().__init__()
        self.model, self.max_words = model, max_words

    def __missing__(self, word: str) -> float:
        out = float(self.model.weights[features(word)].sum())
        if len(word) <= 64:
            if len(self) >= self.max_words:
                self.clear()
            self[word] = out
        return out

    def probabilities(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the marginal probability that each token is toxic."""
        words = [_WORD.findall(lowered(t)) for t in texts]
        packed = Packed(np.array([len(w) for w in words], np.int64))
        emission = np.empty(packed.starts[-1])
        for rank, d in enumerate(packed.order):
            emission[packed.places(rank)] = np.fromiter(map(self.__getitem__, words[d]), float, len(words[d]))
        p = marginals(emission, packed, self.model.start, self.model.moves)[2]
        out: list[np.ndarray] = [np.empty(0)] * len(texts)
        for rank, d in enumerate(packed.order):
            out[d] = p[packed.places(rank)]
        return out

    def score(self, p: np.ndarray) -> float:
        b = self.model.calibration
        return float(1 / (1 + np.exp(-np.clip(b[0] + summary(p) @ b[1:], -30, 30))))


def summary(p: np.ndarray) -> np.ndarray:
    """Of a document's marginals: log odds of the largest, and the log of the expected number of toxic tokens among those likelier than not."""
    top = np.clip(p.max(initial=0.0), 1e-6, 1 - 1e-6)
    return np.array([np.log(top / (1 - top)), np.log1p(p[p > 0.5].sum())])


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
    """Offsets (code points) of runs of tokens likelier toxic than `least`, with the largest probability of each."""
    out: list[tuple[int, int, float]] = []
    last = -2
    for k, m in enumerate(_WORD.finditer(lowered(text))):
        if p[k] > least:
            if last == k - 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[k])))
            else:
                out.append((*m.span(), float(p[k])))
            last = k
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 1500, max_chars: int = 100_000) -> Crf:
    """Fit the field on at most max_docs labelled documents of each label, of at most max_chars each, chosen by a hash of the id among the labelled documents that docs has:
    labels of others play no part.

    Document labels say which texts are toxic, not where. A token is tagged toxic in a toxic text if its share of toxic texts is over twenty times
    that of clean ones and at least one in two hundred toxic texts (or three) has it. A conflict of labels counts as toxic; null labels and ids are left out.
    Without documents of both labels, every score is the smoothed share of toxic ones. The field is fitted in a task; the driver gets its weights only.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__lid")).agg(F.max(label_col).alias("__y"))
    eligible = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).where(F.length("__text") <= max_chars)
    held = eligible.select("__id").join(known, F.col("__id") == F.col("__lid")).select("__lid", "__y").distinct()
    chosen = [held.where(F.col("__y") == y).orderBy(F.xxhash64("__lid"), "__lid").limit(max_docs) for y in (0, 1)]
    rows = eligible.join(F.broadcast(chosen[0].union(chosen[1])), F.col("__id") == F.col("__lid")).select("__text", "__y").distinct()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(y, np.int64)))], pa.binary())], names=["model"])

    model = rows.repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(bytes(model[0].model)) if model else fit([], np.zeros(0, np.int64))


def fit(texts: list[str], y: np.ndarray) -> Crf:
    order = sorted(range(len(texts)), key=lambda k: (texts[k], y[k]))  # whatever order the rows came in
    texts, y = [texts[k] for k in order], y[order]
    model, n1, n0 = Crf(), int(y.sum()), int(len(y) - y.sum())
    if not n0 or not n1:
        share = (n1 + 1) / (n1 + n0 + 2)
        model.calibration = np.array([np.log(share / (1 - share)), 0.0, 0.0])
        return model
    once: dict[str, str] = {}  # equal words are one object
    words = [[once.setdefault(w, w) for w in _WORD.findall(lowered(t))] for t in texts]
    held = [Counter(w for k, t in enumerate(words) if y[k] == label for w in set(t)) for label in (0, 1)]
    toxic = {w for w, n in held[1].items() if n >= max(3, n1 / 200) and (n + 0.5) / (n1 + 1) > 20 * (held[0][w] + 0.5) / (n0 + 1)}
    tags = [np.array([label and w in toxic for w in t], float) for t, label in zip(words, y, strict=True)]
    model.fit(words, tags)
    scorer = Scorer(model)
    model.calibrate(np.array([summary(p) for k in range(0, len(texts), 256) for p in scorer.probabilities(texts[k : k + 256])]), y)
    return model


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 if score >= threshold), spans (start, end, probability of each offending passage).

    Whole texts are read. Null and empty texts have no token: their score is that of a text without any sign. Null ids stay null, repeated rows are scored each, other
    columns are ignored, an empty table gives no rows. One pass without a shuffle; the model is of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                probabilities = scorer.probabilities(texts)
                scores = [scorer.score(p) for p in probabilities]
                found = [[dict(zip(("start", "end", "probability"), s, strict=True)) for s in spans(t, p)] if p.max(initial=0) > 0.5 else [] for t, p in zip(texts, probabilities, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, kind)], names=["doc_id", "score", "predicted", "spans"]
                )

    schema = "doc_id long, score double, predicted int, spans array<struct<start: long, end: long, probability: double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(part, schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows from which labels may be learned: crc32 of the id as text, modulo 3, is not 1."""
    return docs.where(crc32_mod(id_col, 3) != 1)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the documents predicted toxic. Rows with a null id stay."""
    model = train(training_rows(docs, id_col), labels, id_col, text_col)
    return without(docs, id_col, score(docs, model, id_col, text_col, threshold).where("predicted = 1").select("doc_id"))
