"""Quality classifier (9): a factorisation machine over hashed words, structure
statistics and numeric metadata.

The score of a document x is sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j>
x_i x_j); the pairwise part is computed in linear time as half of
sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).

Fitting: at most ``max_rows`` labelled rows (12,000; the smallest by a hash of
the id), so the fit's time and memory are fixed.  Their features are computed
on the executors; the driver runs a few Adagrad passes in numpy.  The model
(``BUCKETS`` x (rank + 1) floats, 2.4 MB) is broadcast and scores every row in
one narrow pass.

Defined cases: null, empty and wordless texts get the structure features of an
empty text; null metadata counts as 0; rows with a null label, and labels
without a document, are not learned from; several labels of one id are all
learned; repeated rows of one id count once in the fit and are each scored;
without any usable label every score is 0.5; names of other columns don't
matter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import CACHE_WORDS, bound_batches, remainder

WORD_BUCKETS = 1 << 16
STRUCTURE = 14
METADATA = 8
BUCKETS = WORD_BUCKETS + STRUCTURE + METADATA
MAX_ROWS = 12_000
KEEP_FROM = 0.3
CHUNK = 256


class WordBuckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word) % WORD_BUCKETS
        return value


def features(text: bytes, metadata: list[float], buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values of one document; never empty."""
    words = text.split()
    n, m = max(len(words), 1), max(len(text), 1)
    ids = np.fromiter(map(buckets.__getitem__, text.lower().split()), np.int64, len(words))
    ids, counts = np.unique(ids, return_counts=True)
    values = np.log1p(counts)
    values /= max(np.sqrt((values * values).sum()), 1e-9)
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, high = of[65:91].sum(), of[97:123].sum(), of[128:].sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    structure = [
        1.0,
        np.log1p(len(words)) / 10,
        min(m / n / 20, 2.0),
        upper / max(upper + lower, 1),
        high / m,
        of[48:58].sum() / m * 5,
        of[33] / n, of[124] / n,
        (of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()) / m * 5,
        len(ids) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        min(len(lines) / n * 5, 2.0),
        (of[46] + of[44]) / n,
    ]
    more = [np.log1p(max(x, 0.0)) / 10 for x in metadata[:METADATA]]
    own = np.arange(WORD_BUCKETS, WORD_BUCKETS + STRUCTURE + len(more))
    return np.concatenate([ids, own]), np.concatenate([values, structure, more])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @staticmethod
    def empty(rank: int = 8, seed: int = 7) -> FactorisationMachine:
        factors = np.random.default_rng(seed).normal(0, 0.02, (BUCKETS, rank))
        return FactorisationMachine(0.0, np.zeros(BUCKETS), factors)

    def margins(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray):
        """Margin of each document, and its factor sums."""
        vx = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * ((sums ** 2) - np.add.reduceat(vx ** 2, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[ids] * values, starts) + pairs, sums

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        ids, values, starts, _ = joined(docs)
        return sigmoid(self.margins(ids, values, starts)[0])

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 5,
            batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        if not len(docs):
            return self
        rng = np.random.default_rng(seed)
        share = min(max(labels.mean(), 0.01), 0.99)
        self.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_b = np.full(BUCKETS, 1e-3), np.full(self.factors.shape, 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), batch):
                part = order[i:i + batch]
                ids, values, starts, row = joined([docs[j] for j in part])
                margin, sums = self.margins(ids, values, starts)
                error = (sigmoid(margin) - labels[part]) / len(part)
                own, at = np.unique(ids, return_inverse=True)
                slope = error[row] * values
                grad_w = np.bincount(at, slope, len(own)) + decay * self.linear[own] / len(part)
                towards = slope[:, None] * (sums[row] - self.factors[ids] * values[:, None])
                grad_v = np.stack([np.bincount(at, g, len(own)) for g in towards.T], axis=1)
                grad_v += decay * self.factors[own] / len(part)
                seen_w[own] += grad_w ** 2
                seen_v[own] += grad_v ** 2
                seen_b += error.sum() ** 2
                self.linear[own] -= rate * grad_w / np.sqrt(seen_w[own])
                self.factors[own] -= rate * grad_v / np.sqrt(seen_v[own])
                self.bias -= rate * error.sum() / np.sqrt(seen_b)
        return self


def joined(docs):
    sizes = np.fromiter((len(x) for x, _ in docs), np.int64, len(docs))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return (np.concatenate([x for x, _ in docs]), np.concatenate([v for _, v in docs]), starts,
            np.repeat(np.arange(len(docs)), sizes))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(batch: pa.RecordBatch, text_at: int, meta_at: list[int], buckets: WordBuckets):
    """Features of each row of an Arrow batch."""
    texts = batch.column(text_at).cast(pa.binary())
    meta = [batch.column(i).cast(pa.float64()).to_pylist() for i in meta_at]
    for i, text in enumerate(texts):
        yield features(text.as_py() or b"", [m[i] or 0.0 for m in meta], buckets)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: list[str],
                    label_col: str, fold: int, max_rows: int) -> DataFrame:
    picked = (labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label"))
              .filter(F.col("__id").isNotNull() & F.col("__label").isNotNull() & (remainder("__id", fold) != 0))
              .orderBy(F.xxhash64("__id"), "__id", "__label").limit(max_rows))  # so many rows are broadcast at most
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"),
                      F.struct(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                               *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"m{i}")
                                 for i, c in enumerate(meta_cols)]).alias("__row"))
    # one row per id and label, also where rows repeat an id
    return (own.join(F.broadcast(picked), "__id").groupBy("__id", "__label").agg(F.min("__row").alias("__row"))
            .select("__id", "__label", "__row.*"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                meta_cols: tuple[str, ...] = ("n_chars",), label_col: str = "quality", fold: int = 5,
                max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Learns only from labels whose crc32(id) mod ``fold`` is not 0."""
    sample = labelled_sample(docs, labels, id_col, text_col, list(meta_cols), label_col, fold, max_rows)
    meta_at = [3 + i for i in range(len(meta_cols))]

    def run(batches):
        buckets = WordBuckets()
        for b in batches:
            rows = list(_inputs(b, 2, meta_at, buckets))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.astype(np.uint32).tobytes() for x, _ in rows], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())],
                ["id", "label", "ids", "values"])

    found = sorted(sample.mapInArrow(run, "id long, label int, ids binary, values binary").collect(),
                   key=lambda r: (r.id, r.label))
    rows = [(np.frombuffer(bytes(r.ids), np.uint32).astype(np.int64), np.frombuffer(bytes(r["values"]), np.float32))
            for r in found]
    return FactorisationMachine.empty().fit(rows, np.array([float(r.label > 0) for r in found]))


def _scores(model: FactorisationMachine, batch: pa.RecordBatch, text_at: int, meta_at: list[int], buckets) -> np.ndarray:
    out, chunk = [], []
    for x in _inputs(batch, text_at, meta_at, buckets):
        chunk.append(x)
        if len(chunk) >= CHUNK:
            out.append(model.score(chunk))
            chunk = []
    return np.concatenate([*out, model.score(chunk)])


def _small(model: FactorisationMachine):
    return (model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32))


def score_quality(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text",
                  meta_cols: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1, higher: label 1 likelier)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_small(model))
    meta_at = [2 + i for i in range(len(meta_cols))]

    def run(batches):
        own, buckets = FactorisationMachine(*shared.value), WordBuckets()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(own, b, 1, meta_at, buckets), pa.float64())],
                                             ["doc_id", "score"])

    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.col(f"`{text_col}`").cast("string").alias("text"),
                        *[F.col(f"`{c}`").cast("double").alias(f"m{i}") for i, c in enumerate(meta_cols)])
            .mapInArrow(run, "doc_id long, score double"))


def keep_quality(docs: DataFrame, model: FactorisationMachine, text_col: str = "text",
                 meta_cols: tuple[str, ...] = ("n_chars",), keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``keep_from`` or more."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_small(model))
    text_at, meta_at = docs.columns.index(text_col), [docs.columns.index(c) for c in meta_cols]

    def run(batches):
        own, buckets = FactorisationMachine(*shared.value), WordBuckets()
        for b in batches:
            yield b.filter(pa.array(_scores(own, b, text_at, meta_at, buckets) >= keep_from))

    return docs.mapInArrow(run, docs.schema)
