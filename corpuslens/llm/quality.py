"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import change_rows, gather, slices
from .labelled import held_out, sample

BUCKETS = 1 << 16
#: Labelled rows that the model is fitted on at most, and bytes of their word buckets.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
STATS = ("empty", "log_words", "word_length", "distinct_words", "top_word", "upper", "digits", "symbols", "spaces", "repeated_lines", "line_words", "sentence_ends", "log_declared", "declared_off")
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_SPACE = np.isin(_BYTES, (9, 10, 11, 12, 13, 32))
_COMMON = np.isin(_BYTES, [ord(c) for c in ".,;:'\"()-"])
_SYMBOL = ~(_UPPER | _DIGIT | _LOWER | _SPACE | _COMMON) & (_BYTES < 128)
_END = np.isin(_BYTES, [ord(c) for c in ".!?"])


def features(text: str, declared: int | None) -> tuple[np.ndarray, list[float]]:
    """(distinct buckets of the lower-cased words, STATS) of a whole text; declared is the row's own n_chars, if any."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.lower().split()
    count = Counter(words)
    buckets = np.unique(np.fromiter((crc32(w) & (BUCKETS - 1) for w in count), np.int64, len(count)))
    n = max(1, len(words))
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda mask: float(chars[mask].sum()) / total
    declared = -1 if declared is None else declared
    stats = [
        float(not words), np.log1p(len(words)), (total - float(chars[_SPACE].sum())) / n, len(count) / n, max(count.values(), default=0) / n,
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_SPACE), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), float(chars[_END].sum()) / n,
        np.log1p(max(0, declared)), float(declared >= 0 and declared != len(text)),
    ]
    return buckets, [float(x) for x in stats]


@dataclass
class Machine:
    """w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2] over buckets and scaled statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, buckets: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat (index, value, row starts): each row has its buckets at 1/sqrt(their number), then all statistics."""
        z = np.clip((np.asarray(stats, np.float64).reshape(len(buckets), len(STATS)) - self.mean) / self.scale, -4, 4) / np.sqrt(len(STATS))
        own = np.arange(BUCKETS, BUCKETS + len(STATS))
        index = np.concatenate([x for b in buckets for x in (b, own)])
        value = np.concatenate([x for b, s in zip(buckets, z, strict=True) for x in (np.full(len(b), 1 / np.sqrt(max(1, len(b)))), s)])
        sizes = np.array([len(b) + len(STATS) for b in buckets])
        return index, value, np.cumsum(sizes) - sizes

    def parts(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score before the sigmoid, sums over each row, v_if x_i): linear in the number of entries."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (sums**2 - squares).sum(1), sums, vx

    def scores(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        if not len(buckets):
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.parts(*self.rows(buckets, stats))[0], -30, 30)))


def fit(buckets: list[np.ndarray], stats: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 20, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Log loss with Adam. Without rows of both classes the machine is constant: the share of label 1, or one half."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATS)
    m = Machine(0.0, np.zeros(size), np.zeros((size, factors)), np.zeros(len(STATS)), np.ones(len(STATS)))
    if len(set(y.tolist())) < 2:
        m.w0 = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return m
    stats = np.asarray(stats, np.float64)
    m.mean, m.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    m.v = rng.normal(0, 0.05, (size, factors))
    m.w0 = float(np.log(y.mean() / (1 - y.mean())))
    state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("w", m.w), ("v", m.v), ("w0", np.zeros(1)))}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            index, value, starts = m.rows([buckets[i] for i in rows], stats[rows])
            logit, sums, vx = m.parts(index, value, starts)
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
            of = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(index))))
            pull = err[of] * value
            grads = {"w0": np.array([err.sum()]), "w": np.bincount(index, pull, size) + decay * m.w}
            grads["v"] = np.stack([np.bincount(index, pull * (sums[of, f] - vx[:, f]), size) for f in range(factors)], 1) + decay * m.v
            step += 1
            for k, g in grads.items():
                a, b = state[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                move = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                if k == "w0":
                    m.w0 -= float(move[0])
                else:
                    getattr(m, k)[...] -= move
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch, 2):
            n = len(texts)
            rows = [features(t, d) for t, d in zip(texts, batch.column(3).slice(at, n).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["id", "label", "buckets", "stats"])


def _declared(docs: DataFrame, chars_col: str | None):
    return F.col(chars_col).cast("long") if chars_col and chars_col in docs.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, fold: int = 1, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", most_bytes: int = TRAIN_BYTES) -> Machine:
    """Fit on at most `most` labelled rows outside the fold, and fewer where their buckets hold more than `most_bytes`.

    The sample is small by that bound, so it is broadcast and the texts stay where they are; only its features come to
    the driver. A null or empty text is a row without words; of several rows with one id, the one with the smallest
    features counts, whatever the order of rows; rows with a null id are not learned from. Without labelled rows of both
    classes, empty tables included, the machine is constant.
    """
    some = sample(labels, label_col, folds, fold, most, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _declared(docs, chars_col).alias("declared"))
    rows = rows.join(F.broadcast(some), "id").select("id", "label", "text", "declared")
    rows = rows.mapInArrow(_feature_batches, "id long, label int, buckets binary, stats array<double>").groupBy("id").agg(F.min(F.struct("buckets", "stats", "label")).alias("row"))
    got = gather(rows.select("id", "row.*"), "buckets", most_bytes, "quality-sample").to_pydict()
    return fit([np.frombuffer(b, np.int64) for b in got["buckets"]], np.array(got["stats"]).reshape(-1, len(STATS)), np.array(got["label"], np.float64))


def _score_batches(model: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, 2, 4 << 20):
                n = len(texts)
                rows = [features(t, d) for t, d in zip(texts, batch.column(3).slice(at, n).to_pylist(), strict=True)]
                yield pa.record_batch([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(model.scores([r[0] for r in rows], np.array([r[1] for r in rows])))], names=["id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, model: Machine, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", least: float = 0.5) -> DataFrame:
    """Per row (id_col, held_out, score, predicted): the machine's probability of label 1 for the whole text.

    Inputs of a score are the words, the statistics and the declared length only. A null or empty text scores by its
    statistics; a null id keeps its row and is not held out; repeated rows are kept; other columns are ignored. No
    shuffle; the model has a fixed size.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).cast("string").alias("text"), _declared(docs, chars_col).alias("declared"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_score_batches(model), f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, text_col: str = "text", chars_col: str | None = "n_chars", least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least `least`, with all their columns and without a shuffle.

    A null or empty text scores by its statistics alone; null and repeated ids and repeated rows are judged each for
    itself; a missing chars_col counts as unknown; an empty table stays empty.
    """
    at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        declared = batch.column(at).to_pylist() if at is not None else [None] * len(texts)
        rows = [features(t, d) for t, d in zip(texts, declared, strict=True)]
        return batch.filter(pa.array(model.scores([r[0] for r in rows], np.array([r[1] for r in rows])) >= least))

    return change_rows(docs, text_col, run)
