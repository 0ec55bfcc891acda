"""Quality classifier: histogram gradient-boosted trees over document statistics.

``fit_quality`` learns from a bounded sample of labelled rows, ``score_quality`` scores whole texts.
The trees are complete binary trees in flat arrays (feature, threshold and leaf value by node number), so
a batch walks all trees at once in numpy, one step a level.

Defined results: a null text counts as empty and is scored like any other; repeated rows are scored each;
labels that are null or neither 0 nor 1 are ignored, and every row of a repeated label is an example; with
no example the score is 0.5, with one class only it is the class's share. Columns of the input other than id
and text are never read by a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecast_duel.llm.common import fold, hash_share, text_chunks

#: Most labelled rows that a classifier is fitted on.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
N_FEATURES = 28

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _SYMBOL, _HIGH, _OTHER = range(9)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, _OTHER, np.uint8)
    for kind, text in (
        (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_DIGIT, "0123456789"),
        (_SPACE, " \t\r\f\v"), (_LINE, "\n"), (_STOP, ".,;:!?'\"()-"), (_SYMBOL, "#$%&*+/<=>@[\\]^_`{|}~"),
    ):
        classes[list(text.encode())] = kind
    classes[128:] = _HIGH
    return classes


BYTE_CLASS = _byte_classes()


def statistics(text: str) -> list[float]:
    """The N_FEATURES statistics of one whole text."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    n = max(len(data), 1)
    kinds = np.bincount(BYTE_CLASS[data], minlength=9) / n
    counts = np.bincount(data, minlength=256)
    shares = counts[counts > 0] / n
    words = text.split()
    n_words = max(len(words), 1)
    known = {}
    for word in words:
        known[word] = known.get(word, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [line for line in text.split("\n") if line]
    n_lines = max(len(lines), 1)
    distinct_pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(data)), np.log1p(len(words)), *kinds,
        float(-(shares * np.log2(shares)).sum()) if len(data) else 0.0,
        sizes.mean(), sizes.std(), np.log1p(sizes.max()), (sizes <= 3).sum() / n_words,
        len(known) / n_words, max(known.values(), default=0) / n_words,
        sum(1 for w in known.values() if w == 1) / n_words,
        distinct_pairs / max(len(words) - 1, 1),
        np.log1p(len(lines)), len(data) / n_lines, len(set(lines)) / n_lines,
        sum(w.isupper() for w in words) / n_words, sum(w.isalpha() for w in words) / n_words,
        sum(w[0].isupper() for w in words) / n_words, sum(not w[-1].isalnum() for w in words) / n_words,
        len(zlib.compress(raw, 1)) / n,
    ]


def statistics_of(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t or "") for t in texts.to_pylist()]
    return np.array(rows, np.float64).reshape(-1, N_FEATURES)


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth; node i of a tree has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; values above it go right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.base + self.leaf[trees, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1,
         bins: int = 64, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Boosting on the logistic loss; splits come from histograms of gradient and curvature by bin."""
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    if len(y) and (y.min() == y.max()):
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-score))
        gradient, curve = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            best = np.full(wide, 1e-9)
            chosen = np.full((wide, 2), -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = local * bins + binned[:, f]
                g = np.bincount(cell, gradient, wide * bins).reshape(wide, bins).cumsum(axis=1)
                h = np.bincount(cell, curve, wide * bins).reshape(wide, bins).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain = np.where((hl >= least) & (ht - hl >= least), gain, 0.0)
                at = gain.argmax(axis=1)
                top = gain[np.arange(wide), at]
                better = (top > best) & (at < len(e))
                best[better] = top[better]
                chosen[better] = np.stack([np.full(wide, f), at], axis=1)[better]
            for i in range(wide):
                f, at = chosen[i]
                if f >= 0:
                    feature[first + i], threshold[first + i] = f, edges[f][at]
            go = x[np.arange(len(y)), feature[node]] > threshold[node]
            node = 2 * node + 1 + go
        at = node - inner
        value = -rate * np.bincount(at, gradient, inner + 1) / (np.bincount(at, curve, inner + 1) + penalty)
        score += value[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(leaves))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, folds: int = 5, held: int = 0) -> Trees:
    """Trees fitted on at most ``sample_rows`` labelled rows outside the held-out fold.

    The sample is the rows with the smallest hashes of their id, so it does not depend on partitions.
    Only its statistics reach the driver.
    """
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
        .where(fold("id", folds) != held)
        .orderBy(hash_share("id"), "id", "y")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The sample has a stated size, whatever the size of the tables.
    sample = texts.join(F.broadcast(marked), "id").select("id", "text", "y")

    def measure(batches):
        for batch in batches:
            for i, j, _, _ in text_chunks(batch, "text"):
                part = batch.slice(i, j - i)
                x = statistics_of(part.column("text"))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict({"id": part.column("id").cast(pa.string()), "y": part.column("y"), "x": values})

    rows = sample.mapInArrow(measure, "id string, y int, x array<double>").toArrow().to_pydict()
    order = np.lexsort((np.array(rows["y"], np.int64), np.array(rows["id"], object).astype(str))) if rows["y"] else []
    x = np.array(rows["x"], np.float64).reshape(-1, N_FEATURES)[order]
    return grow(x, np.array(rows["y"], np.float64)[order])


def score_quality(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with one column more: the share of good documents expected among such texts, 0 to 1."""
    names = [c for c in docs.columns if c != score_col]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(score_col, T.DoubleType())])

    def run(batches):
        # A piece at a time, so that a task holds no more than about a megabyte of texts as Python objects and as output.
        for batch in batches:
            for i, j, _, _ in text_chunks(batch, text_col):
                part = batch.slice(i, j - i)
                score = trees.score(statistics_of(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score)], names=[*names, score_col])

    return docs.select(*names).mapInArrow(run, schema)
