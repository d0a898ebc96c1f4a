"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins; cyclic boosting adds, feature by feature, the steps of
shallow trees to one table of scores per feature, and then to one table per chosen pair of
features. A text's score is a sum of table entries, taken for whole batches at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import slices, word_hashes

#: Labelled rows that the model is fitted on at most, the ones with the smallest hashed doc_id.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6

FEATURES = ("log_bytes", "log_words", "word_bytes", "symbols", "upper", "digits", "pipes", "bangs", "stops", "distinct", "doubled", "top_word", "line_words", "repeated_lines", "non_ascii", "mark_runs")
SYMBOLS = b"#*$%&|<>"
#: An ASCII mark two or more times in a row.
RUN = re.compile(rb"([!-/:-@\[-`{-~])\1+")
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def features(text: str | None) -> list[float]:
    """Shares and sizes of one whole text, in the order of FEATURES; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    size = max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    hashes = word_hashes(words)
    _, counts = np.unique(hashes, return_counts=True)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), (size - n) / n,
        share(SYMBOLS), share(UPPER), share(DIGITS), share(b"|"), share(b"!"), share(b"."),
        len(counts) / n, float((hashes[1:] == hashes[:-1]).sum()) / n, float(counts.max(initial=0)) / n,
        len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        (len(raw) - len(raw.translate(None, bytes(range(128, 256))))) / size,
        len(RUN.findall(raw)) / n,
    ]


class AdditiveModel:
    """Lookup tables over binned features: edges[f], tables[f], and pairs {(f, g): table}."""

    def __init__(self, rounds: int = 60, rate: float = 0.15, leaves: int = 3):
        self.rounds, self.rate, self.leaves = rounds, rate, leaves

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        b = self.bin(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for f, table in enumerate(self.tables):
                step = self.rate * self._tree(*self._sums(b[:, f], y, score, len(table)))
                table += step
                score += step[b[:, f]]
        self.coarse = [np.minimum(np.arange(len(t)) * PAIR_BINS // len(t), PAIR_BINS - 1) for t in self.tables]
        c = np.stack([k[b[:, f]] for f, k in enumerate(self.coarse)], 1)
        gains = []
        for f, g in combinations(range(x.shape[1]), 2):
            gradient, weight = self._sums(c[:, f] * PAIR_BINS + c[:, g], y, score, PAIR_BINS**2)
            gains.append((float((gradient**2 / (weight + 1)).sum()), (f, g)))
        self.pairs = {fg: np.zeros(PAIR_BINS**2) for _, fg in sorted(gains, reverse=True)[:PAIRS]}
        for _ in range(self.rounds // 2):
            for (f, g), table in self.pairs.items():
                cell = c[:, f] * PAIR_BINS + c[:, g]
                step = self.rate * self._grid(*self._sums(cell, y, score, PAIR_BINS**2))
                table += step
                score += step[cell]
        return self

    @staticmethod
    def _sums(cell: np.ndarray, y: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return np.bincount(cell, y - p, n), np.bincount(cell, p * (1 - p), n)

    def _tree(self, gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Steps of a tree of few leaves over ordered bins: each split is the one that gains most."""
        g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
        gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
        cuts = [0, len(gradient)]
        for _ in range(self.leaves - 1):
            best = max(((float(gain(a, m) + gain(m, b) - gain(a, b)), m) for a, b in zip(cuts, cuts[1:]) for m in range(a + 1, b)), default=(0, 0))
            if best[0] <= 1e-9:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(len(gradient))
        for a, b in zip(cuts, cuts[1:]):
            out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
        return out

    @staticmethod
    def _grid(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Steps of a tree of depth two, one split along either feature: the best pair of cuts."""
        g, h = (np.pad(v.reshape(PAIR_BINS, PAIR_BINS).cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (gradient, weight))
        best, out = 0.0, np.zeros((PAIR_BINS, PAIR_BINS))
        for i in range(1, PAIR_BINS):
            for j in range(1, PAIR_BINS):
                parts = [(slice(a, b), slice(c, d), g[b, d] - g[a, d] - g[b, c] + g[a, c], h[b, d] - h[a, d] - h[b, c] + h[a, c]) for a, b in ((0, i), (i, PAIR_BINS)) for c, d in ((0, j), (j, PAIR_BINS))]
                gain = sum(x * x / (w + 1) for *_, x, w in parts)
                if gain > best:
                    best = gain
                    for rows, cols, x, w in parts:
                        out[rows, cols] = x / (w + 1)
        return out.ravel()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        b = self.bin(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[b[:, f]]
        for (f, g), table in self.pairs.items():
            total += table[self.coarse[f][b[:, f]] * PAIR_BINS + self.coarse[g][b[:, g]]]
        return 1 / (1 + np.exp(-total))


class NothingToLearn(ValueError):
    """No labelled document is left to learn from."""


def neutral() -> AdditiveModel:
    """The model of no labels: every text has a score of 0.5."""
    model = AdditiveModel()
    model.edges, model.tables, model.coarse = [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), []
    model.base, model.pairs = 0.0, {}
    return model


def learned(operator: Any, docs: DataFrame, labels: DataFrame) -> Any:
    """operator.train(docs, labels), or operator.neutral() where there is nothing to learn from."""
    try:
        return operator.train(docs, labels)
    except NothingToLearn:
        return operator.neutral()


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most `most` labelled documents that are not held out: those with the smallest hashed doc_id."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & ~held_out())
    chosen = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on labels (doc_id, quality); only features and labels of at most `most` rows reach the driver. Raises NothingToLearn if there is no such row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *map(pa.array, rows.T)], names=["doc_id", "label", *FEATURES])

    found = training_rows(docs, labels, "quality", most).mapInArrow(run, "doc_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(["doc_id", *FEATURES])
    if not len(found):
        raise NothingToLearn("no labelled documents to learn from")
    return AdditiveModel().fit(found[list(FEATURES)].to_numpy(), found["label"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0); a null text scores as an empty one.

    Columns of docs ride through; columns of the two new names are replaced.
    """
    keep = docs.drop("score", "predicted")
    fields = ", ".join(f"`{c}` {t}" for c, t in keep.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t) for t in part.column("text").to_pylist()]).reshape(-1, len(FEATURES))
                found = model.score(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return keep.mapInArrow(run, f"{fields}, score double, predicted int")
