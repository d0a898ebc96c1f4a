"""Quality rules: counts of a text, and a field over its lines that marks content or boilerplate.

Every line of a text is described by a few binned shares. Only documents are labelled, so lines get
training states of their own first: what looks like lines of good documents is content, wherever it
stands. A linear-chain conditional random field learns from these and is decoded by Viterbi's
algorithm; a text is kept if enough of its words stand in lines marked as content.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import crf
from waymark.llm._common import rolling, slices, word_hashes
from waymark.llm.quality import SYMBOLS, UPPER, NothingToLearn, training_rows

#: Labelled documents that the field is fitted on at most; lines of a chain at most, in training.
TRAIN_ROWS, CHAIN = 6_000, 64
MIN_WORDS, MAX_REPEAT, CONTENT_SHARE = 50, 0.5, 0.5
SPACE = b" \t\n\x0b\x0c\r"

#: Upper edges of the bins of each feature of a line.
EDGES = {
    "words": (1, 3, 8, 20, 60),
    "symbols": (0.001, 0.02, 0.05, 0.1, 0.2),
    "upper": (0.02, 0.06, 0.15, 0.4, 0.7),
    "bangs": (0.001, 0.02, 0.06),
    "pipes": (0.001, 0.02, 0.05),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
    "repeats": (0.001, 0.1, 0.3, 0.6),
    "seen": (0.5,),
}
SIZES = [len(e) + 1 for e in EDGES.values()]
SHIFTS = np.cumsum([0, *SIZES[:-1]])


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def count(text: str, raw: bytes, words: list[bytes], hashes: np.ndarray) -> Counts:
    """The base counts of one whole text."""
    spaces = len(raw) - len(raw.translate(None, SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    triples = rolling(hashes, 3)
    covered = np.zeros(len(words), bool)
    if len(triples):
        _, which, times = np.unique(triples, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[which] > 1)
        for k in range(3):
            covered[again + k] = True
    return Counts(len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), int(covered.sum()))


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bins, words) of the lines of a text that have a word."""
    rows, sizes, seen = [], [], set()
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        share = lambda chars: (size - len(line.translate(None, chars))) / size
        again = sum(map(bytes.__eq__, words[1:], words))
        rows.append((n, share(SYMBOLS.replace(b"|", b"")), share(UPPER), share(b"!"), share(b"|"), len(set(words)) / n if n > 8 else 1.0, again / n, line in seen))
        sizes.append(n)
        seen.add(line)
    x = np.array(rows, float).reshape(-1, len(EDGES))
    bins = np.stack([np.searchsorted(e, x[:, i], side="right") + SHIFTS[i] for i, e in enumerate(EDGES.values())], 1)
    return bins, np.array(sizes, np.int64)


class Model(NamedTuple):
    weight: np.ndarray
    moves: np.ndarray

    def mark(self, bins: list[np.ndarray]) -> list[np.ndarray]:
        """States of the lines of each text: 1 content, 0 boilerplate."""
        lengths = np.array([len(b) for b in bins], np.int64)
        flat = np.concatenate([*bins, np.zeros((0, len(EDGES)), np.int64)])
        states = crf.whole_viterbi(self.weight[flat].sum(1), lengths, self.moves)
        return np.split(states, np.cumsum(lengths)[:-1])


def neutral() -> Model:
    """The model of no labels: every line is content."""
    return Model(np.ones(sum(SIZES)), np.zeros((2, 2)))


def line_states(bins: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A state of its own for each line, from the labels of documents: 1 content, 0 boilerplate.

    Lines that repeat an earlier one of their document are boilerplate. The others are judged one by
    one: a field without moves learns from their documents' labels what lines of good documents look
    like, and a line that looks so is content, whatever document it stands in.
    """
    again = (bins == SHIFTS[-1] + 1).any(1)
    alone = np.ones(len(bins), np.int64)
    weight, _ = crf.fit([bins[:, k : k + 1] for k in range(len(EDGES))], np.where(again, 0.0, label)[:, None], alone, sum(SIZES), rounds=40)
    return ((weight[bins].sum(1) > 0) & ~again).astype(float)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fit on labels (doc_id, quality); all lines of at most `most` documents, in chains of CHAIN lines, reach the driver as bins. Raises NothingToLearn if none has a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features((t or "").encode("utf-8", "replace"))[0].ravel() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([f.tolist() for f in found], pa.list_(pa.int32()))], names=["doc_id", "label", "bins"])

    rows = sorted((r["doc_id"], r["label"], list(r["bins"])) for r in training_rows(docs, labels, "quality", most).mapInArrow(run, "doc_id long, label int, bins array<int>").toLocalIterator())
    rows = [r for r in rows if r[2]]
    if not rows:
        raise NothingToLearn("no labelled documents to learn from")
    lines = np.array([len(r[2]) // len(EDGES) for r in rows])
    flat = np.concatenate([np.array(r[2], np.int64) for r in rows]).reshape(-1, len(EDGES))
    states = line_states(flat, np.repeat(np.array([float(r[1]) for r in rows]), lines))
    _, first, length = crf.rectangle(lines, CHAIN)
    at = np.minimum(first[:, None] + np.arange(CHAIN), len(flat) - 1)
    cells = flat[at]
    weight, moves = crf.fit([cells[:, :, k] for k in range(len(EDGES))], states[at], length, sum(SIZES), rounds=40)
    return Model(weight, moves)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed and kept.

    A null text counts as empty; a text without words fails the base rules and has a content share
    of 0. Columns of docs ride through; columns of the new names are replaced.
    """
    new = [*Counts._fields, "content_share", "base_failed", "kept"]
    keep = docs.drop(*new)
    fields = ", ".join(f"`{c}` {t}" for c, t in keep.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, bins, sizes = [], [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    raw = text.encode("utf-8", "replace")
                    words = raw.split()
                    counts.append(count(text, raw, words, word_hashes(words)))
                    b, s = line_features(raw)
                    bins.append(b)
                    sizes.append(s)
                share = [float((m * s).sum() / max(1, s.sum())) for m, s in zip(model.mark(bins), sizes)]
                failed = [c.n_words < MIN_WORDS or 100 * c.n_repeat_words > 100 * MAX_REPEAT * c.n_words for c in counts]
                kept = [not f and x >= CONTENT_SHARE for f, x in zip(failed, share)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in zip(*counts)), pa.array(share), pa.array(failed), pa.array(kept)], names=[*part.schema.names, *new])

    kinds = ", ".join(f"{c} long" for c in Counts._fields)
    return keep.mapInArrow(run, f"{fields}, {kinds}, content_share double, base_failed boolean, kept boolean")
