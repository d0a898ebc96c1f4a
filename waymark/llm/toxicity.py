"""Toxicity: a linear-chain conditional random field tags toxic tokens; their marginals score the document.

Only documents are labelled, so the tokens' labels come first: in documents labelled toxic, the
words that set those documents apart are the toxic tokens, and all other tokens are not. The field
learns from these tags (a word, its neighbours, and the moves between tags). Forward-backward
marginals of all tokens of a whole text then give its score and the offsets of offending spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import crf
from waymark.llm._common import CACHE_ENTRIES, materialise, slices
from waymark.llm.quality import NothingToLearn, training_rows

#: Labelled rows that the field is fitted on at most.
TRAIN_ROWS = 20_000
#: Tokens of a chain in training; whole texts are cut into such chains, and equal ones are counted.
LESSON = 32
#: Share of toxic cases, natural logarithm of the odds against chance, and different toxic texts that a toxic word needs.
SHARE, SURPRISE, TEXTS = 0.85, 16.0, 3
#: Text bytes whose cases a worker holds at once.
CASE_BYTES = 1 << 20
#: Letters that a prefix in the vocabulary may have.
PREFIX = (3, 8)
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def word_of(token: bytes) -> str:
    """A token in lower case without characters that are no letters at its ends."""
    return EDGE.sub("", token.decode("utf-8", "replace")).lower()


def patterns(word: str) -> list[str]:
    """What the vocabulary may know a word by, most telling first: itself, then its prefixes."""
    return [word, *(f"{word[:k]}*" for k in range(min(PREFIX[1], len(word) - 1), PREFIX[0] - 1, -1))]


def hash_of(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word_of(token)) >> 1


class Indices(dict):
    """Vocabulary index of each token (0: none), worked out once per token and worker."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[token] = i = next((self.vocabulary[p] for p in patterns(word_of(token)) if p in self.vocabulary), 0)
        return i

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.fromiter(map(self.__getitem__, own), np.int64, len(own)) for own in map(tokens, texts)]


class Model(NamedTuple):
    vocabulary: dict[str, int]
    weight: np.ndarray  # of word, word before and word after, one after another
    moves: np.ndarray
    link: np.ndarray  # document score from (1, largest marginal, log(1 + their sum))

    def tag(self, index: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of all tokens of each document."""
        size = len(self.vocabulary) + 1
        lengths = np.array([len(x) for x in index], np.int64)
        flat = np.concatenate([*index, np.zeros(0, np.int64)]).astype(np.int64)
        ends = np.cumsum(lengths)
        before, after = np.concatenate([[0], flat])[:-1], np.concatenate([flat, [0]])[1:]
        before[(ends - lengths)[lengths > 0]] = after[ends[lengths > 0] - 1] = 0
        emission = self.weight[flat] + self.weight[size + before] + self.weight[2 * size + after]
        return np.split(crf.whole_marginals(emission, lengths, self.moves), ends[:-1])

    def score(self, on: list[np.ndarray]) -> np.ndarray:
        x = np.array([summary(p) for p in on]).reshape(-1, 3)
        return 1 / (1 + np.exp(-(x @ self.link)))


def neighbours(words: np.ndarray, size: int) -> list[np.ndarray]:
    none = np.zeros((len(words), 1), words.dtype)
    return [words, size + np.hstack([none, words[:, :-1]]), 2 * size + np.hstack([words[:, 1:], none])]


def summary(on: np.ndarray) -> tuple[float, float, float]:
    return 1.0, float(on.max(initial=0)), float(np.log1p(on[on > 0.05].sum()))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def lexicon(counts: list[tuple[int, int, int, int]], base: float) -> set[int]:
    """Words that set toxic documents apart. counts: word, toxic cases, cases, kinds of toxic texts; base: share of toxic cases among those of all words.

    A word's cases are counted by what stands before it, so the copies of one document count once.
    A word is taken if toxic cases prevail (17 of 20) by more than chance would give any of many words,
    and if toxic texts of at least three kinds have it; texts with the same words are of one kind.
    """
    chosen = set()
    for w, on, n, kinds in counts:
        share = on / n
        if share >= SHARE and kinds >= TEXTS:
            surprise = n * (share * np.log(share / base) + (1 - share) * np.log(max(1 - share, 1e-9) / (1 - base)))
            if surprise >= SURPRISE:
                chosen.add(w)
    return chosen


def neutral() -> Model:
    """The model of no labels: no token is toxic, and every text has a score of 0.01."""
    return Model({}, np.array([-20.0, 0.0, 0.0]), np.zeros((2, 2)), np.array([np.log(0.01 / 0.99), 0.0, 0.0]))


def case_counts(labelled: DataFrame) -> DataFrame:
    """(pattern, on, n): the cases of every word and prefix of labelled texts, and the toxic ones among them.

    A case is what stands before the word, as in lexicon(): it counts once, and is toxic if all its
    texts are. Cases are dealt by the first letters, which all patterns of a word share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=CASE_BYTES):
                same: dict[bytes, bytes] = {}  # one object a token
                raw: dict[tuple[bytes, bytes | None], int] = {}
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                    own = [same.setdefault(t, t) for t in tokens(text)]
                    for pair in set(zip(own, [None, *own])):
                        raw[pair] = min(raw.get(pair, 1), label)
                word, mark = {t: word_of(t) for t in same}, {None: 0} | {t: hash_of(t) for t in same}
                seen: dict[tuple[str, int], int] = {}
                for (token, before), label in raw.items():
                    pair = word[token], mark[before]
                    if pair[0]:
                        seen[pair] = min(seen.get(pair, 1), label)
                del raw
                cells = [pa.array([w for w, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.int64()), pa.array(seen.values(), pa.int32())]
                yield pa.RecordBatch.from_arrays(cells, names=["word", "before", "label"])

    prefixes = f"transform(sequence({PREFIX[0]}, least({PREFIX[1]}, length(word) - 1)), k -> concat(substring(word, 1, k), '*'))"
    known = F.expr(f"if(length(word) > {PREFIX[0]}, concat(array(word), {prefixes}), array(word))")
    dealt = labelled.select("text", "label").mapInArrow(run, "word string, before long, label int").withColumn("stem", F.substring("word", 1, PREFIX[0])).repartition("stem")
    cases = dealt.select("stem", F.explode(known).alias("pattern"), "before", "label").groupBy("stem", "pattern", "before").agg(F.min("label").alias("label"))
    return cases.groupBy("stem", "pattern").agg(F.sum("label").alias("on"), F.count("label").alias("n")).select("pattern", "on", "n")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fit on labels (doc_id, toxic) of at most `most` rows; raises NothingToLearn if there is none.

    The field learns from all tokens of these texts, in chains of LESSON, and the link from whole
    texts. What reaches the driver are the vocabulary, its counts, different chains with their
    numbers (all chains without a word of the vocabulary are one for each length), and two numbers a
    text.
    """
    labelled = materialise(training_rows(docs, labels, "toxic", most), "toxic")

    seen = materialise(case_counts(labelled), "patterns")
    cases = seen.filter("pattern not like '%*'").agg(F.sum("on"), F.sum("n")).collect()[0]  # of whole words
    base = min(0.5, max(0.01, (cases[0] or 0) / (cases[1] or 1)))
    share, rest = F.col("on") / F.col("n"), F.greatest(1 - F.col("on") / F.col("n"), F.lit(1e-9))
    odds = F.col("n") * (share * F.log(F.greatest(share, F.lit(1e-9)) / base) + (1 - share) * F.log(rest / (1 - base)))
    likely = seen.filter((share >= SHARE) & (odds >= SURPRISE)).orderBy("pattern").collect()
    vocabulary = {r["pattern"]: i for i, r in enumerate(likely, 1)}
    size = len(vocabulary) + 1

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Indices(vocabulary)
        for batch in batches:
            rows = []
            for text, label in zip(*(batch.column(c).to_pylist() for c in ("text", "label"))):
                own = tokens(text)
                where = sorted({(w, hash_of(own[i - 1]) if i else 0) for i, t in enumerate(own) if (w := index[t])})
                kind = xxhash.xxh3_64_intdigest(repr(where)) >> 1
                rows += [(w, before, label, kind) for w, before in where]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["word", "before", "label", "kind"])

    found = materialise(labelled.select("text", "label").mapInArrow(occurrences, "word int, before long, label int, kind long"), "occurrences")
    once = found.groupBy("word", "before").agg(F.min("label").alias("label")).groupBy("word").agg(F.sum("label").alias("on"), F.count("label").alias("n"))
    kinds = found.filter("label = 1").groupBy("word").agg(F.countDistinct("kind").alias("kinds"))
    toxic = lexicon([(r["word"], r["on"], r["n"], r["kinds"]) for r in once.join(kinds, "word").collect()], base)

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Indices(vocabulary)
        for batch in batches:
            counts: Counter = Counter()
            for own, label in zip(index.of(batch.column("text").to_pylist()), batch.column("label").to_pylist()):
                for i in range(0, len(own), LESSON):
                    part = tuple(own[i : i + LESSON].tolist())
                    counts[(label if any(part) else 0, part)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.list_(pa.int32())), pa.array(counts.values(), pa.int64())], names=["label", "chain", "n"])

    counted = labelled.select("text", "label").mapInArrow(chains, "label int, chain array<int>, n long").groupBy("label", "chain").agg(F.sum("n").alias("n"))
    rows = sorted((list(r["chain"]), r["label"], r["n"]) for r in counted.collect())
    if not rows:
        if not labelled.limit(1).count():
            raise NothingToLearn("no labelled documents to learn from")
        rows = [([0], 0, 1)]  # all texts are empty
    words = np.zeros((len(rows), LESSON), np.int64)
    for i, (chain, _, _) in enumerate(rows):
        words[i, : len(chain)] = chain
    label = np.array([r[1] for r in rows])
    state = np.isin(words, list(toxic)) & (label == 1)[:, None]
    weight, moves = crf.fit(neighbours(words, size), state.astype(float), np.array([len(r[0]) for r in rows]), 3 * size, rounds=400, offset=-4.0, times=np.array([r[2] for r in rows]))
    weight[:size] -= 4.0  # the offset of every token, as a part of its word's weight
    model = Model(vocabulary, weight, moves, np.zeros(3))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Indices(vocabulary)
        for batch in batches:
            for part in slices(batch):
                x = [summary(p) for p in model.tag(index.of(part.column("text").to_pylist()))]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([r[1] for r in x]), pa.array([r[2] for r in x])], names=["label", "most", "total"])

    texts = labelled.select("text", "label").mapInArrow(summaries, "label int, most double, total double").toPandas().sort_values(["most", "total", "label"])
    x = np.column_stack([np.ones(len(texts)), texts["most"], texts["total"]])
    return model._replace(link=logistic(x, texts["label"].to_numpy(float)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def spans(text: str, on: np.ndarray, least: float) -> list[dict[str, int]]:
    """Offsets (code points) of runs of tokens whose marginal is at least `least`."""
    found: list[dict[str, int]] = []
    last = -2
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if on[i] >= least:
            if last == i - 1:
                found[-1]["end"] = m.end()
            else:
                found.append({"start": m.start(), "end": m.end()})
            last = i
    return found


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= threshold, else 0) and spans (start, end of offending text).

    A null text counts as empty; an empty one has no token and gets the score of none. Columns of
    docs ride through; columns of the new names are replaced.
    """
    keep = docs.drop("score", "predicted", "spans")
    fields = ", ".join(f"`{c}` {t}" for c, t in keep.dtypes)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Indices(model.vocabulary)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                on = model.tag(index.of(texts))
                found = model.score(on)
                marked = [spans(t, p, 0.5) if p.max(initial=0) >= 0.5 else [] for t, p in zip(texts, on)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32)), pa.array(marked, kind)], names=[*part.schema.names, "score", "predicted", "spans"])

    return keep.mapInArrow(run, f"{fields}, score double, predicted int, spans array<struct<start:int,end:int>>")
