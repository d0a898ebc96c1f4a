"""Byte-level BPE encoding and decoding by merge replay over an inverted index.

The words of a block of texts (all that one task has read since the last replay) are laid out
once each as one array of symbols. An inverted index leads from a merge's rank to the positions
whose adjacent pair it joins; merges are applied in rank order to all their positions at once,
and only the two neighbours of a joined pair get new entries. Words do not interact, so a block's
replay gives the same ids as one over the whole corpus, without a shuffle of words: every task
replays the words it has not seen, and keeps their ids for the texts that follow.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._common import CACHE_ENTRIES, chunks, slices

#: Text bytes of a block; a replay passes all ranks, so blocks are larger than other operators' slices.
BLOCK_BYTES = 12 << 20

NONE = np.iinfo(np.int32).max


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encoder for one table of ranks. The table is a file on every worker (a few MB, as big as the vocabulary)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def scalar(self, word: bytes) -> list[int]:
        """One word, always joining the leftmost pair of the lowest rank."""
        parts = [bytes([x]) for x in word]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (none empty) as native 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        symbol = self.single[np.frombuffer(b"".join(words), np.uint8)]
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        following[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        rank = np.full(n, NONE, np.int32)
        live = np.ones(n, bool)
        inner = np.flatnonzero(following >= 0)
        rank[inner] = self.pair_ranks(symbol[inner], symbol[inner + 1])
        have = np.flatnonzero(rank < NONE).astype(np.int32)
        have = have[np.argsort(rank[have], kind="stable")]
        values, starts = np.unique(rank[have], return_index=True)
        first = dict(zip(values.tolist(), np.split(have, starts[1:])))
        index: dict[int, list[int]] = defaultdict(list)  # rank -> positions of left symbols, besides those of `first`
        heap, odd = values.tolist(), []
        while heap:
            r = heapq.heappop(heap)
            at = first.pop(r, None)
            if later := index.pop(r, None):
                at = np.array(sorted({*later, *(() if at is None else at.tolist())}), np.int32)
            if at is None:
                continue
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = following[at]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # runs such as "aaaa": left to right, none twice
                keep, last = [], -1
                for p, q in zip(at.tolist(), right.tolist()):
                    if p != last:
                        keep.append(p)
                        last = q
                at = np.array(keep, np.int32)
                right = following[at]
            beyond = following[right]
            symbol[at] = r
            following[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            rank[right] = NONE
            live[right] = False
            rank[at] = NONE
            touched = at[inside]
            rank[touched] = self.pair_ranks(symbol[touched], symbol[beyond[inside]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self.pair_ranks(symbol[left], symbol[following[left]])
            fresh = np.concatenate([touched, left])
            found = rank[fresh]
            for p, value in zip(fresh[found < NONE].tolist(), found[found < NONE].tolist()):
                if value < r:
                    odd.append(p)  # a lower rank that only now came about
                if value not in index and value not in first:
                    heapq.heappush(heap, value)
                index[value].append(p)
        word_of = np.repeat(np.arange(len(words)), lengths)[live]
        ids = symbol[live].tobytes()
        cuts = (4 * np.searchsorted(word_of, np.arange(len(words) + 1))).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for w in set(np.searchsorted(ends, np.array(odd, np.int64), side="right").tolist()):
            out[w] = np.array(self.scalar(words[w]), np.int32).tobytes()
        return out

    def learn(self, new: set[str]) -> None:
        """Ids of chunks (white space and what follows it), through their distinct words."""
        whole = [c for c in new if c.isalpha() or c[0] == " " and c[1:].isalpha()]  # each one match of the pattern
        split = {c: self.pattern.findall(c) for c in new.difference(whole)}
        words = list(set(whole).union(*split.values()))
        ids = dict(zip(words, self.replay([w.encode() for w in words])))
        self.known.update((c, ids[c]) for c in whole)
        self.known.update((c, b"".join([ids[p] for p in parts])) for c, parts in split.items())

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; the texts are one block, whose new words are replayed together."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new: set[str] = set()
        for text in texts:
            new.update(chunks(text))
        new.difference_update(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        for text in texts:
            yield np.frombuffer(b"".join(map(get, chunks(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))


_made: dict[tuple[str, str], MergeReplay] = {}


def replayer(path: str, pattern: str) -> MergeReplay:
    if (path, pattern) not in _made:
        _made[path, pattern] = MergeReplay(load_ranks(path), pattern)
    return _made[path, pattern]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of ids (array<int>); a null text counts as empty, an empty one has no ids.

    Other columns ride through; a column that already has the name of `ids` is replaced.
    """
    keep = df.drop(ids) if ids != text else df
    schema = T.StructType([*keep.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(ranks_path, pattern)
        for batch in batches:
            for block in slices(batch, text, BLOCK_BYTES):
                found = coder.encode([t or "" for t in block.column(text).to_pylist()])
                for part in slices(block, text):
                    here = lists([next(found) for _ in range(part.num_rows)])
                    yield pa.RecordBatch.from_arrays([*part.columns, here], names=[*part.schema.names, ids])

    return keep.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for; null ids give empty bytes, an id out of the table raises IndexError."""
    keep = df.drop(out) if out != ids else df
    schema = T.StructType([*keep.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(ranks_path, pattern)
        for batch in batches:
            column = batch.column(ids)
            flat, cuts = column.values.to_numpy(), column.offsets.to_numpy().tolist()
            found = [coder.decode(flat[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]  # a null list has no values
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    return keep.mapInArrow(run, schema)


def digest(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The report of op9: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    coded = decode(encode(df.select("doc_id", "text"), ranks_path, pattern).drop("text"), ranks_path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
