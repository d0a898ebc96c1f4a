"""Helpers shared by the training-data operators: table access, cut lineage, hashing, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.files import Files

#: Text bytes that one slice of an Arrow batch holds at most (a single longer text is a slice alone).
SLICE_BYTES = 4 << 20

#: Entries of a worker's word caches; a cache that is full starts anew.
CACHE_ENTRIES = 400_000
#: Entries of a worker's table of word hashes.
HASH_ENTRIES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or (unset, as in tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{tempfile.gettempdir()}/waymark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs restart from these files, not from its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised table that nothing will read again."""
    Files(df.sparkSession, df._stored_at).remove(df._stored_at)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of a batch with about `size` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class WordHashes(dict):
    """64-bit hash of each word, computed once per word and worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


#: Bytes of words that are hashed at once, and places in a word that have a weight of their own.
HASHED, PLACES = 1 << 20, 1 << 16
SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes (empty where there are fewer)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        # doubling: a run of 2w is a run of w times factor**w plus the next run of w
        parts, power, w, cur, start = [], factor, 1, h, 0  # (start, run hashes, factor of their length)
        left = width
        while left:
            if left & 1:
                parts.append((start, cur, power))
                start += w
            left >>= 1
            if left:
                cur = cur[: len(cur) - w] * power + cur[w:]
                power = power * power
                w *= 2
        out = np.zeros(n, np.uint64)
        for begin, run, step in parts:
            out = out * step + run[begin : begin + n]
    return mix(out ^ np.uint64(width))


def _numbers(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)


LETTER, PLACE = _numbers(0x5EED << 32, 256), _numbers(0x91ACE << 32, PLACES)
LOWER = LETTER[[c + 32 if 65 <= c <= 90 else c for c in range(256)]]


def hash_words(column: pa.StringArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end): words are what white space (ASCII) parts.

    A hash is the sum of products of a number for each byte and one for its place; with `lower`, A-Z
    count as a-z. Null texts have no words.
    """
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    inside = ~SPACES[data]
    begin, end = inside.copy(), inside.copy()
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # no word goes on from one text to the next
    begin[1:] &= ~inside[:-1]
    begin[edge] = inside[edge]
    end[:-1] &= ~inside[1:]
    end[edge - 1] = inside[edge - 1]
    start, size = np.flatnonzero(begin), np.flatnonzero(end) + 1
    size -= start
    out = np.empty(len(start), np.uint64)
    number = LOWER if lower else LETTER
    total = np.cumsum(size)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HASHED, side="right")))
        part = slice(start[a], start[b - 1] + size[b - 1])
        own = size[a:b]
        first = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        with np.errstate(over="ignore"):
            value = number[data[part][inside[part]]]
            if own.max() > PLACES:
                value *= mix((place // PLACES).astype(np.uint64)) | np.uint64(1)
                place %= PLACES
            out[a:b] = np.add.reduceat(value * PLACE[place], first)
        a = b
    return mix(out ^ size.astype(np.uint64) << np.uint64(1)), np.searchsorted(start, offsets)


#: The characters of Unicode White_Space.
WHITE_CHARS = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WHITE = "".join(f"\\u{ord(c):04x}" for c in WHITE_CHARS)
#: A text in pieces, each white space and then other characters: both tokenizers' patterns break at every edge.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
TWO_WHITE = re.compile(f"[{WHITE}]{{2}}")
ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split alone


def chunks(text: str, keep: bool = True) -> list[str]:
    """A text cut before white space; with keep=False the white space itself is left out."""
    if not keep:
        return text.split() if not ODD_SPACE.search(text) else [c for c in (x.lstrip(WHITE_CHARS) for x in CHUNK.findall(text)) if c]
    if TWO_WHITE.search(text):
        return CHUNK.findall(text)
    first, *rest = text.split(" ")  # single spaces: other white space stays inside a chunk
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component): component is the smallest node that links reach. edges: (a, b), either order, repeats allowed.

    Minimum labels are spread over the links and then over the labels themselves (pointer
    jumping), so rounds grow with the logarithm of the longest path. Every round is written to
    the shared folder; nothing but the count of changed labels reaches the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), tag)
    table = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), tag)
    while True:
        labels = table.select("node", "label")
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        once = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hop = once.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialise(once.join(hop, "label").select("node", "was", F.col("up").alias("label")), tag)
        discard(table)
        table = new
        if new.filter("was != label").isEmpty():
            discard(both)
            return new.select("node", F.col("label").alias("component"))
