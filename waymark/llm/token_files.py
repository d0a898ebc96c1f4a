"""Token-id files: blocks of whole documents in Simple-8b words, readable block by block.

A file is a part of a Parquet data set whose rows are blocks, in order; Parquet gives atomic
commits, so a lost executor's half-written file is never seen. A block's `payload` is

    magic "S8B1", documents u32, ids u64, words u64          (24 bytes, little-endian)
    doc_id i64 x documents | null flag u8 x documents | end u64 x documents | word u64 x words

`end` is the offset in the block behind a document's last id; a document's ids begin with a word of
their own. A word is a 4-bit selector and 60 payload bits, lowest bits first:

    selector 0       run escape: 28-bit count above one 32-bit id
    selector 1       raw escape: one id of up to 60 bits
    selector 2..14   PACK[selector] = (ids, bits of each)
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import materialise, slices
from waymark.llm.tokens import BLOCK_BYTES, encoder

HEAD = struct.Struct("<4sIQQ")
#: The packings of the published Simple-8b scheme.
PACK = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30)}
BLOCK_IDS = 1 << 17
SELECTOR = np.uint64(60)


def encode_words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of ids below 2**60; each word takes as many of the next ids as fit."""
    return encode_runs(ids, np.array([len(ids)], np.int64))[0]


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if int(ids.max()) < 1 << 53:
        return np.maximum((ids.astype(float).view(np.int64) >> 52) - 1022, 0).astype(np.int8)
    return np.searchsorted(np.uint64(1) << np.arange(60, dtype=np.uint64), ids, side="right").astype(np.int8)


def ahead(widest: np.ndarray, by: int) -> np.ndarray:
    """The larger of each entry and the one `by` places on; entries that lack one count as too wide."""
    out = np.full(len(widest), 127, np.int8)
    if by < len(widest):
        np.maximum(widest[: len(widest) - by], widest[by:], out=out[: len(widest) - by])
    return out


def encode_runs(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of runs of ids that end at `ends`, each run from a word of its own, and where the runs' words end."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    ids = ids.astype(np.uint64)
    edges = np.append(0, ends)
    place = np.arange(n, dtype=np.int32)
    room = np.repeat(ends.astype(np.int32), np.diff(edges)) - place
    width = bit_lengths(ids)
    take, selector = np.ones(n, np.int32), np.ones(n, np.int8)
    widest = {1: width}  # of the next so many ids
    for s in sorted(PACK, reverse=True):  # ever more and narrower ids; where they fit, so do fewer and wider ones
        count, bits = PACK[s]
        half = 1 << (count.bit_length() - 1)
        if half not in widest:
            widest[half] = ahead(widest[half // 2], half // 2)
        fits = ((widest[half] if half == count else ahead(widest[half], count - half)) <= bits) & (room >= count)
        if not fits.any():
            break
        np.copyto(take, count, where=fits)
        np.copyto(selector, s, where=fits)
    same = ids[1:] == ids[:-1]
    if n > 4 and (same[3:] & same[2:-1] & same[1:-2] & same[:-3]).any():
        first = np.flatnonzero(np.append(True, ~same))
        size = np.diff(np.append(first, n))
        for a, k in zip(first[size > 4].tolist(), size[size > 4].tolist()):
            run = np.minimum(np.minimum(np.arange(k, 0, -1), room[a : a + k]), (1 << 28) - 1)
            better = np.flatnonzero((run > take[a : a + k]) & (run > 4) & (width[a] <= 32)) + a
            take[better], selector[better] = run[better - a], 0
    following, starts, i = (place + take).tolist(), [], 0
    while i < n:
        starts.append(i)
        i = following[i]
    start = np.array(starts)
    chosen = selector[start]
    words = chosen.astype(np.uint64) << SELECTOR
    escaped, ran = chosen == 1, chosen == 0
    words[escaped] |= ids[start[escaped]]
    words[ran] |= (take[start[ran]].astype(np.uint64) << np.uint64(32)) | ids[start[ran]]
    for s, (count, bits) in PACK.items():
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            shifted = ids[start[rows][:, None] + np.arange(count)] << np.arange(0, count * bits, bits, dtype=np.uint64)
            words[rows] |= np.bitwise_or.reduce(shifted, 1)
    return words, np.searchsorted(start, ends)


def decode_words(words: np.ndarray) -> np.ndarray:
    chosen = (words >> SELECTOR).astype(np.int64)
    count = np.array([0, 1, *(PACK[s][0] for s in range(2, 15)), 0])[chosen]
    payload = words & np.uint64((1 << 60) - 1)
    ran = chosen == 0
    count[ran] = (payload[ran] >> np.uint64(32)).astype(np.int64)
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    out[start[chosen == 1]] = payload[chosen == 1]
    for i in np.flatnonzero(ran):
        out[start[i] : start[i] + count[i]] = payload[i] & np.uint64(0xFFFFFFFF)
    for s, (n, bits) in PACK.items():
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            unpacked = payload[rows][:, None] >> np.arange(0, n * bits, bits, dtype=np.uint64) & np.uint64((1 << bits) - 1)
            out[start[rows][:, None] + np.arange(n)] = unpacked
    return out


def pack_block(docs: list[int | None], n_ids: list[int], words: list[bytes]) -> bytes:
    """A block of documents from their numbers of ids and their Simple-8b words."""
    ends = np.cumsum(n_ids, dtype=np.uint64)
    flags = np.array([d is None for d in docs], np.uint8)
    payload = b"".join(words)
    head = HEAD.pack(b"S8B1", len(docs), int(ends[-1]), len(payload) // 8)
    return b"".join([head, np.array([d or 0 for d in docs], "<i8").tobytes(), flags.tobytes(), ends.astype("<u8").tobytes(), payload])


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ends, ids) of a block."""
    magic, n, total, words = HEAD.unpack_from(block)
    if magic != b"S8B1":
        raise ValueError("not a token block")
    at = HEAD.size
    docs = np.frombuffer(block, "<i8", n, at)
    flags = np.frombuffer(block, np.uint8, n, at + 8 * n)
    ends = np.frombuffer(block, "<u8", n, at + 9 * n).astype(np.int64)
    ids = decode_words(np.frombuffer(block, "<u8", words, at + 17 * n))
    if len(ids) != total:
        raise ValueError("a token block is damaged")
    return [None if f else d for d, f in zip(docs.tolist(), flags.tolist())], ends, ids


def place_of(ids: list[int]) -> Column:
    """File of a row: between which of these (sorted) ids its own is. Rows of an id that is there more than once are dealt by their texts' hashes."""
    cuts = F.array(*map(F.lit, ids)) if ids else F.array().cast("array<bigint>")
    below, equal = F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))), F.size(F.filter(cuts, lambda c: c == F.col("doc_id")))
    share = F.col("hash") / F.lit(2.0**64) + 0.5  # grows with the hash
    return F.coalesce((below + F.floor(share * (equal + 1))).cast("int"), F.lit(0))


def write(df: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the ids of all texts (each with end_id behind it) in ascending doc_id order; returns the files' blocks.

    Blocks: (file, block, first, n_ids, payload), `first` being the ids before the block in its
    file. Files are ranges of doc_id, cut by its quantiles; texts are encoded where they are read,
    and only their Simple-8b words are dealt out. Rows of equal doc_id are ordered by a hash of their
    text, null ids come first, a null text counts as empty. Columns other than doc_id and text are
    left out.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0]  # one number a file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, size=BLOCK_BYTES):
                own = coder.encode([t or "" for t in part.column("text").to_pylist()])
                sizes = np.array([len(x) + 1 for x in own], np.int64)
                block = (np.cumsum(sizes) // BLOCK_IDS).tolist()
                for k in range(block[0], block[-1] + 1):
                    a, b = bisect_left(block, k), bisect_right(block, k)
                    if a == b:
                        continue
                    words, ends = encode_runs(np.concatenate([y for x in own[a:b] for y in (x, end)]), np.cumsum(sizes[a:b]))
                    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(8 * np.append(0, ends)), pa.py_buffer(words)])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id")[a:b], part.column("hash")[a:b], pa.array(sizes[a:b]), cells.cast(pa.binary())], names=["doc_id", "hash", "n", "words"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, words, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([pack_block(docs, sizes, words)], pa.binary())], names=["file", "block", "first", "n_ids", "payload"])

        for batch in batches:
            for doc, size, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "words"))):
                docs.append(doc)
                sizes.append(size)
                words.append(own)
                held += size
                if held >= BLOCK_IDS:
                    yield flush()
                    block, first, docs, sizes, words, held = block + 1, first + held, [], [], [], 0
        if docs:
            yield flush()

    coded = rows.withColumn("hash", F.xxhash64("text")).mapInArrow(encode, "doc_id long, hash long, n long, words binary")
    ordered = coded.repartitionById(n, place_of(sorted(cuts or []))).sortWithinPartitions("doc_id", "hash")
    return materialise(ordered.mapInArrow(gather, "file int, block int, first long, n_ids long, payload binary"), "tokens")


def read(blocks: DataFrame, keep_ids: bool = False) -> DataFrame:
    """One row per document of written files: doc_id, start, n_tokens, ids_crc32 (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["file", "first", "payload"]).to_pylist():
                docs, ends, ids = unpack_block(row["payload"])
                starts = np.concatenate([[0], ends[:-1]])
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([row["file"]] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(row["first"] + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                names = ["file", "doc_id", "at", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    # one row per file: their running total is a few rows, whatever the corpus
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    schema = "file int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    rows = blocks.select("file", "first", "payload").mapInArrow(run, schema).join(before, "file")
    return rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)
