"""Substring dedup by level-wise doubling of repeated windows.

Levels are window lengths, each at most twice the one before, up to the final length: 13, 25, 50.
At a level, of the windows inside one of final length only the one with the smallest hash counts
(its anchor): two equal final windows have equal anchors at all levels, so nothing is missed and
one window in some twenty is looked up. Anchors that stand in one document alone end there; around
the others, the anchors of the next level are looked up, and so on until no candidate survives or
the final length is reached, where each word of a window that also starts in a document of a
smaller id is removed.

Tasks settle what repeats among their own texts first, so a passage of a third of all documents
sends one record per block of texts, not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import hash_words, mix, rolling, slices

#: Text bytes of a block whose repeats a task settles by itself.
BLOCK_BYTES = 16 << 20
#: Words of the shortest windows that a level may have (shorter ones only where the final length asks for them).
SHORTEST = 8
RUN = np.dtype([("doc", "<i8"), ("own", "<i8"), ("start", "<i4"), ("count", "<i4")])
SPAN = np.dtype([("start", "<i4"), ("end", "<i4")])


def levels(width: int) -> list[int]:
    """Window lengths of the levels below the final one, shortest first."""
    out = [-(-width // 2)]
    while (half := -(-out[0] // 2)) >= SHORTEST:
        out.insert(0, half)
    return out


def record(n: int) -> np.dtype:
    """Anchors of a document at n levels, and whether each is known to stand in several."""
    return np.dtype([("hash", "<u8", (n,)), ("doc", "<i8"), ("many", "?", (n,))])


def anchors(hashes: np.ndarray, width: int, part: int) -> np.ndarray:
    """Of each window of `width` words, the smallest hash of its windows of `part` words."""
    parts, reach = rolling(hashes, part), width - part + 1
    if len(parts) < reach:
        return np.empty(0, np.uint64)
    least, w = parts, 1
    while 2 * w <= reach:
        least, w = np.minimum(least[:-w], least[w:]), 2 * w
    rest = reach - w
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def by_bucket(values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of hashes; buckets are taken from their high bits."""
    bucket = ((values >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, starts[1:]))


def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


MAPPED = "bucket int, doc_id long, own long, payload binary, more binary"
MAPPED_NAMES, MAPPED_KINDS = ["bucket", "doc_id", "own", "payload", "more"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
FOUND = "doc_id long, own long, payload binary"


def split_by_doc(doc: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    if not len(doc):
        return
    order = np.lexsort((own, doc))
    cut = np.flatnonzero((doc[order][1:] != doc[order][:-1]) | (own[order][1:] != own[order][:-1])) + 1
    for at in np.split(order, cut):
        yield int(doc[at[0]]), int(own[at[0]]), at


def different(a: np.ndarray) -> np.ndarray:
    """Indices of one of each distinct row of (windows x levels)."""
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]).any(1))[: len(a)])
    key = a[at, 0]
    for k in range(1, a.shape[1]):
        key = mix(key) ^ a[at, k]
    return at[np.unique(key, return_index=True)[1]]


def several(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a value stands in more than one document."""
    if not len(values):
        return np.zeros(0, bool)
    order = np.lexsort((doc, values))
    first = np.append(True, values[order][1:] != values[order][:-1])
    head = np.flatnonzero(first)
    last = np.append(head[1:], len(order)) - 1
    out = np.empty(len(values), bool)
    out[order] = (doc[order][head] != doc[order][last])[np.cumsum(first) - 1]
    return out


def find_anchors(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Records of the first level. With a bucket: anchors to look up; without: those known to repeat at the last level, by document."""
    parts = levels(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, "text", BLOCK_BYTES):
                held = []
                words, first = hash_words(block.column("text"))
                for doc, f, t in zip(block.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist()):
                    hashes = words[f:t]
                    found = np.stack([anchors(hashes, width, k) for k in parts], 1)
                    found = found[different(found)]
                    a = np.empty(len(found), record(len(parts)))
                    a["hash"], a["doc"] = found, doc
                    held.append(a)
                a = np.concatenate(held)
                for k in range(len(parts)):
                    a["many"][:, k] = several(a["hash"][:, k], a["doc"])
                known = a["many"][:, -1]
                rows = [(None, doc, None, np.unique(a["hash"][known, -1][at]).tobytes(), None) for doc, _, at in split_by_doc(a["doc"][known], a["doc"][known])]
                a = np.concatenate([a[~known], a[known][different(a["hash"][known])]])  # anchors of several documents of the block are one record
                rows += [(b, None, None, a[at].tobytes(), None) for b, at in by_bucket(a["hash"][:, 0], buckets)]
                if rows:
                    yield batch_of(rows, MAPPED_NAMES, MAPPED_KINDS)

    return docs.mapInArrow(run, MAPPED)


def survivors(mapped: DataFrame, width: int, buckets: int, level: int) -> DataFrame:
    """Records whose anchor of this level stands in several documents, dealt by the next level's; after the last one: (doc_id, -, payload) of all anchors known to repeat."""
    n = len(levels(width))
    last = level == n - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = batch.filter(pa.array([b is None for b in batch.column("bucket").to_pylist()], pa.bool_()))
            yield known.select(["doc_id", "own", "payload"]) if last else known
            held += [np.frombuffer(x, record(n)) for x, b in zip(batch.column("payload").to_pylist(), batch.column("bucket").to_pylist()) if b is not None]
        if not held:
            return
        a = np.concatenate(held)
        del held
        order = np.argsort(a["hash"][:, level], kind="stable")
        a = a[order]
        here = a["hash"][:, level]
        group = np.cumsum(np.append(False, here[1:] != here[:-1]))
        a = a[several(here, a["doc"]) | (np.bincount(group, a["many"][:, level])[group] > 0)]
        if last:
            a = a[~a["many"][:, level]]  # documents of these are known
            rows = [(doc, None, np.unique(a["hash"][at, level]).tobytes()) for doc, _, at in split_by_doc(a["doc"], a["doc"])]
            names, kinds = ["doc_id", "own", "payload"], MAPPED_KINDS[1:4]
        else:
            rows = [(b, None, None, a[at].tobytes(), None) for b, at in by_bucket(a["hash"][:, level + 1], buckets)]
            names, kinds = MAPPED_NAMES, MAPPED_KINDS
        if rows:
            yield batch_of(rows, names, kinds)

    return deal(mapped, buckets).mapInArrow(run, FOUND if last else MAPPED)


def deal(mapped: DataFrame, buckets: int) -> DataFrame:
    """Records to their buckets, one partition each; records without one go anywhere."""
    return mapped.repartitionById(buckets, F.coalesce("bucket", F.pmod(F.xxhash64("doc_id", "own"), F.lit(buckets)).cast("int")))


def runs_of(doc: np.ndarray, own: np.ndarray, at: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """First index of each run of consecutive positions of one document (and one key)."""
    new = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    if key is not None:
        new |= key[1:] != key[:-1]
    return np.flatnonzero(np.append(True, new))


def spans_by_doc(doc: np.ndarray, own: np.ndarray, at: np.ndarray, width: int) -> list[tuple[int, int, bytes]]:
    """Word spans that windows at these positions cover, by document."""
    order = np.lexsort((at, own, doc))
    doc, own, at = doc[order], own[order], at[order]
    if not len(at):
        return []
    first = runs_of(doc, own, at)
    spans = np.empty(len(first), SPAN)
    spans["start"], spans["end"] = at[first], at[np.append(first[1:], len(at)) - 1] + width
    return [(d, o, spans[i].tobytes()) for d, o, i in split_by_doc(doc[first], own[first])]


def earlier(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document id has the same hash."""
    order = np.lexsort((doc, hashes))
    head = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1])) if len(order) else np.empty(0, np.int64)
    least = np.repeat(doc[order][head], np.diff(np.append(head, len(order))))
    out = np.empty(len(doc), bool)
    out[order] = doc[order] > least
    return out


def find_windows(joined: DataFrame, width: int, buckets: int) -> DataFrame:
    """Records of the final length, from texts with their repeated anchors of the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, "text", BLOCK_BYTES):
                parts = []
                hashed, first = hash_words(block.column("text"))
                for doc, own, known, f, t in zip(*(block.column(c).to_pylist() for c in ("doc_id", "own", "anchors")), first.tolist(), first[1:].tolist()):
                    words = hashed[f:t]
                    near = anchors(words, width, levels(width)[-1])
                    at = np.flatnonzero(np.isin(near, np.frombuffer(b"".join(known), "<u8")))
                    parts.append((np.full(len(at), doc), np.full(len(at), own), at, near[at], rolling(words, width)[at]))
                doc, own, at, anchor, hashes = map(np.concatenate, zip(*parts))
                gone = earlier(hashes, doc)
                rows = [(None, d, o, s, None) for d, o, s in spans_by_doc(doc[gone], own[gone], at[gone], width)]
                doc, own, at, anchor, hashes = (x[~gone] for x in (doc, own, at, anchor, hashes))
                if len(at):
                    first = runs_of(doc, own, at, anchor)
                    runs = np.empty(len(first), RUN)
                    runs["doc"], runs["own"], runs["start"] = doc[first], own[first], at[first]
                    runs["count"] = np.diff(np.append(first, len(at)))
                    for b, chosen in by_bucket(anchor[first], buckets):
                        take = np.concatenate([np.arange(f, f + c) for f, c in zip(first[chosen].tolist(), runs["count"][chosen].tolist())])
                        rows.append((b, None, None, runs[chosen].tobytes(), hashes[take].tobytes()))
                if rows:
                    yield batch_of(rows, MAPPED_NAMES, MAPPED_KINDS)

    return joined.mapInArrow(run, MAPPED)


def removed_spans(mapped: DataFrame, width: int, buckets: int) -> DataFrame:
    """(doc_id, own, payload): word spans of a document to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, hashes = [], []
        for batch in batches:
            known = batch.filter(pa.array([b is None for b in batch.column("bucket").to_pylist()], pa.bool_()))
            yield known.select(["doc_id", "own", "payload"])
            for b, r, h in zip(*(batch.column(c).to_pylist() for c in ("bucket", "payload", "more"))):
                if b is not None:
                    runs.append(np.frombuffer(r, RUN))
                    hashes.append(np.frombuffer(h, "<u8"))
        if not runs:
            return
        r, h = np.concatenate(runs), np.concatenate(hashes)
        n = r["count"].astype(np.int64)
        doc, own = np.repeat(r["doc"], n), np.repeat(r["own"], n)
        at = np.repeat(r["start"] - (np.cumsum(n) - n), n) + np.arange(len(h))
        gone = earlier(h, doc)
        rows = spans_by_doc(doc[gone], own[gone], at[gone], width)
        if rows:
            yield batch_of(rows, ["doc_id", "own", "payload"], MAPPED_KINDS[1:4])

    return deal(mapped, buckets).mapInArrow(run, FOUND)


def dedup(df: DataFrame, width: int = 50) -> DataFrame:
    """df with n_words, n_removed and kept_text (the words left, joined by one space).

    `width` is even and at least 2. A null text has no words; a text shorter than a window loses
    nothing; a null doc_id neither removes nor loses anything; rows of equal doc_id do not remove
    from each other. Other columns ride through; columns of the new names are replaced.
    """
    if width < 2 or width % 2:
        raise ValueError("width must be even and at least 2")
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.drop("n_words", "n_removed", "kept_text").withColumn("_own", F.xxhash64("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_own").alias("own"), "text").filter("doc_id is not null and text is not null")

    found = find_anchors(texts, width, buckets)
    for level in range(len(levels(width))):
        found = survivors(found, width, buckets, level)
    known = found.groupBy("doc_id").agg(F.collect_list("payload").alias("anchors"))
    cut = removed_spans(find_windows(texts.join(known, "doc_id").select("doc_id", "own", "text", "anchors"), width, buckets), width, buckets)
    spans = cut.groupBy("doc_id", "own").agg(F.collect_list("payload").alias("_spans"))
    spans = spans.select("doc_id", F.col("own").alias("_own"), "_spans")
    out = docs.join(spans, ["doc_id", "_own"], "left").select(*docs.columns, "_spans").drop("_own")
    kept = [c for c in out.columns if c != "_spans"]
    fields = ", ".join(f"`{c}` {t}" for c, t in out.dtypes if c != "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, found in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist()):
                    words = words_of(text)
                    stay = np.ones(len(words) + 1, bool)
                    for s in np.frombuffer(b"".join(found or []), SPAN).tolist():
                        stay[s[0] : s[1]] = False
                    left = [w for w, ok in zip(words, stay.tolist()) if ok] if found else words
                    rows.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
                columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, "n_words", "n_removed", "kept_text"])

    return out.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept_text string")
