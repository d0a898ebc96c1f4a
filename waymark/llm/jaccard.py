"""N-gram Jaccard join by PartEnum signatures (exact at 0.8).

Sets whose sizes allow a similarity of 0.8 differ in at most k shingles. The domain of shingles is
cut into n partitions, more than k / 2, so that one of them holds at most one of these; each
partition is cut into three parts, and its three subsets of two parts are enumerated: one subset is
then free of differences. A signature is the hash of a set's shingles in one subset. Size bands
with a common n overlap by the factor 1.25, so that all sets that can be similar have a band in
common.

A set need not give all 3n signatures. A difference spoils two signatures of its partition, and
further ones there the third: at most `lost(k)` in all. Two sets that agree in all but so many of
theirs also share one among the first lost(k) + 1 in any order that both follow. Most shingles first
is such an order, and it leaves out the subsets that tell least. Likewise the domain may be
restricted: signatures are taken over shingles that are not frequent, and a set that has lost(k)
signatures or fewer this way gives those over all shingles as well (of two such sets, both do). The
frequent ones, at most FREQUENT, are found by counting over all documents; they steer the cost and
not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import connected_components, discard, hash_words, materialise, mix, rolling, slices
from waymark.llm.substrings import by_bucket

WIDTH = 5
#: Entries of the table of frequent shingles that every task gets (8 bytes each).
FREQUENT = 1 << 17
#: Members of a signature's group that are compared at once; larger groups are compared in three steps.
SMALL = 4
#: Members of a large group that all others meet first; members of a group that meet in one task.
PIVOTS, BLOCK = 2.0, 2048
ENTRY = np.dtype([("sig", "<u8"), ("set", "<i8")])
BLOCK_BYTES = 8 << 20


def shingle_sets(column: pa.StringArray) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of five words (A-Z in lower case), or of all words if there are fewer."""
    h, first = hash_words(column, lower=True)
    runs = rolling(h, WIDTH)  # those that reach into the next text are left out
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        out.append(np.unique(runs[a : b - WIDTH + 1]) if b - a >= WIDTH else rolling(h[a:b], max(1, b - a)))
    return out


def shingles(text: str | None) -> np.ndarray:
    """The same of one text."""
    return shingle_sets(pa.array([text], pa.string()))[0]


def set_id(s: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit integer."""
    with np.errstate(over="ignore"):
        total = mix(s ^ np.uint64(0x1B56C4E9)).sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total]))[0].astype(np.int64))


def allowed(size: int) -> int:
    """Shingles in which a set of this size and any set of similarity 0.8 or more differ at most."""
    return (size + size * 5 // 4) // 9


def bands(size: int) -> list[int]:
    """Bands of a size: band j holds the sizes from 2**j to below 2.5 * 2**j."""
    j = size.bit_length() - 1
    return [j, j - 1] if j and 4 * size < 10 * 2 ** (j - 1) else [j]


def partitions(band: int) -> int:
    return allowed(int(2.5 * 2**band)) // 2 + 1


def lost(k: int, n: int) -> int:
    """Signatures that k differences spoil at most in n partitions (k < 2n): two by the first of a partition, one more by others there."""
    return 2 * k if k <= n else n + k


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The signatures of a set of sorted shingle hashes."""
    k, out = allowed(len(s)), []
    at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
    rare = s[frequent[at] != s] if len(frequent) else s
    for band in bands(len(s)):
        n = partitions(band)
        most = lost(k, n)
        mine = enumerated(rare, n, 2 * band)
        out.append(_first(*mine, most + 1))
        if len(mine[0]) <= most:  # too few without frequent shingles
            full = enumerated(s, n, 2 * band + 1)
            out.append(_first(*full, most + 1))
            if len(full[0]) <= most:  # even so, agreement may be in empty subsets alone
                out.append(mix(np.array([2 * band + 1], np.uint64) ^ np.uint64(0xE0E0E0E0)))
    return np.concatenate(out)


def enumerated(s: np.ndarray, n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, shingles) of each subset of two of a partition's three parts that holds some of s."""
    part = (((s >> np.uint64(32)) * np.uint64(3 * n)) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(part, minlength=3 * n).reshape(n, 3)
    total = np.zeros(3 * n, np.uint64)
    if len(s):
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        total[part[first]] = np.add.reduceat(mix(s), first)
    total = total.reshape(n, 3)
    held = (count[:, [0, 0, 1]] + count[:, [1, 2, 2]]).ravel()
    with np.errstate(over="ignore"):
        pair = total[:, [0, 0, 1]] + total[:, [1, 2, 2]] * np.uint64(0x9E3779B97F4A7C15)
        sig = mix(pair.ravel() ^ (np.arange(3 * n, dtype=np.uint64) + np.uint64(kind << 40)) * np.uint64(0xD6E8FEB86659FD93))
    return sig[held > 0], held[held > 0]


def _first(sig: np.ndarray, held: np.ndarray, most: int) -> np.ndarray:
    return sig[np.lexsort((sig, -held))[:most]] if len(sig) > most else sig


def describe(docs: DataFrame) -> DataFrame:
    """kind 0: (id, n, set) of each document; kind 1: (shingle, count) of shingles that recur within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, "text", BLOCK_BYTES):
                sets = shingle_sets(block.column("text"))
                ids = [set_id(s) if len(s) else None for s in sets]
                yield _rows(0, block.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()))
                different = {i: s for i, s in zip(ids, sets) if i is not None}
                found, times = np.unique(np.concatenate([*different.values(), np.empty(0, np.uint64)]), return_counts=True)
                often = times >= max(3, len(different) // 500)
                yield _rows(1, pa.array(found[often].astype(np.int64)), pa.array(times[often].astype(np.int64)), pa.nulls(int(often.sum()), pa.int64()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind int, id long, n long, `set` long")


def _rows(kind: int, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *columns], names=["kind", "id", "n", "set"])


def sign(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, payload): the signatures of all sets, once per set and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, "text", BLOCK_BYTES):
                seen, held = set(), []
                for s in shingle_sets(block.column("text")):
                    if len(s) and (i := set_id(s)) not in seen:
                        seen.add(i)
                        sig = signatures(s, frequent)
                        e = np.empty(len(sig), ENTRY)
                        e["sig"], e["set"] = sig, i
                        held.append(e)
                if held:
                    e = np.concatenate(held)
                    rows = [(b, e[at].tobytes()) for b, at in by_bucket(e["sig"], buckets)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])

    return docs.select("text").mapInArrow(run, "bucket int, payload binary")


def groups(signed: DataFrame, buckets: int) -> DataFrame:
    """(sig, a, b, size): pairs of sets of small groups, and (b null) members of large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, ENTRY) for batch in batches for x in batch.column("payload").to_pylist()]
        if not held:
            return
        e = np.concatenate(held)
        del held
        e = e[np.lexsort((e["set"], e["sig"]))]
        again = np.append(False, (e["sig"][1:] == e["sig"][:-1]) & (e["set"][1:] == e["set"][:-1]))
        e = e[~again]
        first = np.flatnonzero(np.append(True, e["sig"][1:] != e["sig"][:-1]))
        size = np.diff(np.append(first, len(e)))
        pairs = []
        for n in range(2, SMALL + 1):
            head = first[size == n]
            pairs += [np.stack([e["set"][head + i], e["set"][head + j]], 1) for i in range(n) for j in range(i + 1, n)]
        found = np.unique(np.concatenate([*pairs, np.empty((0, 2), np.int64)]), axis=0)
        large = np.repeat(size > SMALL, size)
        sig, member, many = e["sig"][large].astype(np.int64), e["set"][large], np.repeat(size, size)[large]
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.full(len(found), 2))], names=["sig", "a", "b", "size"])
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(member), pa.nulls(len(sig), pa.int64()), pa.array(many)], names=["sig", "a", "b", "size"])

    return signed.repartitionById(buckets, "bucket").mapInArrow(run, "sig long, a long, b long, size long")


def verify(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) of pairs of sets, by exact comparison of their shingles. texts: (set, text)."""
    sized = pairs.join(sets.select(F.col("set").alias("a"), F.col("n").alias("na")), "a").join(sets.select(F.col("set").alias("b"), F.col("n").alias("nb")), "b")
    near = sized.filter("5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b")
    both = near.join(texts.select(F.col("set").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("set").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.empty(0, np.uint64)
        for batch in batches:
            linked = []
            for part in slices(batch, "tb"):
                names = part.column("a").to_pylist()
                new = [i for i, a in enumerate(names) if a != (names[i - 1] if i else last)]  # rows of a new first set
                ours = dict(zip(new, shingle_sets(part.column("ta").take(pa.array(new, pa.int64())))))
                last = names[-1]
                for i, other in enumerate(shingle_sets(part.column("tb"))):
                    kept = ours.get(i, kept)
                    common = len(np.intersect1d(kept, other, assume_unique=True))
                    linked.append(100 * common >= 80 * (len(kept) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles that fall to each of some bits: two sets differ in at least as many shingles as bits.

    The bits are a power of two, four to eight times the size; halves laid over each other give a smaller sketch.
    """
    bits = 8 << max(3, len(s).bit_length() - 1)
    at = (mix(s ^ np.uint64(0x51ED270B)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketches(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("set"), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], names=["set", "n", "bits"])

    return texts.mapInArrow(run, "`set` long, n long, bits binary")


def folded(bits: list[bytes]) -> np.ndarray:
    """(sets x words) of sketches, all as small as the smallest."""
    least = min(map(len, bits))
    rows = []
    for b in bits:
        x = np.frombuffer(b, "<u8")
        while 8 * len(x) > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows.append(x)
    return np.stack(rows)


def likely(active: DataFrame, sketched: DataFrame, most: int | None) -> DataFrame:
    """(a, b): pairs of a group in different components whose sketches allow a similarity of 0.8.

    One of a pair is outside its group's largest component. With `most`, each such set brings only
    that many partners of its group, those that differ least. Groups larger than BLOCK are dealt
    out in blocks, and all pairs of blocks meet.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = (
        active.select("sig", "set", "component", blocks.alias("blocks"))
        .withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "component")
        .join(sketched, "set")
    )
    ordered = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "set")

    def compare(rows: list[dict]) -> np.ndarray:
        sets, component, n, own = (np.array([r[c] for r in rows], np.int64) for c in ("set", "component", "n", "own"))
        values, times = np.unique(component, return_counts=True)
        outside = np.flatnonzero(component != values[times.argmax()])
        if not len(outside):
            return np.empty((0, 2), np.int64)
        bits, found = folded([r["bits"] for r in rows]), []
        apart = rows[0]["i"] != rows[0]["j"]
        for u in outside.tolist():
            far = np.bitwise_count(bits ^ bits[u]).sum(1, dtype=np.int64)
            ok = (9 * far <= n + n[u]) & (component != component[u]) & (5 * np.minimum(n, n[u]) >= 4 * np.maximum(n, n[u]))
            if apart:
                ok &= own != own[u]
            with_ = np.flatnonzero(ok)
            if most is not None and len(with_) > most:
                with_ = with_[np.argsort(far[with_], kind="stable")[:most]]
            found.append(np.stack([np.minimum(sets[u], sets[with_]), np.maximum(sets[u], sets[with_])], 1))
        return np.unique(np.concatenate(found), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                out = compare(held)
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["sig"], held[0]["i"], held[0]["j"]) != (row["sig"], row["i"], row["j"]):
                    yield from flush()
                    held = []
                held.append(row)
        yield from flush()

    return ordered.mapInArrow(run, "a long, b long")


def join(df: DataFrame) -> DataFrame:
    """One row per document of df (doc_id, text; other columns are left out): doc_id, n_shingles, component_id.

    Documents of equal sets are one class, and classes of similarity 0.8 or more are linked;
    component_id is the smallest doc_id that links reach. A null or empty text, or one without
    words, has no shingles and stands alone. Repeated rows stay; an empty table gives no rows.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialise(describe(docs), "sets")
    own = described.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("n"), "set")
    sets = materialise(own.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("first"), F.first("n").alias("n")), "classes")
    often = described.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter("n >= 20").orderBy(F.desc("n"), "id").limit(FREQUENT).select("id").toPandas()["id"]
    frequent = np.sort(often.to_numpy(np.int64).astype(np.uint64))

    grouped = materialise(groups(sign(docs, frequent, buckets), buckets), "groups")
    small = grouped.filter("b is not null").select("a", "b").distinct()
    hash_of = (F.xxhash64("a") / F.lit(2.0**64)) + 0.5  # the same for a set in all its groups
    large = grouped.filter("b is null").select("sig", F.col("a").alias("set"), "size", (hash_of * F.col("size")).alias("at"))
    members = grouped.select(F.col("a").alias("set")).union(grouped.filter("b is not null").select(F.col("b").alias("set"))).distinct()
    wanted = members.join(sets, "set").select("set", F.col("first").alias("doc_id"))
    texts = materialise(_one_text(docs, wanted), "texts")

    # Large groups. First every member meets a few of the others (those of the smallest hashes, the
    # same ones in all groups); then each that is not connected with the most of its group meets its
    # two likeliest partners; then all partners that its sketch does not rule out.
    # Members of a group are dealt out in blocks, and its pivots go to all of them.
    shares = F.ceil(F.col("size") / BLOCK).cast("int")
    pivots = large.filter(F.col("at") < PIVOTS).select("sig", F.col("set").alias("p"), F.col("at").alias("pat"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    met = large.withColumn("share", F.pmod(F.xxhash64("set"), shares).cast("int")).join(pivots, ["sig", "share"]).filter("at > pat").select(F.least("p", "set").alias("a"), F.greatest("p", "set").alias("b"))
    pairs = materialise(met.union(small).distinct(), "pairs")
    tried = materialise(verify(pairs, sets, texts), "checked")
    discard(pairs)
    component = connected_components(tried.filter("linked").select("a", "b"), "sets")
    sketched = materialise(sketches(texts), "sketches")
    for most in (2, None):
        placed = large.join(component.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        split = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("sig")
        active = materialise(placed.join(split, "sig"), "active")
        if not active.limit(1).count():
            break
        pairs = materialise(likely(active, sketched, most).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(materialise(verify(pairs, sets, texts), "checked"))
        discard(pairs)
        discard(active)
        component = connected_components(tried.filter("linked").select("a", "b"), "sets")

    placed = sets.join(component.withColumnRenamed("node", "set"), "set", "left").select("set", "first", F.coalesce("component", "set").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = placed.join(least, "component").select("set", "component_id")
    return own.join(classes, "set", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _one_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, text) of the documents that stand for their sets; of rows of one doc_id, the one with that set."""
    found = docs.join(wanted, "doc_id").select("set", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in slices(batch):
                keep = []
                for i, s in zip(part.column("set").to_pylist(), shingle_sets(part.column("text"))):
                    ok = i not in seen and set_id(s) == i
                    if ok:
                        seen.add(i)
                    keep.append(ok)
                yield part.filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(run, "`set` long, text string")
