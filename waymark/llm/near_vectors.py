"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

Vectors are normalised; a table hashes one by HASHES random projections (normal, hence 2-stable),
shifted and quantised to cells of WIDTH. At cosine 0.98 two vectors are at most 0.2 apart, and one
projection separates them with probability 0.10 (1.6 wide cells): all sixteen agree with
probability 0.18 or more, and one of 26 tables does with 0.995; vectors at right angles share a
bucket of a table with probability 6e-7. Vectors meet only within a bucket
of a table and a label, and every pair that meets is compared in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import connected_components, materialise

TABLES, HASHES, WIDTH, SEED = 26, 16, 1.6, 20_240_613
#: Vectors of a bucket that meet in one task; a larger bucket is dealt out in blocks, and all pairs of blocks meet.
BLOCK = 1024


@cache
def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES)


def bucket_keys(unit: np.ndarray) -> np.ndarray:
    """(vectors x TABLES) bucket numbers."""
    a, b = projections(unit.shape[1])
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, HASHES)
    odd = np.random.default_rng([SEED, 1]).integers(1, 2**62, HASHES) * 2 + 1
    with np.errstate(over="ignore"):
        return (cells * odd).sum(2)


def usable(v) -> bool:
    if v is None or not len(v) or any(x is None for x in v):
        return False
    x = np.array(v, float)
    return bool(np.isfinite(x).all() and x.any())


def directions(vectors: list) -> np.ndarray:
    """Vectors of one length, scaled to length 1."""
    x = np.array(vectors, float)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rows_of(found: list[tuple[int, int, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["rep", "links", "with"])


def meet(key: tuple | None, held: list[tuple[np.ndarray, ...]], least: float) -> list[tuple[int, int, int | None]]:
    """Links within a bucket's block (i = j) or between two of its blocks that no earlier table has shown.

    Rows (rep, links, None) count them, and rows (rep, 0, with) are a forest that tells what is connected.
    """
    if sum(len(h[0]) for h in held) < 2:
        return []
    table, i, j = key[1], key[2], key[3]
    rep, copies, own, label, unit = (np.concatenate(x) for x in zip(*held))
    keys = bucket_keys(unit)
    degree, edges, parent = np.zeros(len(rep), np.int64), [], list(range(len(rep)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rep) - 1):
        dots = unit[a + 1 :] @ unit[a]
        near = np.flatnonzero(dots >= least - 1e-9)
        if not len(near):
            continue
        sure = dots[near] >= least + 1e-9
        near += a + 1
        if not sure.all():  # at the threshold, as a plain sum of products
            near = near[sure | ((unit[near] * unit[a]).sum(1) >= least)]
        if i != j:
            near = near[own[near] != own[a]]
        near = near[(label[near] == label[a]) & (keys[near, table] == keys[a, table]) & ~(keys[near, :table] == keys[a, :table]).any(1)]
        if len(near):
            degree[a] += copies[near].sum()
            degree[near] += copies[a]
            for b in near.tolist():
                p, q = sorted((root(a), root(b)))
                if p != q:
                    parent[q] = p
                    edges.append((int(rep[a]), 0, int(rep[b])))
    return [(int(r), int(d), None) for r, d in zip(rep, degree) if d] + edges


def links(df: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per vector of df (vec_id, embedding, label): n_links, component_id and kept.

    Rows of null label, and vectors that are null, empty, zero or hold a null or non-finite
    component, link with nothing and are their own component. Equal vectors of a label are one
    class: they link with each other (cosine 1) and with whatever their class does. Vectors of
    different lengths never link. Labels are compared in their own type. Every row counts by itself:
    rows of a repeated vec_id link like others, and so do rows of null vec_id, which are never the
    smallest of a component (theirs is null where no other is in it). Other columns are left out; an
    empty table gives no rows.
    """
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    label_type = rows.schema["label"].dataType.simpleString()

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, labels = batch.column("embedding").to_pylist(), batch.column("label").is_valid().to_pylist()
            unit: list[np.ndarray | None] = [None] * len(vectors)
            by_dim: dict[int, list[int]] = {}
            for i, (v, labelled) in enumerate(zip(vectors, labels)):
                if labelled and usable(v):
                    by_dim.setdefault(len(v), []).append(i)
            for at in by_dim.values():
                for i, u in zip(at, directions([vectors[i] for i in at])):
                    unit[i] = u
            digest = [None if u is None else hashlib.blake2b((u + 0.0).tobytes(), digest_size=16).digest() for u in unit]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(unit, pa.list_(pa.float64())), pa.array(digest, pa.binary())], names=["vec_id", "label", "unit", "digest"])

    member = materialise(rows.mapInArrow(normalise, f"vec_id long, label {label_type}, unit array<double>, digest binary"), "vectors")
    # classes of equal direction, numbered as they are written
    same = member.filter("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = materialise(same.withColumn("rep", F.monotonically_increasing_id()), "classes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, table, key) of every class; vectors come later, to those that share a bucket."""
        for batch in batches:
            column = batch.column("unit")
            sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
            start = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                keys = bucket_keys(flat[start[at][:, None] + np.arange(dim)])
                kept = batch.take(pa.array(np.repeat(at, TABLES)))
                yield pa.RecordBatch.from_arrays([kept.column("rep"), kept.column("label"), pa.array(np.tile(np.arange(TABLES), len(at)).astype(np.int32)), pa.array(keys.ravel())], names=["rep", "label", "table", "key"])

    # a bucket is a label, a table and a key; only their hash is dealt, and all three are compared again where vectors meet
    keyed = classes.select("rep", "label", "unit").mapInArrow(spread, f"rep long, label {label_type}, table int, key long")
    buckets = materialise(keyed.select("rep", "table", F.xxhash64("label", "table", "key").alias("bucket")), "buckets")
    sizes = buckets.groupBy("bucket").count().filter("count > 1")
    dealt = (
        buckets.join(sizes, "bucket")
        .withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "table", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep")
    )

    parts = ["bucket", "table", "i", "j", "dim"]
    facts = classes.select("rep", "copies", F.xxhash64(F.col("label").cast("string")).alias("label"), F.size("unit").alias("dim"), "unit")
    ordered = dealt.join(facts, "rep").select(*[F.col(c).cast("long").alias(c) for c in (*parts, "own", "rep", "copies", "label")], "unit")
    ordered = ordered.repartition(*parts).sortWithinPartitions(*parts, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in parts], 1)
            plain = [batch.column(c).to_numpy() for c in ("rep", "copies", "own", "label")]
            flat = batch.column("unit").flatten().to_numpy()
            start = np.append(0, np.cumsum(where[:, -1]))
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if (key := tuple(where[a].tolist())) != now:
                    out += meet(now, held, least)
                    now, held = key, []
                held.append((*(x[a:b] for x in plain), flat[start[a] : start[b]].reshape(b - a, -1)))
            yield rows_of(out)
            out = []
        yield rows_of(meet(now, held, least))

    met = materialise(ordered.mapInArrow(run, "rep long, links long, with long"), "met")
    component = connected_components(met.filter("with is not null").select(F.col("rep").alias("a"), F.col("with").alias("b")), "vectors").withColumnRenamed("node", "rep")
    counted = met.groupBy("rep").agg(F.sum("links").alias("links"))
    placed = classes.select("rep", "label", "digest", "copies", "least").join(counted, "rep", "left").join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = placed.join(smallest, "component").select("label", "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = member.filter("digest is not null").select("vec_id", "label", "digest").join(found, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = member.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
