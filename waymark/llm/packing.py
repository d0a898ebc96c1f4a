"""Best-fit packing of tokenised documents into sequences, by bin completion on length counts.

Only the number of pieces of each length matters, and lengths are whole numbers up to the
capacity: whatever the corpus, the driver solves a problem of at most `capacity` entries. Its
solution is a list of fillings (lengths of one sequence) with how many sequences use each; every
filling uses up some length, so the list is as bounded. Pieces then find their places by their
rank among the pieces of their length, which is counted in salted groups.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import materialise, slices
from waymark.llm.tokens import BLOCK_BYTES, encoder

Filling = tuple[tuple[int, int], ...]  # (length, times) of the pieces of one sequence
Plan = list[tuple[Filling, int]]  # fillings, and how many sequences have them

#: Steps (partial fillings, pieces of fillings that are judged, lengths whose sums are taken) of a search, at most, to improve on best fit or to prove that it cannot.
EFFORT = 500_000
#: Shortest lengths whose sums are worked out at each node, so that fillings of them meet no dead end (more cost time, not results).
LOOKED = 128


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing, all pieces of a length and all sequences of one content at a time."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [content, sequences]
    rooms: list[int] = []
    closed: Counter = Counter()

    def put(room: int, content: tuple, n: int) -> None:
        if not room:
            closed[content] += n
            return
        if not open_[room]:
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append([content, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                full, rest = divmod(left, fit)
                if full:
                    put(capacity - fit * length, ((length, fit),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            room = rooms[i]
            content, n = open_[room].pop()
            if not open_[room]:
                rooms.pop(i)
            fit = min(room // length, left)
            used = min(n, left // fit)
            if used < n:
                put(room, content, n - used)
            put(room - fit * length, (*content, (length, fit)), used)
            left -= used * fit
    for room in rooms:
        for content, n in open_[room]:
            closed[content] += n
    return list(closed.items())


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total, and (Martello and Toth) by pieces too large to share."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in lengths.tolist()], np.int64)
    many, size = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * lengths))
    half = np.searchsorted(lengths, capacity // 2, side="right")
    least = np.append(1, lengths[:half])  # pieces below this size are left out
    shared = np.searchsorted(lengths, capacity - least, side="right")
    small = size[half] - size[np.searchsorted(lengths, least)]
    room = capacity * (many[shared] - many[half]) - (size[shared] - size[half])
    by_size = many[-1] - many[half] + np.maximum(0, -((room - small) // capacity))
    return max(-(-int(size[-1]) // capacity), int(by_size.max()))


class Spent(Exception):
    """The search has taken all steps it may."""


def spread(bits: int, far: int) -> int:
    """The set bits, and all that lie above one of them by at most `far`."""
    reach = 0
    while reach < far:
        step = min(reach + 1, far - reach)
        bits |= bits << step
        reach += step
    return bits


class Remaining:
    """Pieces that are not placed yet: how many of each length, the lengths in order, and the same as a bit set."""

    def __init__(self, counts: dict[int, int], effort: int | None):
        self.count = dict(counts)
        self.lengths = sorted(counts)
        self.bits = sum(1 << k for k in counts)
        self.effort = effort

    def take(self, filling: Filling, times: int) -> None:
        """Place (or, with negative times, take back) sequences of this filling."""
        for k, m in filling:
            before, self.count[k] = self.count[k], self.count[k] - m * times
            if not self.count[k]:
                self.lengths.pop(bisect_left(self.lengths, k))
                self.bits ^= 1 << k
            elif not before:
                insort(self.lengths, k)
                self.bits ^= 1 << k

    def step(self, n: int) -> None:
        if self.effort is not None:
            self.effort -= n
            if self.effort < 0:
                raise Spent

    def sums(self, most: int) -> list[int]:
        """Bit sets of the sums, up to `most`, that the first i lengths give, for i up to LOOKED."""
        out = [1]
        self.step(len(self.lengths[:LOOKED]))
        for k in self.lengths[:LOOKED]:
            bits, some, step = out[-1], min(self.count[k], most // k), 1
            while some:
                step = min(step, some)
                bits |= bits << step * k
                some, step = some - step, 2 * step
            out.append(bits & ((2 << most) - 1))
        return out

    def exactly(self, target: int, upto: int, sums: list[int]) -> Iterator[Filling]:
        """Fillings of sum `target` by the first `upto` lengths, largest pieces first."""
        if not target:
            yield ()
            return
        for i in range(bisect_right(self.lengths, target, 0, upto) - 1, -1, -1):
            if i + 1 < len(sums) and not sums[i + 1] >> target & 1:
                return
            k = self.lengths[i]
            for m in range(min(self.count[k], target // k), 0, -1):
                self.step(1)
                left = target - m * k
                if i >= len(sums) or sums[i] >> left & 1:
                    for rest in self.exactly(left, i, sums):
                        yield ((k, m), *rest)

    def dominated(self, filling: Filling, slack: int) -> bool:
        """Whether some pieces of a filling could give way to one larger (or, of several, equal) piece outside it."""
        self.step(sum(m for _, m in filling))
        outside = self.bits
        one = several = 0  # sums of one piece, of two and more
        for k, m in filling:
            if self.count[k] == m:
                outside ^= 1 << k
            for _ in range(m):
                several |= several << k | one << k
                one |= 1 << k
        return bool(outside & (spread(several, slack) | (spread(one << 1, slack - 1) if slack else 0)))

    def completions(self, room: int, waste: int) -> Iterator[tuple[Filling, int]]:
        """Undominated (filling, slack) of `room` that waste at most `waste`, least waste first, one at a time."""
        sums = self.sums(room)
        for slack in range(min(waste, room) + 1):
            for filling in self.exactly(room - slack, len(self.lengths), sums):
                if not self.dominated(filling, slack):
                    yield filling, slack


def bin_completion(counts: dict[int, int], capacity: int, effort: int | None = EFFORT) -> Plan:
    """As few sequences as found: branch and bound around the largest remaining piece.

    The incumbent starts as the best-fit packing. A node fills the sequence of the largest piece by
    an undominated completion, first for as many sequences as the counts allow and later for fewer.
    A branch is given up when its waste leaves no way to beat the incumbent; where nothing fits any
    more, best fit places the rest, which may give a new incumbent. A descent uses up a length at
    every node, so it has at most `capacity` nodes whatever the corpus. The search ends when the
    lower bound is met or all branches are pruned. Bin packing being NP-hard, that may take forever
    on odd cases: after `effort` steps (None: no limit) the incumbent is returned as it is.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    if fewest == bound:
        return best
    spare = -sum(k * n for k, n in counts.items())  # what beating the incumbent leaves to waste, less (fewest - 1) sequences
    left = Remaining(counts, effort)
    plan: Plan = []
    wasted = 0

    def branches() -> Iterator[tuple[Filling, int, int]]:
        first = left.lengths[-1]
        left.take(((first, 1),), 1)
        found = left.completions(capacity - first, (fewest - 1) * capacity + spare - wasted)
        while True:
            filling, slack = next(found, (None, 0))
            left.take(((first, 1),), -1)
            if filling is None:
                return
            whole = ((first, filling[0][1] + 1), *filling[1:]) if filling and filling[0][0] == first else ((first, 1), *filling)
            times = min(left.count[k] // m for k, m in whole)
            while times:
                if wasted + slack * times <= (fewest - 1) * capacity + spare:
                    yield whole, times, slack
                times //= 2
            left.take(((first, 1),), 1)

    stack: list[list] = [[branches(), None, False]]  # untried branches, the one taken, whether there was any
    try:
        while stack:
            here = stack[-1]
            if here[1]:
                filling, times, slack = here[1]
                left.take(filling, -times)
                wasted -= slack * times
                plan.pop()
            here[1] = next(here[0], None)
            if here[1] is None:
                if not here[2]:  # nothing fits: best fit for the rest
                    left.step(32 * len(left.lengths))
                    tail = best_fit({k: left.count[k] for k in left.lengths}, capacity)
                    if (n := sum(m for _, m in plan) + sum(m for _, m in tail)) < fewest:
                        best, fewest = plan + tail, n
                stack.pop()
            else:
                filling, times, slack = here[1]
                here[2] = True
                left.take(filling, times)
                wasted += slack * times
                plan.append((filling, times))
                if left.lengths:
                    stack.append([branches(), None, False])
                elif (n := sum(m for _, m in plan)) < fewest:
                    best, fewest = list(plan), n
            if fewest == bound:
                break
    except Spent:
        pass
    return best


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and end_id, cut every `capacity` ids.

    A null or empty text is end_id alone. Rows with equal or null doc_id are documents of their own.
    Other columns are left out, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, step = encoder(tokenizer), np.array([end_id], "<u4"), 4 * capacity
        for batch in batches:
            for part in slices(batch, size=BLOCK_BYTES):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode([t or "" for t in part.column("text").to_pylist()])):
                    raw = np.concatenate([ids, end]).tobytes()
                    rows += [(doc, i // step, i // 4, len(cut) // 4, zlib.crc32(cut)) for i in range(0, len(raw), step) if (cut := raw[i : i + step])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """cut (rows with a `length` of 1 to capacity, and doc_id and piece) with sequence_id and offset.

    Which of several pieces of a length gets which place goes by doc_id and piece (ties: by start and
    ids_crc32, else any way). Other columns ride through; those of the two new names, and names that
    begin with an underscore, must not be among them. An empty table gives no rows.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    total = sum(counts.values())
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length -> (first rank, sequence, times, offset)
    taken: Counter = Counter()
    sequence = 0
    for content, n in bin_completion(counts, capacity):
        offset = 0
        for length, times in content:
            slots[length].append((taken[length], sequence, times, offset))
            taken[length] += n * times
            offset += length * times
        sequence += n
    where = {k: np.array(v, np.int64).T for k, v in slots.items()}

    # groups of a length that stay small whatever its count is
    group = max(1, total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.create_map(*[F.lit(x) for k, n in counts.items() if n > group for x in (k, -(-n // group))]) if any(n > group for n in counts.values()) else F.create_map().cast("map<bigint,int>")
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(salts[F.col("length")], F.lit(1)).cast("long")))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *[c for c in ("start", "ids_crc32") if c in cut.columns]))
    sizes = salted.groupBy("length", "_salt").count()
    before = sizes.select("length", "_salt", (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_rank") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence_id, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for k, rows in zip(values.tolist(), np.split(order, starts[1:])):
                first, seq, times, off = where[k]
                i = np.searchsorted(first, at[rows], side="right") - 1
                q = at[rows] - first[i]
                sequence_id[rows] = seq[i] + q // times[i]
                offset[rows] = off[i] + q % times[i] * k
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence_id), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    out = ranked.select(*cut.columns, "_rank")
    fields = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return out.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """All documents of df (doc_id, text; other columns are left out) in sequences of at most `capacity` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty table gives no rows.
    """
    return place(materialise(pieces(df, tokenizer, capacity, end_id), "pieces"), capacity)
