"""Packs documents into sequences of bounded length by bin completion.

Only lengths decide a packing, and there are at most ``size`` of them. So the search
runs over the histogram of piece lengths, whose size does not grow with the data:
a plan says which lengths fill a sequence and how many sequences are filled so.
Tasks then hand the pieces of each length to their places by rank.

The search is branch and bound. A node takes the largest length left and tries all
undominated fillings of the space beside it, least waste first; a filling is
undominated if nothing left fits in its rest and no member can be swapped for a
larger one left. Each is made when the search comes to it. It is applied to as many
sequences as the counts allow and, after all others have been, to fewer. A branch
ends where its waste exceeds what a better packing than the incumbent may waste. The
first incumbent is best-fit decreasing. The search ends when the incumbent meets
the lower bound ceil(sum / size), when nothing is left to try, or after ``max_nodes``
fillings and dead ends, with the incumbent: every piece is packed in any case.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import word_tokens
from .scratch import small_batches, stage

SEQUENCE_IDS = 2048
END_ID = 0
#: Nodes of the search: fillings tried, and dead ends met in making them.
MAX_NODES = 6_000
#: Tables of sums in memory; others are made again when the search comes back.
TABLES = 32

#: Lengths of one sequence with their copies, largest first; sequences filled so.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit_decreasing(counts: dict[int, int], size: int) -> Plan:
    """Equal bins are kept as one entry with a count, so steps follow lengths."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # rest -> [[filling, bins]]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            rest = min((r for r in open_bins if r >= length), default=None)
            if rest is None:
                per = size // length
                full, part = divmod(left, per)
                if full:
                    open_bins[size - per * length].append([((length, per),), full])
                if part:
                    open_bins[size - part * length].append([((length, part),), 1])
                break
            filling, bins = open_bins[rest].pop()
            if not open_bins[rest]:
                del open_bins[rest]
            per = min(rest // length, left)
            used = min(bins, left // per)
            left -= used * per
            if bins > used:
                open_bins[rest].append([filling, bins - used])
            open_bins[rest - per * length].append([(*filling, (length, per)), used])
    return [(tuple(f), n) for group in open_bins.values() for f, n in group]


class _Sums:
    """For each k, the sums up to ``room`` that copies of ``lengths[k:end]`` make, as bits."""

    def __init__(self, held: deque, lengths: list[int], have: Callable[[int], int], end: int, room: int):
        self.held, self.lengths, self.have, self.end, self.room = held, lengths, have, end, room
        self.table: list[int] | None = None

    def get(self) -> list[int]:
        if self.table is None:
            sums, mask = 1, (1 << (self.room + 1)) - 1
            table = [sums]
            for length in reversed(self.lengths[: self.end]):
                left, step = min(self.have(length), self.room // length), 1
                while left:
                    step = min(step, left)
                    sums |= (sums << (step * length)) & mask
                    left -= step
                    step *= 2
                table.append(sums)
            self.table = table[::-1]
            if len(self.held) >= TABLES:
                self.held.popleft().table = None
            self.held.append(self)
        return self.table


def fillings(
    lengths: list[int], have: Callable[[int], int], rest: int, allowed: Callable[[], int], held: deque
) -> Iterator[tuple[tuple, int] | None]:
    """All undominated fillings of ``rest`` that waste at most what is allowed, with
    their waste: least waste, then largest members first; None for each dead end.

    Where nothing left fits in the waste, all copies of lengths up to it are members.
    Sums that the smaller lengths cannot make are not followed.
    """
    place = lambda limit, end: bisect_left(lengths, -limit, 0, end, key=lambda x: -x)

    def grow(at: int, room: int, members: tuple, left: int) -> Iterator[tuple[tuple, int] | None]:
        # ``left``: the least length above those at ``at`` that has copies left over; 0: none.
        if not room:
            if small:
                k = end - 1
                used = dict(members)
                while k >= 0 and have(lengths[k]) == used.get(lengths[k], 0):
                    k -= 1
                if k >= 0 and lengths[k] <= small[0][0] + waste:
                    yield None
                    return
            yield (*members, *small), waste
            return
        k, grew = place(room, end), False
        if k > at and have(lengths[k - 1]):
            left = lengths[k - 1]
        k = max(k, at)
        table = sums.get()
        while k < end and table[k] >> room & 1:
            length = lengths[k]
            copies = have(length)
            if copies and (not left or left > length + waste):
                for n in range(min(room // length, copies), 0, -1):
                    if table[k + 1] >> (room - n * length) & 1:
                        grew, table = True, None  # a waiting node holds no table
                        yield from grow(
                            k + 1, room - n * length, (*members, (length, n)), length if n < copies else left
                        )
                        table = sums.get()
            if copies:
                left = length
            k += 1
        if not grew:
            yield None

    sums = _Sums(held, lengths, have, len(lengths), rest)
    for waste in range(rest + 1):
        if waste > allowed():
            return
        end = place(waste, len(lengths))
        small = tuple((x, have(x)) for x in lengths[end:] if have(x))
        room = rest - waste - sum(x * n for x, n in small)
        if room < 0:
            return
        if end < sums.end:
            sums = _Sums(held, lengths, have, end, rest)
        if sums.get()[0] >> room & 1:
            yield from grow(0, room, (), 0)


class _Search:
    """State of the search: counts left, largest first, the path and its waste."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.counts, self.waste = size, counts, 0
        self.lengths = sorted(counts, reverse=True)
        self.path: Plan = []
        self.held: deque = deque()

    def moves(self, allowed: Callable[[], int]) -> Iterator[tuple[dict[int, int], int, int] | None]:
        """Fillings around the largest length left, each with its waste and the number
        of sequences; None for each dead end. The state must be the same at each step."""
        top = self.lengths[0]
        have = lambda x: self.counts[x] - (x == top)
        for fewer in count():
            more = False
            for found in fillings(self.lengths, have, self.size - top, allowed, self.held):
                if found is None:
                    yield None
                    continue
                filling, waste = defaultdict(int, {top: 1}), found[1]
                for length, copies in found[0]:
                    filling[length] += copies
                n = min(self.counts[k] // c for k, c in filling.items())
                n = min(n, allowed() // waste) if waste else n
                more = more or n > fewer + 1
                yield (filling, waste, n - fewer) if n > fewer else None
            if not more:
                return

    def apply(self, filling: dict[int, int], n: int, waste: int) -> None:
        for length, copies in filling.items():
            self.counts[length] -= copies * n
            if not self.counts[length]:
                self.lengths.remove(length)
        self.waste += waste * n
        self.path.append((tuple(sorted(filling.items(), reverse=True)), n))

    def undo(self, waste: int) -> None:
        filling, n = self.path.pop()
        for length, copies in filling:
            if not self.counts[length]:
                insort(self.lengths, length, key=lambda x: -x)
            self.counts[length] += copies * n
        self.waste -= waste * n


def complete_bins(counts: dict[int, int], size: int = SEQUENCE_IDS, max_nodes: int = MAX_NODES) -> Plan:
    """The plan with the fewest sequences that the search meets; {} gives []."""
    counts = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    bound = -(-total // size)
    best = best_fit_decreasing(counts, size)
    best_n = sum(n for _, n in best)
    if best_n <= bound:
        return best
    search = _Search(counts, size)

    def allowed() -> int:
        return (best_n - 1) * size - total - search.waste

    stack = [[search.moves(allowed), None]]  # moves left, waste of the one in force
    nodes = 1
    while stack and best_n > bound and nodes <= max_nodes:
        moves, in_force = stack[-1]
        if in_force is not None:
            search.undo(in_force)
            stack[-1][1] = None
        try:
            move = next(moves)
        except StopIteration:
            stack.pop()
            continue
        nodes += 1
        if move is None:
            continue
        filling, waste, n = move
        search.apply(filling, n, waste)
        stack[-1][1] = waste
        if search.lengths:
            stack.append([search.moves(allowed), None])
        elif (found := sum(m for _, m in search.path)) < best_n:
            best, best_n = list(search.path), found
    return best


def slots_of(plan: Plan) -> pd.DataFrame:
    """Where the pieces of each length go, by rank: ``n`` ranks from ``rank`` on, so
    many ``copies`` in each sequence from ``sequence`` on, at ``offset``."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for filling, n in plan:
        offset = 0
        for length, copies in filling:
            rows.append((length, ranks[length], copies, sequence, offset))
            ranks[length] += n * copies
            offset += length * copies
        sequence += n
    names = ["length", "rank", "copies", "sequence", "offset"]
    return pd.DataFrame(rows, columns=names, dtype=np.int64).sort_values(["length", "rank"])


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def cut_pieces(
    documents: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE_IDS, end_id: int = END_ID
) -> DataFrame:
    """Pieces of at most ``size`` ids of each document (doc_id, text), with end id.

    ``task`` and ``nth`` (the place among the task's pieces of the same length) let
    ranks be counted without a sort. A null text counts as empty: one piece, the end
    id. Repeated rows and null ids are documents of their own.
    """
    tokenizer = tokenizer or word_tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = word_tokens.shared(tokenizer), TaskContext.get().partitionId()
        seen, rows = np.zeros(size + 1, np.int64), []
        end = np.array([end_id], np.uint32)

        def row(doc_id, piece: int, ids: np.ndarray) -> None:
            n = len(ids)
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            rows.append((doc_id, piece, piece * size, n, crc, task, int(seen[n])))
            seen[n] += 1

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names
            )

        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                held, piece = [], 0
                for part in (*words.encode(text.as_py()), end):
                    held.append(part)
                    if (n := sum(map(len, held))) >= size:
                        ids = np.concatenate(held)
                        for at in range(0, n - size + 1, size):
                            row(doc_id, piece, ids[at : at + size])
                            piece += 1
                        held = [ids[n - n % size :]] if n % size else []
                if held:
                    row(doc_id, piece, np.concatenate(held))
                if len(rows) >= 10_000:
                    yield batch_of()
            if rows:
                yield batch_of()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, size: int = SEQUENCE_IDS, max_nodes: int = MAX_NODES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written pieces (see :func:`cut_pieces`).

    To the driver goes the histogram of lengths, at most ``size`` rows, and from it
    the slots, a few for each length; both are bounded by ``size`` whatever the
    number of documents.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        F.col("task").alias("of_task"),
        F.col("length").alias("of_length"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"),
    )
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    full = histogram.pop(size, 0)
    plan = complete_bins(histogram, size, max_nodes)
    slots = slots_of(plan + ([(((size, 1),), full)] if full else []))
    slots = slots.sort_values(["length", "rank"])
    bounds = spark.sparkContext.broadcast({c: slots[c].to_numpy(np.int64) for c in slots})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = bounds.value
        begin = np.searchsorted(s["length"], length.to_numpy())
        stop = np.searchsorted(s["length"], length.to_numpy(), "right")
        want = rank.to_numpy(np.int64)
        while (stop - begin > 1).any():  # by halves, all rows at once
            mid = (begin + stop) // 2
            right = s["rank"][np.minimum(mid, len(s["rank"]) - 1)] <= want
            wide = stop - begin > 1
            begin, stop = np.where(wide & right, mid, begin), np.where(wide & ~right, mid, stop)
        past = want - s["rank"][begin]
        copies = s["copies"][begin]
        return pd.DataFrame(
            {
                "sequence_id": s["sequence"][begin] + past // copies,
                "offset": s["offset"][begin] + past % copies * length.to_numpy(np.int64),
            }
        )

    placed = pieces.join(
        first, (pieces["task"] == first["of_task"]) & (pieces["length"] == first["of_length"])
    ).withColumn("place", place(F.col("length"), F.col("first") + F.col("nth")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"
    )


def op8(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Cuts, counts and packs all documents; a row for each piece.

    An empty table gives no rows. The pieces (no texts, no ids) are written once.
    """
    small_batches(spark)
    return pack(stage(spark, cut_pieces(documents), "pieces"))
