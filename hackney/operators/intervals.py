"""Sets of whole numbers as inclusive ranges, and their difference.

A set is a frame with ``first_batch`` and ``last_batch``; ranges may overlap. The
difference sweeps over the ends of all ranges: each adds one where it begins and takes
one off behind its end, and running sums tell which numbers only the left side holds.
"""

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENDS = ("first_batch", "last_batch")
# Ranges are cut at multiples of this, and each slice is swept by itself. Ranges that do
# not overlap have no more ends in a slice than it has numbers.
SLICE_WIDTH = 1_000_000


class Ranges(Sequence):
    """Ascending whole numbers, held as the ranges they make."""

    def __init__(self, ends: Iterable[tuple[int, int]]):
        self.ranges: list[range] = []
        for first, last in sorted(ends):
            if self.ranges and first <= self.ranges[-1].stop:
                begin, stop = self.ranges[-1].start, self.ranges[-1].stop
                self.ranges[-1] = range(begin, max(stop, last + 1))
            else:
                self.ranges.append(range(first, last + 1))

    def __len__(self) -> int:
        return sum(map(len, self.ranges))

    def __iter__(self) -> Iterator[int]:
        for part in self.ranges:
            yield from part

    def __getitem__(self, place):
        if isinstance(place, slice):
            return list(self)[place]
        place += len(self) if place < 0 else 0
        for part in self.ranges:
            if 0 <= place < len(part):
                return part[place]
            place -= len(part)
        raise IndexError(place)

    def __contains__(self, number) -> bool:
        return any(number in part for part in self.ranges)

    def overlap(self, first: int, last: int) -> bool:
        """Is any number from ``first`` to ``last`` among these?"""
        place = bisect_right(self.ranges, last, key=lambda part: part.start)
        return place > 0 and self.ranges[place - 1].stop > first

    def __eq__(self, other) -> bool:
        if isinstance(other, Ranges):
            return self.ranges == other.ranges
        if not isinstance(other, Sequence):
            return NotImplemented
        return len(self) == len(other) and all(a == b for a, b in zip(self, other, strict=True))

    __hash__ = None

    def __repr__(self) -> str:
        return f"Ranges({[(part.start, part.stop - 1) for part in self.ranges]})"


def as_ranges(numbers: DataFrame) -> DataFrame:
    """One range a row of ``batch_no``; NULL is no number."""
    return numbers.where("batch_no IS NOT NULL").select(*[F.col("batch_no").alias(end) for end in ENDS])


def as_numbers(ranges: DataFrame) -> DataFrame:
    """Every number of disjoint ranges, as ``batch_no``."""
    return ranges.select(F.explode(F.sequence(*ENDS)).alias("batch_no"))


def pending_ranges(available: DataFrame, processed: DataFrame, slice_width: int = SLICE_WIDTH) -> DataFrame:
    """The numbers of ``available`` that ``processed`` lacks, as disjoint ranges.

    Ranges that touch are one, but for those cut at a slice's border.
    """
    kind = available.schema[ENDS[0]].dataType

    def marks(ranges: DataFrame, left: int) -> DataFrame:
        first, last = (F.col(end).cast("bigint") for end in ENDS)
        slices = F.sequence(*[F.floor(end / F.lit(float(slice_width))) for end in (first, last)])
        cut = ranges.where(first <= last).select(
            first.alias("_first"), last.alias("_last"), F.explode(slices).alias("_slice")
        )
        begin = F.greatest("_first", F.col("_slice") * slice_width)
        behind = F.least("_last", F.col("_slice") * slice_width + (slice_width - 1)) + 1
        ends = F.array(
            *[F.struct(at.alias("at"), F.lit(step).alias("step")) for at, step in ((begin, 1), (behind, -1))]
        )
        return cut.select("_slice", F.explode(ends).alias("_end")).select(
            "_slice",
            F.col("_end.at").alias("at"),
            *[
                (F.col("_end.step") * F.lit(share)).alias(side)
                for side, share in (("_left", left), ("_right", 1 - left))
            ],
        )

    ends = marks(available, 1).unionByName(marks(processed, 0))
    ends = ends.groupBy("_slice", "at").agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))
    by_place = Window.partitionBy("_slice").orderBy("at")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, 0)
    wanted = (F.sum("_left").over(so_far) > 0) & (F.sum("_right").over(so_far) == 0)
    turns = ends.select("_slice", "at", wanted.alias("_wanted"))
    before = F.coalesce(F.lag("_wanted").over(by_place), F.lit(False))
    turns = turns.withColumn("_turns", F.col("_wanted") != before).where("_turns")
    return (
        turns.select("_wanted", "at", F.lead("at").over(by_place).alias("_next"))
        .where("_wanted")
        .select(
            F.col("at").cast(kind).alias(ENDS[0]), (F.col("_next") - 1).cast(kind).alias(ENDS[1])
        )
    )
