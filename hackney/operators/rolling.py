"""Rolling interval statistics that stay linear on hot groups.

A sliding ``RANGE BETWEEN INTERVAL ... PRECEDING`` window puts a whole zone in
one task and re-aggregates its frame for every row. Here the same answers come
from running totals: an instant adds its trips when it arrives and takes them
back when it leaves the frame, so a frame total is one prefix sum.

1. Trips are pre-aggregated per (zone, instant) with map-side combine, so a
   hot zone or a hot instant shrinks before any shuffle.
2. Every instant becomes a few marks (arrives, leaves the 1 h frame, ...),
   cut into short time slices. A (zone, slice) group is bounded by the clock,
   not by the data.
3. Totals per slice, summed in order per zone, give the state each slice
   starts from; it joins the slice as its first marks.
4. Running sums inside each slice give the statistics of every instant.
5. The trips pick them up by an equi-join on (zone, instant), whose right side
   is unique, so adaptive execution can split a hot key freely.

All sums are integers, hence exact. Both frame ends are inclusive and trips of
the same instant are in each other's frame, as in a RANGE window.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frame:
    """One interval frame: ``back`` ends at the current row, ``ahead`` starts there."""

    count: str
    back: timedelta | None = None
    ahead: timedelta | None = None
    average: str | None = None

    def __post_init__(self):
        if (self.back is None) == (self.ahead is None):
            raise ValueError("a frame looks either back or ahead")
        if self.ahead is not None and self.average is not None:
            raise ValueError("averages are defined for frames that look back")


# Kinds of marks: 0 an arrival; n a departure from frame n; -n an early mark of
# look-ahead frame n; OPENING + n the state frame n starts a slice with.
ARRIVAL = 0
OPENING = 1000


def _slice_number(at: Column, seconds: int) -> Column:
    # From the wall-clock fields: no session time zone is involved.
    clock = (
        F.unix_date(F.to_date(at)).cast("bigint") * 86400
        + F.hour(at) * 3600
        + F.minute(at) * 60
        + F.second(at)
    )
    return F.floor(clock / F.lit(seconds))


def _change(number: int, frame: Frame, measure: str) -> Column:
    """What a mark adds to a running total of frame ``number``."""
    kind, amount = F.col("_kind"), F.col(measure)
    enters, leaves = (
        (ARRIVAL, number) if frame.back is not None else (-number, ARRIVAL)
    )
    return (
        F.when(kind.isin(enters, OPENING + number), amount)
        .when(kind == leaves, -amount)
        .otherwise(F.lit(0))
    )


def rolling_statistics(
    rows: DataFrame,
    partition: str,
    order: str,
    frames: Sequence[Frame],
    value: str | None = None,
    slice_seconds: int = 600,
) -> DataFrame:
    """``rows`` plus the count (and average of an integer ``value``) per frame.

    ``order`` is a zone-less timestamp. Rows with a NULL order value are each
    other's frame, as in a RANGE window.
    """
    amount = F.col(value) if value else F.lit(None).cast("int")
    instants = rows.groupBy(
        F.col(partition).alias("_zone"), F.col(order).alias("_at")
    ).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(amount).alias("_values"),
        F.coalesce(F.sum(amount), F.lit(0)).alias("_total"),
    )

    # At one moment: early marks of look-ahead frames, then the arrival, then
    # departures, which keeps both frame ends inclusive.
    at = F.col("_at")
    marks = [F.struct(F.lit(ARRIVAL).alias("kind"), at.alias("at"))]
    for number, frame in enumerate(frames, start=1):
        if frame.back is not None:
            kind, moment = number, at + F.lit(frame.back)
        else:
            kind, moment = -number, at - F.lit(frame.ahead)
        marks.append(F.struct(F.lit(kind).alias("kind"), moment.alias("at")))

    measures = ["_rows", "_values", "_total"]
    events = (
        instants.withColumn("_mark", F.explode(F.array(*marks)))
        .select("_zone", "_mark.at", "_mark.kind", *measures)
        .select(
            "_zone",
            _slice_number(F.col("at"), slice_seconds).alias("_slice"),
            F.col("at").alias("_at"),
            F.col("kind").alias("_kind"),
            *measures,
        )
    )

    totals = {
        f"{measure}_{number}": _change(number, frame, measure)
        for number, frame in enumerate(frames, start=1)
        for measure in (measures if frame.average else measures[:1])
    }

    # The state before each slice, as one opening mark per frame.
    earlier = (
        Window.partitionBy("_zone")
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        events.groupBy("_zone", "_slice")
        .agg(
            F.max(F.col("_kind") == ARRIVAL).alias("_arrives"),
            *[F.sum(change).alias(name) for name, change in totals.items()],
        )
        .select(
            "_zone",
            "_slice",
            "_arrives",
            *[
                F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name)
                for name in totals
            ],
        )
        # Nobody asks a slice in which trips only leave their frames.
        .where("_arrives")
    )
    openings = before.select(
        "_zone",
        "_slice",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(None).cast("timestamp_ntz").alias("_at"),
                        F.lit(OPENING + number).alias("_kind"),
                        *[
                            F.col(name).alias(measure)
                            if (name := f"{measure}_{number}") in totals
                            else F.lit(0).cast("bigint").alias(measure)
                            for measure in measures
                        ],
                    )
                    for number in range(1, len(frames) + 1)
                ]
            )
        ),
    )

    # Openings have no time, so they sort first. In the slice of rows without a
    # time, everything before it is zero and their place does not matter.
    running = (
        Window.partitionBy("_zone", "_slice")
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    arrivals = (
        events.unionByName(openings)
        .select(
            "_zone",
            "_at",
            "_kind",
            "_rows",
            *[F.sum(change).over(running).alias(name) for name, change in totals.items()],
        )
        .where(F.col("_kind") == ARRIVAL)
    )

    results = []
    for number, frame in enumerate(frames, start=1):
        count = F.col(f"_rows_{number}")
        if frame.ahead is not None:
            count = count + F.col("_rows")
        results.append(count.alias(frame.count))
        if frame.average:
            held = F.col(f"_values_{number}")
            results.append(
                F.when(held > 0, F.col(f"_total_{number}") / held).alias(frame.average)
            )
    statistics = arrivals.select("_zone", "_at", *results)

    return rows.join(
        statistics,
        rows[partition].eqNullSafe(statistics["_zone"])
        & rows[order].eqNullSafe(statistics["_at"]),
    ).drop("_zone", "_at")
