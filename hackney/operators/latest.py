"""One row per key: deduplication and keyed merge.

Both keep ``row_number() = 1``. Spark cuts each map task down to one row per
key before it shuffles (a partial window group limit), so a key that holds a
third of all rows never meets in one task before it is reduced.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(
    rows: DataFrame, keys: Sequence[str], *order: Column, where: Column | None = None
) -> DataFrame:
    """The first row of every key by ``order``, all columns kept.

    ``where`` restricts the choice. It is part of the order instead of a filter
    below the window, where Catalyst would repeat the expressions it rests on.
    """
    columns = rows.columns
    first = F.col("_place") == 1
    if where is not None:
        rows = rows.withColumn("_eligible", F.coalesce(where, F.lit(False)))
        order = (F.col("_eligible").desc(), *order)
        first = first & F.col("_eligible")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(first).select(*columns)


def latest_by_key(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    where: Column | None = None,
) -> DataFrame:
    """The row of every key that is greatest by ``order``."""
    return first_by_key(rows, keys, *[F.col(c).desc() for c in order], where=where)


def merge_by_key(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    keep: str = "incoming",
) -> DataFrame:
    """``stored`` upserted with ``incoming``; nothing is ever deleted.

    On a shared key ``keep="incoming"`` replaces the stored row and
    ``keep="stored"`` leaves it. Each side holds a key at most once; NULL is a key.
    """
    if keep not in ("incoming", "stored"):
        raise ValueError(f"keep must be 'incoming' or 'stored', not {keep!r}")
    incoming = incoming.select(*stored.columns)
    if keep == "stored":
        return stored.unionByName(matched(incoming, stored, keys, "left_anti"))
    return matched(stored, incoming, keys, "left_anti").unionByName(incoming)


def matched(rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``rows`` joined (``left_semi`` or ``left_anti``) with ``others`` by equal keys, NULL equal too."""
    names = others.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [rows[k].eqNullSafe(names[f"_{k}"]) for k in keys]
    return rows.join(names, same, how)


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )
