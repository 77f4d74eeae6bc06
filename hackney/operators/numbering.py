"""Dense row numbers and batch numbers without a global sort.

Rows lie in ordered *pieces* (the splits of a file, or ranges of a key), and
each row has a position inside its piece. Counting the pieces is a small
aggregate; its running sum gives every piece the number of rows before it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_before(
    sizes: DataFrame, order: str, size: str, group: str | None = None
) -> DataFrame:
    """``sizes`` plus ``rows_before``: the running total over earlier pieces.

    ``sizes`` has one row per piece (a file split or a key range), far fewer
    than the rows counted in it.
    """
    within = Window.partitionBy(*([group] if group else [F.lit(0)]))
    earlier = within.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(
        "rows_before", F.coalesce(F.sum(size).over(earlier), F.lit(0))
    )


def batch_of(row_index: Column, chunk_size: int, after: Column | int = 0) -> Column:
    """Batch number of a zero-based row index, continuing ``after``."""
    start = after if isinstance(after, Column) else F.lit(after)
    # An exact integer quotient: the remainder is taken off before dividing.
    whole = row_index - row_index % chunk_size
    return (start + 1 + whole / F.lit(chunk_size)).cast("int")


def number_by_key(
    rows: DataFrame,
    key: str,
    piece_width: int = 1_000_000,
    group_width: int = 1_000_000,
) -> DataFrame:
    """``rows`` plus a dense zero-based ``row_index`` in order of a unique integer key.

    A piece is a range of ``piece_width`` key values and a group a range of
    ``group_width`` pieces, so neither holds more than that many rows whatever
    the data looks like; 64-bit keys make some nine million groups at most.
    """
    pieces = rows.withColumn("_piece", F.floor(F.col(key) / F.lit(float(piece_width))))
    sizes = (
        pieces.groupBy("_piece")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_group", F.floor(F.col("_piece") / F.lit(float(group_width))))
    )
    groups = rows_before(
        sizes.groupBy("_group").agg(F.sum("_size").alias("_size")), "_group", "_size"
    ).select("_group", F.col("rows_before").alias("_group_start"))
    offsets = (
        rows_before(sizes, "_piece", "_size", group="_group")
        .join(groups, "_group")
        .select("_piece", (F.col("rows_before") + F.col("_group_start")).alias("_start"))
    )
    position = F.row_number().over(Window.partitionBy("_piece").orderBy(key)) - 1
    return (
        pieces.withColumn("_position", position)
        .join(offsets, "_piece")
        .withColumn("row_index", F.col("_start") + F.col("_position"))
        .drop("_piece", "_position", "_start")
    )


def assign_batches(
    rows: DataFrame,
    key: str,
    chunk_size: int,
    after: int = 0,
    piece_width: int = 1_000_000,
) -> DataFrame:
    """``rows`` plus ``batch_no``: chunks of ``chunk_size`` rows in key order."""
    check_chunk_size(chunk_size)
    return (
        number_by_key(rows, key, piece_width)
        .withColumn("batch_no", batch_of(F.col("row_index"), chunk_size, after))
        .drop("row_index")
    )


def check_chunk_size(chunk_size: int) -> None:
    if chunk_size < 1:
        raise ValueError(f"chunk_size must be at least 1, not {chunk_size}")
