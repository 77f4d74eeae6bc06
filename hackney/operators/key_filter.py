"""Which files may hold some of a set of keys: Bloom filters kept as Spark bitmaps.

The filter of a file is cut into blocks of one bitmap each. A key sets ``PROBES`` bits in
one block of its file, so a look-up reads that block alone, and filters are built
and searched by joins and aggregates without Python. About one key in two thousand
that a file does not hold looks as if it did; a key that it holds is never missed.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed by bitmap_construct_agg: the bits of one bitmap.
BLOCK_BITS = 32_768
# Bits of a filter for each key, and bits that a key sets.
KEY_BITS = 24
PROBES = 4


def blocks_for(rows: int) -> int:
    """Blocks of the filter of a file with so many rows."""
    return max(1, -(-rows * KEY_BITS // BLOCK_BITS))


def _block(keys: Sequence[str], blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), *keys), F.col(blocks)).cast("int")


def _places(keys: Sequence[str]) -> Column:
    """Bits of a key in its block: fifteen bits of a hash for each."""
    key = F.xxhash64(F.lit(3), *keys)
    return F.array(
        *[F.shiftrightunsigned(key, 15 * n).bitwiseAND(F.lit(BLOCK_BITS - 1)) for n in range(PROBES)]
    )


def build_filters(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(file, block, bits) of ``rows``: a file, the blocks it is to have, the keys.

    Tasks reduce their rows to bitmaps before the shuffle. NULL is a key like others.
    """
    places = rows.select("file", _block(keys, "blocks").alias("block"), F.explode(_places(keys)).alias("place"))
    return places.groupBy("file", "block").agg(F.bitmap_construct_agg("place").alias("bits"))


def may_hold(
    wanted: DataFrame, files: DataFrame, filters: DataFrame, keys: Sequence[str], within: str
) -> DataFrame:
    """(file) of the ``files`` (file, blocks, ``within``) that may hold one of the wanted keys.

    A key is looked up in files with its own value of ``within`` only.
    """
    looked_up = wanted.join(files, within).select(
        "file", _block(keys, "blocks").alias("block"), _places(keys).alias("places")
    )

    def is_set(place: Column) -> Column:
        byte = F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1

    return (
        looked_up.join(filters, ["file", "block"])
        .where(F.forall("places", is_set))
        .select("file")
        .distinct()
    )
