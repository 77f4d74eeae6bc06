"""Near copies by SimHash, with BK-trees over shards of fingerprints.

Equal fingerprints collapse first, so copies cost one row. Two fingerprints that
differ in at most ``RADIUS`` of 64 bits agree in at least two of ``BLOCKS`` = RADIUS +
2 blocks of bits; each pair of blocks and the value they hold name a shard, and
every linked pair meets in one. In a shard a BK-tree is built: children hang at their
Hamming distance to the parent, and a search follows only the edges within the
radius. Trees of many shards are built and searched level by level at once.

A shard of more than ``SHARD_ROWS`` fingerprints is cut into chunks; each task has the
tree of one chunk and searches it for the fingerprints of one chunk, all pairs of
chunks in turn: exact, and no task grows. A shard yields a forest of its links, not
all pairs, which keeps what is connected connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import components
from .scratch import fresh, small_batches, stage
from .word_tokens import pieces
from .worker import release

WORDS = 4
SEED = 42
RADIUS = 4
BLOCKS = RADIUS + 2
SHARD_ROWS = 4096
#: Pairs (query, node) looked at in one step; bounds a task's memory.
FRONTIER = 1 << 21
#: Fingerprints of small shards searched together.
GATHER = 1 << 16


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text as a signed 64-bit integer; 0 without words."""
    import xxhash

    ones, total = np.zeros(64, np.int64), 0
    held: list[bytes] = []

    def count(shingles: list[int]) -> int:
        bits = np.array(shingles, "<u8").view(np.uint8).reshape(-1, 8)
        for at in range(0, len(bits), 255):
            part = np.unpackbits(bits[at : at + 255], axis=1, bitorder="little")
            ones[:] += np.add.reduce(part, axis=0, dtype=np.uint8)
        return len(shingles)

    digest = xxhash.xxh64_intdigest
    for part in pieces((text or "").encode().lower()):
        words = held + part.split()
        if len(words) >= WORDS:
            n = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(n)
            joined = b" ".join(words)
            begin, end = (ends - n)[: 1 - WORDS].tolist(), (ends[WORDS - 1 :] - 1).tolist()
            total += count([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)])
            words = words[1 - WORDS :]
        held = words
    if not total and held:
        total = count([digest(b" ".join(held), SEED)])
    set_bits = np.packbits(2 * ones > total, bitorder="little")
    return int(set_bits.view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    release()
    return texts.map(fingerprint, na_action=None).astype("int64")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKForest:
    """BK-trees of several shards; all fingerprints of a shard differ."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        """``shard`` rises from 0; its first fingerprint is the root of its tree."""
        self.prints = prints
        _, self.roots = np.unique(shard, return_index=True)
        here = self.roots[shard]
        left = np.flatnonzero(here != np.arange(len(prints)))
        here, keys, nodes = here[left], [], []
        while len(left):
            key = here * 65 + _distance(prints[left], prints[here])
            distinct, first, at = np.unique(key, return_index=True, return_inverse=True)
            keys.append(distinct)
            nodes.append(left[first])
            here = left[first][at]
            more = here != left
            left, here = left[more], here[more]
        none = np.empty(0, np.int64)
        keys, nodes = np.concatenate([none, *keys]), np.concatenate([none, *nodes])
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def within(self, prints: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all hits; only edges within the radius are followed."""
        query, node = np.arange(len(prints)), self.roots[shard]
        found_q, found_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(query):
            far = _distance(prints[query], self.prints[node])
            hit = far <= radius
            found_q.append(query[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), "right")
            n = high - low
            ends = np.cumsum(n)
            child = np.repeat(low - (ends - n), n) + np.arange(int(n.sum()))
            query, node = np.repeat(query, n), self.nodes[child]
        return np.concatenate(found_q), np.concatenate(found_n)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; a label is the least member's place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def forest_links(
    prints: np.ndarray, shard: np.ndarray, chunk: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius in each shard.

    ``chunk``: 0 in the tree and searched; 1 in the tree only; 2 searched only.
    """
    tree, asks = np.flatnonzero(chunk != 2), np.flatnonzero(chunk != 1)
    # Shards in a tree are numbered anew; every shard here has a tree.
    known, tree_shard = np.unique(shard[tree], return_inverse=True)
    asks = asks[np.isin(shard[asks], known)]
    ask_shard = np.searchsorted(known, shard[asks])
    forest = BKForest(prints[tree], tree_shard)
    label = np.arange(len(prints))
    widest = int(np.bincount(tree_shard).max(initial=1))
    step = max(1, FRONTIER // widest)
    for at in range(0, len(asks), step):
        q, n = forest.within(prints[asks[at : at + step]], ask_shard[at : at + step], radius)
        _unite(label, asks[at + q], tree[n])
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return prints[linked], prints[label[linked]]


def shard_keys(print_: Column, blocks: int = BLOCKS, agree: int = BLOCKS - RADIUS) -> Column:
    """The shards of a fingerprint: which blocks, and what they hold."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [
        F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        for a, b in zip(edges, edges[1:], strict=False)
    ]
    wide = -(-64 // blocks)
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(k).cast("long")
        for c in chosen:
            key = F.shiftleft(key, wide).bitwiseOR(part[c])
        keys.append(key)
    return F.array(*keys)


def near_links(
    spark: SparkSession, distinct_prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within the radius.

    ``distinct_prints``: one column of different fingerprints.
    """
    name = distinct_prints.columns[0]
    rows = distinct_prints.select(
        F.col(name).alias("print"), F.explode(shard_keys(F.col(name), radius + 2, 2)).alias("shard")
    )
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    rows = rows.join(sizes, "shard").select(
        "shard", "print", chunks.alias("chunks"), F.pmod(F.xxhash64("print"), chunks).cast("int").alias("own")
    )
    # A row of a cut shard goes to the tasks of all pairs that its chunk is in.
    paired = rows.select(
        "shard", "print", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    dealt = paired.select(
        "shard",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 0)
        .when(F.col("own") < F.col("other"), 1)
        .otherwise(2)
        .alias("role"),
        "print",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[np.ndarray] = []
        n = 0

        def links(m: np.ndarray) -> pa.RecordBatch:
            new = np.any(m[1:, :3] != m[:-1, :3], axis=1)
            shard = np.concatenate([[0], np.cumsum(new)])
            prints = np.ascontiguousarray(m[:, 4]).view(np.uint64)
            a, b = forest_links(prints, shard, m[:, 3], radius)
            both = [pa.array(x.view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(both, ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch], axis=1))
            n += batch.num_rows
            if n >= GATHER:
                m = np.concatenate(held)
                whole = np.flatnonzero(np.any(m[1:, :3] != m[:-1, :3], axis=1))
                if len(whole):  # the last shard may go on in the next batch
                    cut = int(whole[-1]) + 1
                    yield links(m[:cut])
                    m = m[cut:]
                held, n = [m], len(m)
        if n:
            yield links(np.concatenate(held))

    return (
        dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "i", "j")
        .sortWithinPartitions("shard", "i", "j", "role")
        .mapInArrow(search, "a long, b long")
    )


def near_classes(spark: SparkSession, prints: DataFrame, id_column: str) -> DataFrame:
    """(print, class): the least ``id_column`` of all rows reachable from a fingerprint.

    ``prints``: written rows with ``print`` and the id. Nulls never are the least; a
    class of null ids alone has a null class.
    """
    distinct = stage(spark, prints.groupBy("print").agg(F.min(id_column).alias("least")), "prints")
    roots = components(spark, near_links(spark, distinct.select("print")))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", F.coalesce("root", "print").alias("root"), "least"
    )
    classes = rooted.groupBy("root").agg(F.min("least").alias("class"))
    return rooted.join(classes, "root").select("print", "class")


def op6(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    Null and empty texts have fingerprint zero, linked like any other. Repeated rows
    are rows of their own in the same component; an empty table gives no rows.
    """
    small_batches(spark)
    prints = stage(
        spark, documents.select("doc_id", fingerprints("text").alias("print")), "documents"
    )
    classes = near_classes(spark, prints, "doc_id").withColumnRenamed("print", "of")
    return prints.join(classes, prints["print"] == classes["of"]).select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("class").alias("component_id"),
    )


def keep_one(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: the least doc_id, nulls last.

    Of repeated rows one stays. All columns are kept.
    """
    small_batches(spark)
    print_, row = fresh(documents, "print"), fresh(documents, "row")
    held = stage(
        spark,
        documents.withColumns({print_: fingerprints("text"), row: F.monotonically_increasing_id()}),
        "documents",
    )
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    prints = held.select(F.col(print_).alias("print"), rank.alias("rank"))
    best = near_classes(spark, prints, "rank").select(F.col("class.row").alias(row)).distinct()
    return held.join(best, row, "left_semi").select(*[f"`{c}`" for c in documents.columns])
