"""A Merkle manifest of a table: leaves by source, trees of copied hash states, proofs.

Every row is a leaf, the SHA-256 of its length-prefixed fields. Per source, leaves in
order of their id are the bottom of a tree of ``ARITY`` children a node; the sources'
roots, in order of source, are the bottom of one more such tree.

A source may hold any share of the rows, so no tree is built in one task. Leaves get their
place in their source by counting the pieces of a range sort, and nodes are hashed in
blocks of ``ARITY ** BLOCK_LEVELS`` neighbours: a task turns a block into the one node
above it, and those nodes are the next tier. Tiers shrink by the block's size, so a
few written tables reach the roots. On the way down each tier hands its nodes the part
of the proof that lies above them.

In the pass over the leaves a parent keeps a copy of its hash state before each child's
slot. A replaced child is folded upwards by resuming the state of its slot with the
replacement and the siblings to its right; what is left of it is never hashed again.
States above a block are made once for all leaves of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hackney.operators.numbering import rows_before

from .scratch import stage
from .worker import release

ARITY = 3
#: Levels that a task hashes at once, over at most 3**7 = 2,187 neighbours.
BLOCK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: In a proof, the node's own place among its siblings, and the end of a level.
OWN, UP = "*", "/"
_NODE = "tree string, pos long, n long, h string"
_PATH = "tree string, pos long, path string"
_MANIFEST = "doc_id long, source string, leaf string, subroot string, root string, proof string, folded_root string"


def leaf_hash(**changed: Column) -> Column:
    """SHA-256 of a row's fields, each ``-`` if null, else byte count, ``:`` and value.

    ``changed`` has other columns to take for some fields.
    """

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(field(name) for name in FIELDS)), 256)


# --- inside a block -----------------------------------------------------------------


def levels_of(n: int) -> int:
    """Levels a tier of ``n`` nodes goes up in one pass."""
    levels = 0
    while levels < BLOCK_LEVELS and n > ARITY**levels:
        levels += 1
    return levels


def parents(nodes: list[bytes]) -> list[bytes]:
    """Every ``ARITY`` consecutive nodes, the last run fewer, as their hash."""
    runs = (nodes[k : k + ARITY] for k in range(0, len(nodes), ARITY))
    return [hashlib.sha256(b"".join(run)).hexdigest().encode() for run in runs]


def block_levels(nodes: list[bytes], n: int) -> list[list[bytes]]:
    """The nodes of a block, level by level; the last level is the one node above it."""
    out = [nodes]
    for _ in range(levels_of(n)):
        out.append(parents(out[-1]))
    return out


def block_proofs(levels: list[list[bytes]]) -> list[bytes]:
    """Each bottom node's siblings inside the block: levels end in ``UP``, ``OWN`` its place."""
    steps = []
    for nodes in levels[:-1]:
        runs = (nodes[k : k + ARITY] for k in range(0, len(nodes), ARITY))
        own, up = OWN.encode(), UP.encode()
        steps.append([b"".join(run[:j]) + own + b"".join(run[j + 1 :]) + up for run in runs for j in range(len(run))])
    out = []
    for i in range(len(levels[0])):
        parts = []
        for step in steps:
            parts.append(step[i])
            i //= ARITY
        out.append(b"".join(parts))
    return out


def slot_states(nodes: list[bytes]) -> list[tuple]:
    """For each node, its parent's state before its slot, and the siblings right of it."""
    out = []
    for k in range(0, len(nodes), ARITY):
        run, state = nodes[k : k + ARITY], hashlib.sha256()
        for j, node in enumerate(run):
            out.append((state.copy(), b"".join(run[j + 1 :])))
            state.update(node)
    return out


def proof_states(proof: bytes) -> list[tuple]:
    """The same for every level of a proof."""
    sides = [level.split(OWN.encode()) for level in proof.split(UP.encode())[:-1]]
    return [(hashlib.sha256(left), right) for left, right in sides]


def resume(state, node: bytes, right: bytes) -> bytes:
    """The parent's hash with ``node`` in the slot that ``state`` was kept for."""
    state = state.copy()
    state.update(node + right)
    return state.hexdigest().encode()


def fold(node: str, proof: str) -> str:
    """The root that ``node`` leads to by its proof."""
    return reduce(lambda h, s: resume(s[0], h, s[1]), proof_states(proof.encode()), node.encode()).decode()


# --- passes over blocks -------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), its rows) of rows sorted by tree and block, those two first."""
    release()
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return ((key, list(found)) for key, found in groupby(rows, key=lambda row: row[:2]))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        columns = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )


def _schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


_NODES = _schema(tree=pa.string(), pos=pa.int64(), n=pa.int64(), h=pa.string())
_PATHS = _schema(tree=pa.string(), pos=pa.int64(), path=pa.string())
_ROWS = _schema(
    doc_id=pa.int64(),
    source=pa.string(),
    leaf=pa.string(),
    subroot=pa.string(),
    root=pa.string(),
    proof=pa.string(),
    folded_root=pa.string(),
)


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (tree, block), found in _blocks(batches):
            n = found[0][3]
            top = block_levels([row[4].encode() for row in found], n)[-1][0]
            yield tree, block, -(-n // ARITY ** levels_of(n)), top.decode()

    return _batches(rows(), _NODES)


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the proof of the node above them as their first row."""

    def rows():
        for (tree, _), (first, *found) in _blocks(batches):
            proofs = block_proofs(block_levels([row[4].encode() for row in found], found[0][3]))
            for row, proof in zip(found, proofs, strict=True):
                yield tree, row[2], proof.decode() + first[5]

    return _batches(rows(), _PATHS)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like ``_down`` for leaves: proofs, and the roots their claimed hashes lead to."""

    def rows():
        for _, (first, *found) in _blocks(batches):
            subroot, root, above = first[6], first[7], proof_states(first[5].encode())
            levels = block_levels([row[4].encode() for row in found], found[0][3])
            states = [slot_states(nodes) for nodes in levels[:-1]]
            for i, (row, proof) in enumerate(zip(found, block_proofs(levels), strict=True)):
                leaf, source, doc_id, claimed = row[4], row[8], row[9], row[10]
                h = claimed.encode()
                for level in states:
                    h, i = resume(level[i][0], h, level[i][1]), i // ARITY
                for state, right in above:
                    h = resume(state, h, right)
                yield doc_id, source, leaf, subroot, root, proof.decode() + first[5], h.decode()

    return _batches(rows(), _ROWS)


def _block() -> Column:
    return F.expr(f"pos div {ARITY**BLOCK_LEVELS}").alias("block")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def placed(spark: SparkSession, rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place in their ``tree`` by ``order``, and the tree's size.

    A range sort cuts rows into ordered pieces whatever tree they belong to. Rows of a piece
    are numbered as they lie, and pieces are counted; rows alike in all of ``order``
    may take each other's places.
    """
    mark = rows.withColumn("mark", F.monotonically_increasing_id())  # lets rows alike be cut
    mark = mark.repartitionByRange("tree", *order, "mark").sortWithinPartitions("tree", *order, "mark")
    rows = stage(spark, mark.withColumn("mark", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("piece", F.shiftright("mark", 33))
    pieces = rows.groupBy("tree", "piece").agg(F.count("*").alias("rows"), F.min("mark").alias("first"))
    sizes = pieces.groupBy("tree").agg(F.sum("rows").alias("n"))
    pieces = rows_before(pieces, "piece", "rows", group="tree").join(sizes, "tree").drop("rows")
    pos = (F.col("mark") - F.col("first") + F.col("rows_before")).alias("pos")
    keep = [c for c in rows.columns if c not in ("mark", "piece", "tree")]
    pieces = stage(spark, pieces, "pieces")
    return rows.join(pieces, ["tree", "piece"]).select("tree", pos, "n", *keep)


def tiers(spark: SparkSession, bottom: DataFrame) -> list[DataFrame]:
    """Nodes (tree, pos, n, h) of ``bottom`` and of each tier above, up to the roots."""
    out = [bottom]
    while True:
        nodes = out[-1].select("tree", _block(), "pos", "n", "h")
        out.append(stage(spark, _by_block(nodes).mapInArrow(_above, _NODE), "tier"))
        if (out[-1].agg(F.max("n").alias("n")).first().n or 1) == 1:
            return out


def _with_proofs(nodes: DataFrame, above: DataFrame, ends: tuple = (), more: tuple = ()) -> DataFrame:
    """Blocks of nodes, each led by a row with the proof of the node above the block.

    ``ends`` are further columns of ``above``, ``more`` those of ``nodes``.
    """
    lead = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", *ends)
    own = nodes.select("tree", _block(), "pos", "n", "h", *more)
    both = lead.unionByName(own, allowMissingColumns=True)
    return _by_block(both.select("tree", "block", "pos", "n", "h", "path", *ends, *more))


def proofs(spark: SparkSession, levels: list[DataFrame], down_to: int) -> DataFrame:
    """(tree, pos, path) of the nodes of tier ``down_to``."""
    paths = levels[-1].select("tree", "pos", F.lit("").alias("path"))
    for nodes in reversed(levels[down_to:-1]):
        paths = stage(spark, _with_proofs(nodes, paths).mapInArrow(_down, _PATH), "paths")
    return paths


def manifest(spark: SparkSession, leaves: DataFrame) -> DataFrame:
    """One row for each of ``leaves`` (doc_id, source, leaf, claimed): its proof and fold.

    ``leaf`` is the row's hash in the manifest and ``claimed`` the hash of the copy that is
    checked. Returns doc_id, source, leaf, subroot (of the source), root, proof, and
    folded_root: what ``claimed`` leads to with the siblings of ``leaf``. A proof has the
    siblings of each level, left to right, ``*`` at the node's own place and ``/`` at the
    end of the level; ``fold`` checks one.

    Leaves of a source go by doc_id, null ids first, repeated ids by leaf. The null source
    is a source of its own and comes first. No leaves give no rows.
    """
    # Trees are named so that nulls are told apart and bytes decide the order.
    tree = F.coalesce(F.concat(F.lit(":"), "source"), F.lit("-")).alias("tree")
    rows = leaves.select(tree, F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("h"), "claimed")
    # Written before they are sorted, so that a sort's sampling does not hash texts again.
    rows = stage(spark, rows, "hashes")
    rows = stage(spark, placed(spark, rows, "doc_id", "h"), "leaves")
    levels = tiers(spark, rows)
    subroots = levels[-1].select("tree", F.col("h").alias("subroot"))

    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("h"))
    top = stage(spark, placed(spark, top, "name"), "sources")
    top_levels = tiers(spark, top)
    root = top_levels[-1].select(F.col("tree").alias("all"), F.col("h").alias("root"))
    ends = (
        proofs(spark, top_levels, 0)
        .join(top.select("tree", "pos", "name", F.col("h").alias("subroot")), ["tree", "pos"])
        .join(root, F.col("tree") == F.col("all"))
        .select(F.col("name").alias("tree"), "subroot", "root", F.col("path").alias("end"))
    )
    lead = proofs(spark, levels, 1).join(ends, "tree")
    lead = lead.select("tree", "pos", F.concat("path", "end").alias("path"), "subroot", "root")
    named = rows.withColumn("source", F.expr("if(tree = '-', null, substr(tree, 2))"))
    blocks = _with_proofs(named, lead, ("subroot", "root"), ("source", "doc_id", "claimed"))
    return blocks.mapInArrow(_judge, _MANIFEST)


def op13(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Rows whose crc32 of the decimal doc_id is even are tampered with: line ends are cut from
    their text. A null id or text is never tampered with; a text without line ends stays as
    it is, and is verified. Nulls are a field of their own, so a null and an empty text
    differ. Repeated rows are leaves of their own. An empty table gives no rows. Other
    columns are not read.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    leaf = leaf_hash()
    # A second hash only where the text has a line end to lose.
    claimed = F.when(even & F.contains("text", F.lit("\n")), leaf_hash(text=cut)).otherwise(leaf)
    rows = manifest(spark, documents.select("doc_id", "source", leaf.alias("leaf"), claimed.alias("claimed")))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.translate("proof", OWN + UP, ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
