"""Nearest neighbours by cosine, in directed graphs with robustly pruned edges.

Different vectors are dealt into shards by a hash, and each shard becomes a graph of its
own. Nodes are inserted in batches. A greedy search from the shard's entry proposes a
node's neighbours; relaxed distance pruning goes through them, nearest first, and
drops those that a neighbour already kept is nearer to, ``RELAX`` times over, so
the edges left point into different directions. Edges are added backwards too, and
lists that grow beyond ``SLACK`` are pruned again.

A query runs a beam search in every shard: of the ``BEAM`` best nodes met so far, the best
not looked at yet are opened, ``WIDTH`` at a time, until none is left. Searches of a
batch go in step, as arrays. Graphs guide the search with unit vectors in single
precision; what it finds is scored on the original vectors in double precision.

Equal vectors are one node, which keeps their smallest ids: as many as an answer has, and one
for the query itself. Queries with equal vectors search once. Shards have
``SHARD_ROWS`` nodes on average at every size of the input; blocks of queries meet groups
of shards, so one task holds a block of queries and a group of shards, no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stage
from .worker import groups, release

NEAREST = 5
EVERY = 50
#: Nodes of a shard, on average.
SHARD_ROWS = 4096
#: Edges of a node after pruning, and the length of a list that makes it be pruned again.
EDGES, SLACK = 32, 48
RELAX = 1.2
#: Best nodes held by a search while a graph grows, and by a query.
BUILD_BEAM, BEAM = 40, 64
#: Nodes opened at a time, and searches in step.
WIDTH, TOGETHER = 4, 512
#: Queries of a block, and shards that a block meets in one task.
QUERY_BLOCK, SHARD_GROUP = 16384, 4


def units(vectors: np.ndarray) -> np.ndarray:
    """Single-precision vectors of length one, for the graphs."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, in double precision."""
    with np.errstate(all="ignore"):
        a, b = (query**2).sum(axis=1), (vectors**2).sum(axis=1)
        score = (query * vectors).sum(axis=1) / np.sqrt(a) / np.sqrt(b)
    low, high = 1e-280, 1e280  # squares near the ends of the range of doubles
    odd = (np.minimum(a, b) < low) | (np.maximum(a, b) > high)
    if odd.any():
        q, v = (x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True) for x in (query, vectors))
        score[odd] = (q * v).sum(axis=1) / np.sqrt((q**2).sum(axis=1)) / np.sqrt((v**2).sum(axis=1))
    return np.clip(score, -1.0, 1.0)


class Graph:
    """Unit vectors and their out-edges; ``n`` fills unused places of a list."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None):
        self.n = len(points)
        self.points = np.concatenate([points, np.zeros((1, points.shape[1]), np.float32)])
        self.edges = np.full((self.n + 1, SLACK), self.n, np.int32)
        if edges is not None:
            self.edges[: self.n, : edges.shape[1]] = edges

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes met by each query, best first, with their cosines."""
        ids, sims = [], []
        for k in range(0, len(queries), TOGETHER):
            found = self._in_step(queries[k : k + TOGETHER], beam)
            ids.append(found[0])
            sims.append(found[1])
        return np.concatenate(ids), np.concatenate(sims)

    def _in_step(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(queries)
        ids = np.full((m, beam), self.n, np.int32)
        sims = np.full((m, beam), -np.inf, np.float32)
        opened = np.ones((m, beam), bool)
        # when a search met a node first; nodes met twice in a step are told apart by it
        met = np.full((m, self.n + 1), -1, np.int32)
        met[:, self.n] = 0
        ids[:, 0], sims[:, 0], opened[:, 0], met[:, 0] = 0, queries @ self.points[0], False, 0
        time = 1
        while True:
            unseen = ~opened
            rows, cols = np.nonzero(unseen & (np.cumsum(unseen, axis=1, dtype=np.int32) <= WIDTH))
            if not len(rows):
                return ids, sims
            opened[rows, cols] = True
            near = self.edges[ids[rows, cols]]
            row, at = np.nonzero(met[rows[:, None], near] < 0)
            node, row = near[row, at], rows[row]
            stamp = np.arange(time, time + len(node), dtype=np.int32)
            met[row, node] = stamp
            once = met[row, node] == stamp
            time += len(node)
            row, node = row[once], node[once]
            sim = np.einsum("ij,ij->i", queries[row], self.points[node])
            good = sim > sims[row, -1]
            row, node, sim = row[good], node[good], sim[good]
            if not len(row):
                continue
            # into a matrix with a row for each search that got something, then the best again
            active, first, count = np.unique(row, return_index=True, return_counts=True)
            place = np.arange(len(row)) - np.repeat(first, count)
            line = np.repeat(np.arange(len(active)), count)
            wide = (len(active), beam + int(count.max()))
            all_ids, all_sims = np.full(wide, self.n, np.int32), np.full(wide, -np.inf, np.float32)
            all_open = np.ones(wide, bool)
            all_ids[:, :beam], all_sims[:, :beam], all_open[:, :beam] = ids[active], sims[active], opened[active]
            all_ids[line, beam + place], all_sims[line, beam + place] = node, sim
            all_open[line, beam + place] = False
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            opened[active] = np.take_along_axis(all_open, best, 1)

    def prune(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Diverse neighbours of each row's proposals, which come nearest first."""
        points = self.points[ids]
        # squared distances of unit vectors
        between = 2 - 2 * (points @ points.transpose(0, 2, 1))
        away = 2 - 2 * sims
        left = ids < self.n
        out = np.full((len(ids), EDGES), self.n, np.int32)
        every = np.arange(len(ids))
        for k in range(EDGES):
            pick = left.argmax(axis=1)
            some = left[every, pick]
            if not some.any():
                break
            out[some, k] = ids[some, pick[some]]
            left &= between[every, pick] * RELAX**2 > away
            left[every, pick] = False
        return out

    def insert(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Edges of new ``nodes`` out of proposals, and edges back."""
        kept = self.prune(ids, sims)
        self.edges[nodes, :EDGES] = kept
        line, at = np.nonzero(kept < self.n)
        self._back(kept[line, at], nodes[line])

    def _back(self, to: np.ndarray, new: np.ndarray) -> None:
        sim = np.einsum("ij,ij->i", self.points[to], self.points[new])
        order = np.lexsort((-sim, to))
        to, new = to[order], new[order]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        degree = (self.edges[target] < self.n).sum(axis=1)
        fits = degree + count <= SLACK
        line = np.repeat(np.arange(len(target)), count)
        easy = fits[line]
        self.edges[to[easy], degree[line[easy]] + place[easy]] = new[easy]
        full = np.flatnonzero(~fits)
        for k in range(0, len(full), TOGETHER):
            some = full[k : k + TOGETHER]
            # of new edges to a hub the nearest ``2 * EDGES`` compete: pruning keeps ``EDGES``
            index = np.full(len(target), -1)
            index[some] = np.arange(len(some))
            mine = (index[line] >= 0) & (place < 2 * EDGES)
            more = np.full((len(some), 2 * EDGES), self.n, np.int32)
            more[index[line[mine]], place[mine]] = new[mine]
            ids = np.concatenate([self.edges[target[some]], more], axis=1)
            ids = ids[:, : SLACK + int(place[mine].max()) + 1]
            sims = np.einsum("ijk,ik->ij", self.points[ids], self.points[target[some]])
            sims[ids == self.n] = -np.inf
            best = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            pruned = np.full((len(some), SLACK), self.n, np.int32)
            pruned[:, :EDGES] = self.prune(ids, np.maximum(sims, -1))
            self.edges[target[some]] = pruned


def build(points: np.ndarray) -> Graph:
    """A graph of unit vectors, in the order given, which should be a random one."""
    graph = Graph(points)
    done = min(len(points), EDGES)
    if done < 2:
        return graph
    # the first few propose each other
    ids = np.tile(np.arange(done, dtype=np.int32), (done, 1))
    sims = points[:done] @ points[:done].T
    np.fill_diagonal(sims, -np.inf)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :-1]
    graph.insert(np.arange(done), np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1))
    while done < len(points):
        nodes = np.arange(done, min(len(points), 2 * done, done + TOGETHER))
        ids, sims = graph.search(points[nodes], BUILD_BEAM)
        graph.insert(nodes, ids, np.maximum(sims, -1))
        done = nodes[-1] + 1
    return graph


# --- in Spark -----------------------------------------------------------------------


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """(vec_id, vector, dim, k1, k2) of rows that take part; the keys name equal vectors."""
    v = F.col(name)
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fit & F.exists(v, lambda x: x != 0))
    # a negative zero equals a zero
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0)).alias("vector"))
    return rows.select(
        "vec_id",
        "vector",
        F.size("vector").alias("dim"),
        F.xxhash64("vector").alias("k1"),
        F.xxhash64(F.lit(NEAREST), "vector").alias("k2"),
    )


def _matrix(column) -> np.ndarray:
    """Vectors of equal length, as rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_INDEX = "dim int, shard long, node int, ids array<long>, vector array<{0}>, edges array<int>"
_FOUND = "k1 long, k2 long, ids array<long>, score double"
_FOUND_SCHEMA = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())]
)


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A graph for each shard, of rows (shard, k1, k2, vec_id, dim, vector) sorted by the first four."""
    release()
    for rows in groups(batches, "shard"):
        k1, k2, ids = (rows[c].to_numpy() for c in ("k1", "k2", "vec_id"))
        first = np.ones(len(ids), bool)
        first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        first = np.flatnonzero(first)
        vectors = rows["vector"].take(pa.array(first)).combine_chunks()
        n = len(first)
        edges = build(units(_matrix(vectors))).edges[:n]
        own = edges < n
        ends = np.concatenate([[0], np.cumsum(own.sum(axis=1))]).astype(np.int32)
        columns = {
            "dim": rows["dim"].take(pa.array(first)).combine_chunks(),
            "shard": pa.array(np.full(n, rows["shard"][0].as_py()), pa.int64()),
            "node": pa.array(np.arange(n, dtype=np.int32)),
            "ids": pa.ListArray.from_arrays(np.append(first, len(ids)).astype(np.int32), ids),
            "vector": vectors,
            "edges": pa.ListArray.from_arrays(ends, edges[own]),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def index(spark: SparkSession, rows: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """The graphs over all ``usable`` rows, written: a row for each different vector.

    dim, shard, node (its number in the shard), ids (its smallest ids, one more than an answer
    has), vector, and edges (nodes of its shard). Ids beyond those can never be
    among the ``nearest`` of a query, as equal vectors tie and go by id.
    """
    rank = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    again = F.row_number().over(Window.partitionBy("k1", "k2", "vec_id").orderBy("dim"))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= nearest + 1)
    few = few.withColumn("again", again).filter("again = 1")
    # different vectors are counted by their keys alone; there are few dimensions
    sizes = rows.select("dim", "k1", "k2").distinct().groupBy("dim").count().orderBy("dim").collect()
    shards = [-(-r["count"] // SHARD_ROWS) for r in sizes]
    kind = rows.schema["vector"].dataType.elementType.simpleString()
    schema = _INDEX.format(kind)
    if not sizes:
        return spark.createDataFrame([], schema)
    before = np.concatenate([[0], np.cumsum(shards)]).tolist()
    of, first = (
        F.create_map(*(F.lit(x) for r, y in zip(sizes, column, strict=False) for x in (r.dim, int(y))))
        for column in (shards, before)
    )
    shard = first[F.col("dim")] + F.pmod(F.xxhash64("k2", "k1"), of[F.col("dim")])
    tasks = min(before[-1], 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = few.select(shard.cast("long").alias("shard"), "k1", "k2", "vec_id", "dim", "vector")
    few = few.repartitionById(tasks, (F.col("shard") % tasks).cast("int"))
    few = few.sortWithinPartitions("shard", "k1", "k2", "vec_id")
    return stage(spark, few.mapInArrow(_graphs, schema), "graphs")


def _meet(beam: int, nearest: int):
    """A block of queries and a group of shards, for ``applyInArrow`` of cogroups."""

    def search(queries: pa.Table, nodes: pa.Table) -> pa.Table:
        release()
        if not queries.num_rows or not nodes.num_rows:
            return _FOUND_SCHEMA.empty_table()
        asked = _matrix(queries["vector"])
        ids, least, best, scores = [], [], [], []
        for shard in np.unique(nodes["shard"].to_numpy()):
            part = nodes.filter(pc.equal(nodes["shard"], int(shard))).sort_by("node").combine_chunks()
            vectors = _matrix(part["vector"])
            graph = Graph(units(vectors), _edge_rows(part["edges"].combine_chunks()))
            found, _ = graph.search(units(asked), beam)
            line, at = np.nonzero(found < graph.n)
            score = np.full(found.shape, -np.inf)
            for k in range(0, len(line), 1 << 16):
                a, b = line[k : k + (1 << 16)], at[k : k + (1 << 16)]
                score[a, b] = cosines(asked[a], vectors[found[a, b]])
            names = part["ids"].combine_chunks()
            first = names.flatten().to_numpy()[names.offsets.to_numpy()[:-1] - names.offsets[0].as_py()]
            lead = np.append(first, np.iinfo(np.int64).max)[found]
            keep = np.lexsort((lead, -score), axis=1)[:, : nearest + 1]
            # numbers of nodes in the whole group
            best.append(np.take_along_axis(np.where(found < graph.n, found + sum(map(len, ids)), -1), keep, 1))
            scores.append(np.take_along_axis(score, keep, 1))
            least.append(np.take_along_axis(lead, keep, 1))
            ids.append(names)
        best, scores, least = (np.concatenate(x, axis=1) for x in (best, scores, least))
        keep = np.lexsort((least, -scores), axis=1)[:, : nearest + 1]
        best, scores = (np.take_along_axis(x, keep, 1) for x in (best, scores))
        line, at = np.nonzero(best >= 0)
        names = pa.chunked_array(ids).combine_chunks() if len(ids) > 1 else ids[0]
        return pa.table(
            [
                queries["k1"].take(pa.array(line)),
                queries["k2"].take(pa.array(line)),
                names.take(pa.array(best[line, at])),
                pa.array(scores[line, at]),
            ],
            schema=_FOUND_SCHEMA,
        )

    return search


def _edge_rows(lists: pa.ListArray) -> np.ndarray:
    """Lists of edges as a matrix, unused places filled."""
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    n, size = len(lists), np.diff(ends)
    out = np.full((n, max(1, int(size.max()))), n, np.int32)
    line = np.repeat(np.arange(n), size)
    out[line, np.arange(int(ends[-1])) - np.repeat(ends[:-1], size)] = lists.flatten().to_numpy()
    return out


def search(
    spark: SparkSession, graphs: DataFrame, asked: DataFrame, nearest: int = NEAREST, beam: int = BEAM
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of each ``usable`` row of ``asked``.

    ``graphs`` is an ``index`` made for at least as many ``nearest``. A query finds no row of its own id.
    Equal scores go by the smaller vec_id.
    """
    queries = stage(spark, asked.groupBy("k1", "k2", "dim").agg(F.first("vector").alias("vector")), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    group = F.expr(f"shard div {SHARD_GROUP}").alias("group")
    reach = graphs.select("dim", group).distinct()  # few rows: one for each group of shards
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.lit(blocks)))
    dealt = dealt.join(reach, "dim").groupBy("dim", "group", "block")
    nodes = graphs.select("*", group, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    nodes = nodes.withColumn("block", F.col("block").cast("long")).groupBy("dim", "group", "block")
    found = stage(spark, dealt.cogroup(nodes).applyInArrow(_meet(beam, nearest), _FOUND), "found")

    lead = Window.partitionBy("k1", "k2").orderBy(F.col("score").desc(), F.col("ids")[0])
    best = found.withColumn("place", F.row_number().over(lead)).filter(F.col("place") <= nearest + 1)
    names = asked.select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    pairs = names.join(best, ["k1", "k2"]).select("query_id", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    pairs = pairs.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return pairs.filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op11(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows of every ``EVERY``-th id.

    Null ids take no part, nor do vectors that are null, empty or zero or hold nulls, NaN or
    infinite numbers. Vectors of different lengths are never compared. Repeated rows count
    once; rows with a query's own id are not among its candidates. Fewer candidates
    give fewer rows, an empty table none. Other columns are not read.
    """
    rows = usable(embeddings)
    asked = rows.filter(F.pmod("vec_id", F.lit(EVERY)) == 0)
    return search(spark, index(spark, rows), asked)
