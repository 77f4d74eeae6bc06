import math

import numpy as np
import odd_rows
import pytest
from pyspark.sql import functions as F

from hackney.llm import pruned_graph

DDL = "vec_id long, embedding array<double>, label int, shard string, k1 string, ids string"


def plain(rows, nearest=5, every=50):
    """All pairs, on (vec_id, vector)."""
    fit = {
        (i, tuple(v))
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    out = []
    for i, v in fit:
        if i % every:
            continue
        found = []
        for j, w in fit:
            if j != i and len(w) == len(v):
                a, b = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                found.append((-float(np.clip(a @ b / np.sqrt((a @ a) * (b @ b)), -1, 1)), j))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(found)[:nearest], 1)]
    return sorted(out)


def same(got, want):
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", "k", "i") for i, v in rows], DDL).repartition(3)


def random_rows(n, dim=16, seed=1):
    return list(enumerate(np.random.default_rng(seed).normal(size=(n, dim)).tolist()))


def test_op11_on_a_small_table_equals_brute_force(spark):
    embeddings = spark.read.parquet(f"{odd_rows.SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    same(pruned_graph.op11(spark, embeddings), plain(rows))


def test_op11_on_odd_rows(spark):
    rows = random_rows(120, 4)
    v = rows[7][1]
    rows += [
        (None, v),
        (200, None),
        (250, []),
        (300, [0.0, 0.0, 0.0, 0.0]),
        (350, [1.0, None, 0.0, 0.0]),
        (400, [math.nan, 1.0, 0.0, 0.0]),
        (450, [math.inf, 1.0, 0.0, 0.0]),
        (500, [1.0, 2.0]),  # alone in its length
        (550, [1.0, 2.0, 3.0]),
        (551, [3.0, 2.0, 1.0]),
        (600, [1e300, -1e300, 1e299, 0.0]),
        (601, [-0.0, 1.0, 0.0, 0.0]),
        (650, [0.0, 1.0, 0.0, 0.0]),
        (50, rows[50][1]),  # repeated rows
        (3, rows[3][1]),
    ]
    same(pruned_graph.op11(spark, table(spark, rows)), plain(rows))


def test_op11_of_empty_tables(spark):
    assert pruned_graph.op11(spark, table(spark, [])).collect() == []
    assert pruned_graph.op11(spark, table(spark, [(0, None), (1, [1.0])])).collect() == []
    assert pruned_graph.op11(spark, table(spark, [(0, [1.0])])).collect() == []


def test_copies_tie_and_go_by_id(spark):
    rows = random_rows(60, 8)
    hot = rows[20][1]
    rows += [(1000 + k, hot) for k in range(200)]  # a third and more of all rows, queries among them
    rows += [(2000 + k, rows[k][1]) for k in range(3)]
    same(pruned_graph.op11(spark, table(spark, rows)), plain(rows))


def test_every_vector_is_indexed_once_with_bounded_edges(spark):
    rows = pruned_graph.usable(table(spark, random_rows(500) + [(900, random_rows(1)[0][1])]))
    graphs = pruned_graph.index(spark, rows)
    found = graphs.collect()
    assert sorted(i for r in found for i in r.ids) == sorted(r.vec_id for r in rows.collect())
    nodes = {(r.shard, r.node) for r in found}
    assert len(nodes) == len(found) == 500
    for r in found:
        assert len(r.edges) <= pruned_graph.SLACK and len(set(r.edges)) == len(r.edges)
        assert all((r.shard, e) in nodes and e != r.node for e in r.edges)


@pytest.mark.parametrize("dim", [8, 64])
def test_recall_in_one_shard(dim):
    points = np.random.default_rng(2).normal(size=(3000, dim))
    units = pruned_graph.units(points)
    graph = pruned_graph.build(units[:2900])
    found, _ = graph.search(units[2900:], pruned_graph.BEAM)
    true = np.argsort(-(units[2900:] @ units[:2900].T), axis=1)[:, :5]
    hits = np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(found.tolist(), true.tolist(), strict=True)])
    assert hits >= 0.95


def test_recall_over_shards(spark):
    # more vectors than a shard holds, so queries meet several graphs
    embeddings = table(spark, random_rows(9000, 24, seed=3))
    got = pruned_graph.op11(spark, embeddings).toPandas()
    points = np.array([v for _, v in random_rows(9000, 24, seed=3)])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 9000, 50):
        score = points @ points[q]
        score[q] = -2
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, score[mine.vec_id], rtol=0, atol=1e-12)
        hits += len(set(mine.vec_id) & set(np.argsort(-score)[:5].tolist()))
    assert hits / 5 / 180 >= 0.95


def test_pruning_keeps_edges_in_different_directions():
    # three points near each other and one on the other side
    points = pruned_graph.units(np.array([[1.0, 0, 0], [0.9, 0.3, 0], [0.89, 0.32, 0], [0.9, -0.4, 0]]))
    graph = pruned_graph.Graph(points)
    sims = points[1:] @ points[0]
    order = np.argsort(-sims)
    kept = graph.prune((order + 1)[None].astype(np.int32), sims[order][None])
    assert [k for k in kept[0] if k < 4] == [1, 3]


def test_search_of_queries_by_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(pruned_graph, "QUERY_BLOCK", 7)
    monkeypatch.setattr(pruned_graph, "SHARD_GROUP", 1)
    rows = random_rows(2000, 6, seed=4)
    same(pruned_graph.op11(spark, table(spark, rows)), plain(rows))


def test_graph_edges_survive_being_written(spark):
    lists = spark.createDataFrame([([2, 1],), ([],), ([0],)], "edges array<int>").select(F.col("edges"))
    rows = pruned_graph._edge_rows(lists.toArrow()["edges"].combine_chunks())
    assert rows.tolist() == [[2, 1], [3, 3], [0, 3]]
