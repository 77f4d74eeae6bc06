import zlib
from hashlib import sha256

import odd_rows
import pytest
from pyspark.sql import functions as F
from test_rules import compared, in_duckdb

from hackney.llm import merkle_manifest
from hackney.llm.oracle import ORACLE

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[k : k + 3]) for k in range(0, len(below), 3)])
    return levels


def plain(rows):
    """The contract on tuples of (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by_source[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in by_source[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        for i, row in enumerate(by_source[name]):
            copy = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                copy = (*row[:4], row[4].replace("\n", ""))
            h, siblings = leaf(copy), []
            for levels, j in ((trees[name], i), (top, at)):
                for nodes in levels[:-1]:
                    first = j // 3 * 3
                    left, right = nodes[first:j], nodes[j + 1 : first + 3]
                    siblings += left + right
                    h, j = digest(*left, h, *right), j // 3
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[name][-1][0], root, digest(*siblings), h, h == root))
    return out


def of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_op13_equals_a_plain_version_and_its_sql(spark):
    docs = spark.read.parquet(f"{odd_rows.SF}/documents.parquet")
    got = merkle_manifest.op13(spark, docs)
    assert odd_rows.sorted_rows(got, *COLUMNS) == odd_rows.by_plain(plain(of(docs)))
    compared(got.toPandas(), in_duckdb(ORACLE["op13_merkle_manifest"], documents=docs.toPandas()))


def test_op13_on_odd_rows(spark):
    docs = odd_rows.documents(spark).withColumn("source", F.when(F.col("doc_id") > 8, F.lit("ß")).otherwise(F.col("lang")))
    rows = odd_rows.sorted_rows(merkle_manifest.op13(spark, docs), *COLUMNS)
    assert rows == odd_rows.by_plain(plain(of(docs)))
    assert len(rows) == len(odd_rows.TEXTS)


def test_op13_of_an_empty_table_and_of_one_row(spark):
    assert merkle_manifest.op13(spark, spark.createDataFrame([], DDL)).collect() == []
    docs = spark.createDataFrame([(4, "a\nb", "en", None, 3)], DDL)
    (row,) = merkle_manifest.op13(spark, docs).collect()
    assert row.leaf == row.subroot == row.root == digest("1:4", "-", "2:en", "1:3", "3:a\nb")
    assert row.proof_sha256 == sha256().hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, n):
    rows = [(k, f"line {k}\nand more", "en", "hot" if k % 5 else None, k) for k in range(n)]
    docs = spark.createDataFrame(rows, DDL)
    got = odd_rows.sorted_rows(merkle_manifest.op13(spark, docs), *COLUMNS)
    assert got == odd_rows.by_plain(plain(of(docs)))


def test_a_source_of_more_leaves_than_two_tiers_hold_at_once(spark):
    n = merkle_manifest.ARITY**merkle_manifest.BLOCK_LEVELS * 4 + 1  # five blocks, the last of one leaf
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("text\n"), F.col("id")).alias("text"),
        F.lit("en").alias("lang"),
        F.when(F.col("id") < n - 2, F.lit("hot")).alias("source"),
        F.lit(1).alias("n_chars"),
    )
    docs = docs.union(docs.filter("doc_id = 7"))
    got = odd_rows.sorted_rows(merkle_manifest.op13(spark, docs), *COLUMNS)
    assert got == odd_rows.by_plain(plain(of(docs)))


def test_blocks_pass_through_levels_like_a_whole_tree():
    nodes = [digest(str(k)).encode() for k in range(3**7 + 5)]
    whole = tree([n.decode() for n in nodes])
    size = 3**7
    blocks = [merkle_manifest.block_levels(nodes[k : k + size], len(nodes))[-1] for k in (0, size)]
    assert [b[0].decode() for b in blocks] == whole[7]


def test_proofs_lead_to_the_root_and_fail_for_anything_else(spark):
    leaves = spark.createDataFrame(
        [(k, "s" if k % 3 else "t", digest(str(k)), digest(str(k))) for k in range(23)],
        "doc_id long, source string, leaf string, claimed string",
    )
    for row in merkle_manifest.manifest(spark, leaves).collect():
        assert merkle_manifest.fold(row.leaf, row.proof) == row.root == row.folded_root
        assert merkle_manifest.fold(digest("other"), row.proof) != row.root


def test_resumed_states_equal_hashing_the_whole_parent():
    run = [digest(str(k)).encode() for k in range(3)]
    for slot, (state, right) in enumerate(merkle_manifest.slot_states(run)):
        changed = [*run[:slot], b"x" * 64, *run[slot + 1 :]]
        assert merkle_manifest.resume(state, b"x" * 64, right).decode() == sha256(b"".join(changed)).hexdigest()
