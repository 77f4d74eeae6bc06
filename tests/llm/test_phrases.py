import re
import time
from collections import Counter
from pathlib import Path

import odd_rows
import pytest
from test_rules import compared, in_duckdb

from hackney.llm import phrase_setm
from hackney.llm.oracle import ORACLE

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, longest=3, share=50, top=2000):
    """The contract on tuples of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f.update((lang or "und", *words[k : k + size]) for k in range(len(words) - size + 1))
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    dropped = set()
    for (lang, *words), a in candidates.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                part = (lang, *words[k : k + size])
                if 100 * a >= share * candidates[part]:
                    dropped.add(part)
    by_lang = {}
    for (lang, *words), a in candidates.items():
        cuts = [(f[lang, *words[:k]], f[lang, *words[k:]], k) for k in range(1, len(words))]
        score, _, left, right = min((1000000 * a * a // (x * y), k, x, y) for x, y, k in cuts)
        if (lang, *words) not in dropped:
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def of(docs):
    return [tuple(r) for r in docs.select("lang", "text").collect()]


def test_op12_equals_a_plain_version_and_its_sql(spark):
    docs = spark.read.parquet(f"{odd_rows.SF}/documents.parquet")
    got = phrase_setm.op12(spark, docs)
    assert odd_rows.sorted_rows(got, *COLUMNS) == odd_rows.by_plain(plain(of(docs)))
    compared(got.toPandas(), in_duckdb(ORACLE["op12_phrase_setm"], documents=docs.toPandas()))


ODD = [
    *odd_rows.TEXTS,
    (20, "One two three; One\ttwo  three! one two three\r\n" * 4),
    (21, "x " * 40),  # overlapping occurrences
    (22, "É É É, \x00 \x00 \x00 " * 12),
    (23, " . , ; \t . " * 20),
]


@pytest.mark.parametrize("repeat", [1, 3])
def test_op12_on_odd_rows(spark, repeat):
    docs = odd_rows.documents(spark, ODD * repeat)
    got = odd_rows.sorted_rows(phrase_setm.op12(spark, docs), *COLUMNS)
    assert got == odd_rows.by_plain(plain(of(docs)))
    assert {r[0] for r in got} == {"en"}


def test_op12_takes_a_null_language_as_und(spark):
    rows = [(1, None, "to be or. " * 10), (2, "und", "to be or. " * 5), (3, "en", "to be")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = odd_rows.sorted_rows(phrase_setm.op12(spark, docs), *COLUMNS)
    assert got == [("und", 1, "to be or", 15, 15, 15, 45, 1000000)]


def test_op12_of_an_empty_table(spark):
    assert phrase_setm.op12(spark, odd_rows.documents(spark, [])).collect() == []
    assert phrase_setm.op12(spark, odd_rows.documents(spark, [(1, None), (2, ""), (3, "..")])).collect() == []


@pytest.mark.parametrize("block_words", [1, 50, 10**6])
def test_blocks_do_not_change_what_is_found(spark, block_words):
    docs = odd_rows.documents(spark, ODD)
    got = phrase_setm.mine(spark, docs, least=3, block_words=block_words)
    columns = ("lang", "phrase", "a", "l", "r", "n", "score")
    want = [(r[0], *r[2:]) for r in plain(of(docs), least=3)]
    assert odd_rows.sorted_rows(got.filter("not dropped"), *columns) == odd_rows.by_plain(want)


def test_phrases_of_more_words(spark):
    docs = spark.read.parquet(f"{odd_rows.SF}/documents.parquet")
    got = phrase_setm.mine(spark, docs, longest=5, least=12)
    columns = ("lang", "phrase", "a", "l", "r", "n", "score")
    want = [(r[0], *r[2:]) for r in plain(of(docs), least=12, longest=5, top=10**9)]
    assert odd_rows.sorted_rows(got.filter("not dropped"), *columns) == odd_rows.by_plain(want)


def test_counts_beyond_64_bit_products(spark):
    rows = [(5_000_000_000, 6_000_000_000, 7_000_000_000)]
    df = spark.createDataFrame(rows, "a long, part_1_1 long, part_2_2 long")
    cut = df.select(phrase_setm._cuts(2).alias("cut")).select("cut.*").first()
    a, left, right = rows[0]
    assert tuple(cut) == (1000000 * a * a // (left * right), 1, left, right)


def test_pairs_are_counted_and_kept_from_one_shuffle(spark):
    """Rows of a gram from many blocks: those of frequent ones stay, one is marked, nothing is joined."""
    counts = {(0, 1): [4, 6], (0, 2): [9], (1, 2): [1] * 10, (2, 0): [3, 6], (2, 1): [10]}
    grams = [
        (block << 33, "en", k, *gram, n, None)
        for k, (gram, by_block) in enumerate(counts.items())
        for block, n in enumerate(by_block)
    ]
    ends = [(block << 33, "en", -1, None, None, None, b"") for block in range(10)]
    relation = spark.createDataFrame(grams + ends, phrase_setm._gram_ddl(2)).repartition(3)
    kept = phrase_setm._kept(relation, ["w1", "w2"], 10)
    rows = odd_rows.sorted_rows(kept, "w1", "w2", "block", "at", "f")
    want = [(*r[3:5], r[0], r[2], sum(counts[r[3:5]])) for r in grams if sum(counts[r[3:5]]) >= 10]
    assert rows == odd_rows.by_plain(want)
    assert odd_rows.sorted_rows(kept.filter("first"), "lang", "w1", "w2", "f") == [
        ("en", 0, 1, 10),
        ("en", 1, 2, 10),
        ("en", 2, 1, 10),
    ]
    plan = phrase_setm._kept(spark.createDataFrame(grams, phrase_setm._gram_ddl(2)), ["w1", "w2"], 10)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_steps_leave_no_shuffle_files(spark):
    def shuffles():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        tops = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]
        return {f for top in tops for f in Path(top).rglob("shuffle_*") if f.suffix in (".data", ".index")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = spark.conf.get(setting), shuffles()
    rows = phrase_setm._stage(spark, spark.range(1000).repartition(4, "id"), "numbers")
    until = time.time() + 20
    while (left := shuffles() - was) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(setting) == before
    assert rows.count() == 1000
