"""The pipeline against a plain version of its stages, each on what came before it."""

import subprocess
import sys
import textwrap
from pathlib import Path

import brute
import odd_rows
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from hackney.llm.scratch import stage
from hackney.llm.word_tokens import default_path

REPO = Path(__file__).parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave, over the smallest tables."""
    docs = spark.read.parquet(f"{odd_rows.SF}/documents.parquet")
    out = []
    for name, step in pipeline.STAGES:
        got = stage(spark, step(spark, docs, odd_rows.SF), name.replace(" ", "-"))
        out.append((docs.toPandas(), got.toPandas()))
        docs = got
    return out


def test_all_but_the_last_stage_return_the_columns_of_documents(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, after in stages[:-1]:
        assert list(after.columns) == columns


def test_quality_keeps_whole_rows_and_most_documents(stages):
    # These 87 labels make no view sure enough to reject; test_learned.py has more.
    before, after = stages[0]
    assert 0.7 * len(before) < len(after) <= len(before)
    same = before.merge(after, on="doc_id", suffixes=("", "_after"))
    assert len(same) == len(after) and (same["text"] == same["text_after"]).all()


def test_one_document_of_each_near_group_stays(stages):
    before, after = stages[1]
    prints = [int(brute.simhash(t), 16) for t in before["text"]]
    least = brute.near_components(list(before["doc_id"]), prints)
    assert sorted(after["doc_id"]) == sorted(set(least))


def test_passages_of_over_fifty_words_are_cut(stages):
    before, after = stages[2]
    want = dict(zip(before["doc_id"], brute.without_passages(list(before["text"]), 51), strict=True))
    assert dict(zip(after["doc_id"], after["text"], strict=True)) == want
    assert (after["n_chars"] == after["text"].str.len()).all()


def test_leaks_go_and_clean_documents_stay(spark, stages):
    before, after = stages[3]
    items = spark.read.parquet(f"{odd_rows.SF}/benchmark.parquet").collect()
    hit = brute.leaks(list(before["text"]), [(r["item_id"], r["text"]) for r in items])
    want = [d for d, h in zip(before["doc_id"], hit, strict=True) if not h[-1]]
    assert sorted(after["doc_id"]) == sorted(want)


def test_every_token_is_packed(stages):
    before, after = stages[4]
    tokenizer = Tokenizer.from_file(default_path())
    want = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in before["text"])
    assert after["length"].sum() == want
    assert after.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run_gives_the_last_stages_rows(spark, stages):
    rows = pipeline.run(spark, odd_rows.SF)
    got = odd_rows.sorted_rows(rows, "doc_id", "piece", "start", "length", "ids_crc32")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got == sorted(stages[4][1][names].itertuples(index=False, name=None))


def test_stages_bear_odd_and_empty_tables(spark):
    for rows in (odd_rows.TEXTS, []):
        docs = odd_rows.documents(spark, rows)
        for name, step in pipeline.STAGES[:-1]:
            after = stage(spark, step(spark, docs, odd_rows.SF), name.replace(" ", "-"))
            assert after.columns == docs.columns
            docs = after
        assert pipeline.STAGES[-1][1](spark, docs, odd_rows.SF).count() >= bool(rows)


def test_the_rest_works_without_these_operators():
    code = """
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name.startswith(("hackney.llm", "corpus_pipeline")):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
        assert len(e.queries()) == len(e.oracle_sql()) > 30
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=REPO, check=True, timeout=120)
