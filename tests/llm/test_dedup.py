import brute
import numpy as np
import odd_rows
import pyarrow as pa
import pytest

from hackney.llm import simhash_bktree as sim
from hackney.llm import substring_dedup as sub
from hackney.llm.components import components


def docs_of(spark):
    return spark.read.parquet(f"{odd_rows.SF}/documents.parquet")


def plain_op3(rows):
    texts = [t for _, t in rows]
    return odd_rows.by_plain((d, *x) for (d, _), x in zip(rows, brute.substrings(texts), strict=True))


OP3 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_op3_on_odd_rows(spark):
    got = odd_rows.sorted_rows(sub.op3(spark, odd_rows.documents(spark)), *OP3)
    assert got == plain_op3(odd_rows.TEXTS)


def test_op3_on_the_driver_table(spark):
    docs = docs_of(spark)
    got = odd_rows.sorted_rows(sub.op3(spark, docs), *OP3)
    assert got == plain_op3([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(2))
def test_op3_on_texts_made_of_shared_parts(spark, seed):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdé "))
    parts = ["".join(rng.choice(letters, int(rng.integers(100, 900)))) for _ in range(12)]
    rows = []
    for d in range(40):
        cuts = [parts[rng.integers(len(parts))] for _ in range(int(rng.integers(1, 5)))]
        cuts = [c[int(rng.integers(0, 60)) : len(c) - int(rng.integers(0, 60))] for c in cuts]
        rows.append((d, "".join(x + "".join(rng.choice(letters, 3)) for x in cuts)))
    got = odd_rows.sorted_rows(sub.op3(spark, odd_rows.documents(spark, rows)), *OP3)
    assert got == plain_op3(rows)
    assert any(r[2] for r in got) and not all(r[2] == r[1] for r in got)


def test_op3_of_an_empty_table(spark):
    assert sub.op3(spark, odd_rows.documents(spark, [])).collect() == []


def test_anchors_are_those_of_the_string_alone():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 110, 500).astype(np.uint8)
    rows = []
    for _ in range(2):
        raw = np.concatenate([rng.integers(97, 110, int(rng.integers(0, 900))).astype(np.uint8), shared])
        _, low, high, _, bucket, _ = sub.anchor_rows(raw, np.array([0]), np.array([len(raw)]))
        starts = range(len(raw) - 500, len(raw) - 399)
        rows.append([int(bucket[(low <= s) & (s <= high)][0]) for s in starts])
    assert rows[0] == rows[1]


def as_table(batches):
    return pa.Table.from_batches(list(batches)).to_pandas()


@pytest.mark.parametrize(("chunk", "gather"), [(700, 1500), (450, 100), (1 << 19, 1 << 18)])
def test_chunks_cover_every_start_once(monkeypatch, chunk, gather):
    monkeypatch.setattr(sub, "CHUNK", chunk)
    monkeypatch.setattr(sub, "GATHER", gather)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab c"), n)) for n in (399, 400, 401, 5000, 0, 820)] + [None, "ab" * 900]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    rows = as_table(sub.find_rows(sub.BYTES)([batch]))
    for k, text in enumerate(texts):
        own = rows[rows["row"] == k]
        starts = [x for a, b in zip(own["low"], own["high"], strict=True) for x in range(a, b + 1)]
        assert sorted(starts) == list(range(max(0, len(text or "") - 399)))
        for r in own.itertuples():
            assert r.high <= r.at <= r.low + 336
    ids = {}
    for block in sub.BYTES.blocks:
        runs = [
            rows[rows["row"] == k][["low", "high", "at"]].to_dict("records") for k in range(len(texts))
        ]
        cut = pa.RecordBatch.from_pydict(
            {"row": list(range(len(texts))), "text": texts, "runs": runs},
        ).slice(0, len(texts))
        keep = pa.array([bool(r) for r in runs])
        found = as_table(sub.cut_blocks(block, sub.BYTES)([cut.filter(keep)]))
        for k, text in enumerate(texts):
            own = found[found["row"] == k]
            starts = [x for a, b in zip(own["low"], own["high"], strict=True) for x in range(a, b + 1)]
            assert sorted(starts) == list(range(max(0, len(text or "") - 399)))
        ids[block] = found
    single = ids[1]
    by_string = {}
    for r in single.itertuples():
        string = texts[r.row].encode()[r.low : r.low + 400]
        assert by_string.setdefault((r.bucket, r.kind), string) == string
    assert len(by_string) == len(set(by_string.values()))


def test_without_repeats_keeps_rows_columns_and_characters(spark):
    docs = odd_rows.documents(spark)
    got = sub.without_repeats(spark, docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {(r["doc_id"], r["n_chars"]): r["text"] for r in got.collect()}
    by_id = {d: t for (d, _), t in rows.items()}
    assert by_id[3] is None and by_id[1] == odd_rows.SENTENCE
    assert by_id[10] == "Before. After this comes other text, ending well."
    assert all(n is None or n == len(t) for (_, n), t in rows.items())
    assert {r["k1"] for r in got.collect()} == {"k"}


def texts_of(df):
    return odd_rows.sorted_rows(df.withColumn("n_chars", df["n_chars"].cast("long")), "doc_id", "text", "n_chars")


def plain_without(rows, size=sub.WORDS):
    kept = brute.without_passages([t for _, t in rows], size)
    return odd_rows.by_plain((d, t, None if t is None else len(t)) for (d, _), t in zip(rows, kept, strict=True))


def test_without_repeats_on_odd_and_driver_rows(spark):
    got = sub.without_repeats(spark, odd_rows.documents(spark))
    assert texts_of(got) == plain_without(odd_rows.TEXTS)
    docs = docs_of(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = texts_of(sub.without_repeats(spark, docs))
    assert found == plain_without(rows)
    assert sum(r[1] != dict(rows)[r[0]] for r in found) > 5
    assert sub.without_repeats(spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("size", [16, 51, 70])
def test_without_repeats_on_texts_made_of_shared_parts(spark, seed, size):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{c}{k}" for k in range(4) for c in "aé"]

    def some(n):
        return list(rng.choice(vocabulary, int(n)))

    parts = [some(rng.integers(size // 2, 3 * size)) for _ in range(10)]
    parts.append(["again"] * (2 * size))  # repeats itself, in one document or several
    rows = []
    for d in range(40):
        words = []
        for _ in range(int(rng.integers(1, 5))):
            part = parts[rng.integers(len(parts))]
            words += part[int(rng.integers(0, 9)) : len(part) - int(rng.integers(0, 9))] + some(3)
        gaps = rng.choice([" ", "\n", " \t "], len(words))
        rows.append((d, "".join(w + g for w, g in zip(words, gaps, strict=True))))
    rows.append((40, " ".join(["alone"] * (3 * size))))  # repeated in its own document only
    got = texts_of(sub.without_repeats(spark, odd_rows.documents(spark, rows), size))
    assert got == plain_without(rows, size)
    assert (40, rows[-1][1], len(rows[-1][1])) in got
    assert any(r[1] == "" or r[1] != dict(rows)[r[0]] for r in got)


@pytest.mark.parametrize(("chunk", "gather", "piece"), [(70, 150, 90), (60, 10, 1 << 20)])
def test_word_chunks_cover_every_start_once(monkeypatch, chunk, gather, piece):
    for name, value in (("CHUNK", chunk), ("GATHER", gather), ("PIECE", piece)):
        monkeypatch.setattr(sub, name, value)
    how = sub.words_kind()
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abc"), n)) + "\n" for n in (50, 51, 52, 600, 0, 103)] + [None, "ab " * 90, "x" * 200]
    for text, units in zip(texts, sub.word_units(texts), strict=True):
        words = (text or "").split()
        assert len(units) == len(words)
        assert len(set(zip(words, map(tuple, units.tolist()), strict=True))) == len(set(words))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    rows = as_table(sub.find_rows(how)([batch]))
    runs = [rows[rows["row"] == k][["low", "high", "at", "lo", "hi"]].to_dict("records") for k in range(len(texts))]
    cut = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "text": texts, "runs": runs})
    single = as_table(sub.cut_blocks(1, how)([cut.filter(pa.array([bool(r) for r in runs]))]))
    for found in (rows, single):
        for k, text in enumerate(texts):
            own = found[found["row"] == k]
            starts = [x for a, b in zip(own["low"], own["high"], strict=True) for x in range(a, b + 1)]
            assert sorted(starts) == list(range(max(0, len((text or "").split()) - 50)))
            assert set(own["lo"]) <= {k} and set(own["hi"]) <= {k}
    by_string = {}
    for r in single.itertuples():
        string = tuple(texts[r.row].split()[r.low : r.low + 51])
        assert by_string.setdefault((r.bucket, r.kind), string) == string
    assert len(by_string) == len(set(by_string.values()))


def test_op6_on_odd_rows_and_driver_rows(spark):
    docs = docs_of(spark)
    for df, rows in (
        (odd_rows.documents(spark), odd_rows.TEXTS),
        (docs, [(r["doc_id"], r["text"]) for r in docs.collect()]),
    ):
        prints = [brute.simhash(t) for _, t in rows]
        least = brute.near_components([d for d, _ in rows], [int(p, 16) for p in prints])
        want = odd_rows.by_plain(
            (d, p, c) for (d, _), p, c in zip(rows, prints, least, strict=True)
        )
        got = odd_rows.sorted_rows(sim.op6(spark, df), "doc_id", "fingerprint", "component_id")
        assert got == want


def test_op6_of_an_empty_table(spark):
    assert sim.op6(spark, odd_rows.documents(spark, [])).collect() == []


def near_prints(n=600, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    out = set()
    while len(out) < n:
        p = int(centres[rng.integers(12)])
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            p ^= 1 << int(b)
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [16, 4096])
def test_near_links_connect_what_all_pairs_connect(spark, shard_rows):
    prints = near_prints()
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    links = sim.near_links(spark, df, shard_rows=shard_rows)
    roots = {r["node"]: r["root"] for r in components(spark, links).collect()}
    classes = {}
    for k, p in enumerate(signed):
        classes.setdefault(roots.get(p, p), set()).add(k)
    want = brute.near_components(list(range(len(prints))), prints)
    plain = {}
    for k, c in enumerate(want):
        plain.setdefault(c, set()).add(k)
    assert {frozenset(c) for c in classes.values()} == {frozenset(c) for c in plain.values()}


def test_trees_follow_only_edges_within_the_radius():
    prints = np.array(near_prints(400, 4), np.uint64)
    shard = np.sort(np.random.default_rng(0).integers(0, 5, 400))
    forest = sim.BKForest(prints, shard)
    q, n = forest.within(prints, shard, 4)
    got = set(zip(q.tolist(), n.tolist(), strict=True))
    want = {
        (a, b)
        for a in range(400)
        for b in range(400)
        if shard[a] == shard[b] and int(prints[a] ^ prints[b]).bit_count() <= 4
    }
    assert got == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(spark, links).collect()}
    assert roots == {**{k: 0 for k in range(1, 61)}, 101: 100}
    assert components(spark, links.limit(0)).collect() == []


def test_keep_one_keeps_the_least_of_each_group(spark):
    docs = odd_rows.documents(spark)
    got = sim.keep_one(spark, docs)
    assert got.columns == docs.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=lambda x: (x is None, x))
    rows = odd_rows.TEXTS
    least = brute.near_components([d for d, _ in rows], [int(brute.simhash(t), 16) for _, t in rows])
    assert ids == sorted(set(least), key=lambda x: (x is None, x))
