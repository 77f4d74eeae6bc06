"""Benchmark passages in documents, by the search of Wu and Manber.

A document and an item are sequences of words (lower-case ASCII letters, digits and
everything beyond ASCII). A window is ``WINDOW`` consecutive words of an item, or all
of a shorter item. Texts are searched as bytes: words joined by spaces, with a
space at either end, so a match of ``" w1 ... wn "`` is a match of whole words.

Patterns of similar length form a class with its least length m. Of each pattern the
last block of its first m bytes names its bucket; a shift table over hashed blocks
says how far the next occurrence of any pattern must lie, and positions between are
never looked at. Where the shift is zero, the bucket's patterns are compared
directly, byte by byte. The scan runs in many lanes over a batch of documents at
once, so each step is one vector operation.

The windows are a broadcast of checked size: items are split into blocks of at most
``BLOCK_BYTES`` of patterns, and each block is a search of all documents of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches, stage
from .worker import held

WINDOW = 10
BLOCK_BYTES = 32 << 20
TABLE_BITS = 20
LANES = 2048
#: Bytes of text searched together; longer documents are searched in parts.
BATCH_BYTES = 2 << 20
#: Least lengths of the classes of patterns.
CLASSES = (1, 4, 8, 16, 32, 48, 64)

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:128] = ord(" ")
_TABLE[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_TABLE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TABLE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORD_BYTES = _TABLE.tobytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def windows_of(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The different windows of an item as patterns; none without words."""
    words = words_of(text)
    n = max(1, len(words) - window + 1) if words else 0
    return list(dict.fromkeys(b" " + b" ".join(words[k : k + window]) + b" " for k in range(n)))


class WuManber:
    """Tables of one class of patterns: ``least`` is at most their shortest length."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        self.numbers = np.array(numbers, np.int64)
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
        reach = self.m - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, reach, np.int16 if reach < 1 << 15 else np.int32)
        hashes = self.hashes(self.bytes)
        for k in range(reach):
            np.minimum.at(self.shift, hashes[self.begin + k], reach - 1 - k)
        suffix = hashes[self.begin + reach - 1]
        order = np.lexsort((self.lengths, suffix))
        self.suffix, self.order = suffix[order], order

    def hashes(self, text: np.ndarray) -> np.ndarray:
        """The hash of the block that starts at each byte."""
        v = text.astype(np.uint64)
        have = 1
        while have < self.block:
            more = min(have, self.block - have)
            ahead = np.zeros_like(v)
            ahead[: len(v) - more] = v[more:]
            v |= ahead << np.uint64(8 * more)  # a block has at most 8 bytes
            have += more
        return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def candidates(self, text: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) where the shift is zero: a pattern's first m bytes may start."""
        last = len(text) - self.m + 1
        none = np.empty(0, np.int64)
        if last <= 0:
            return none, none
        hashes = self.hashes(text)
        width = -(-last // lanes)
        at = np.arange(0, last, width)
        end = np.minimum(at + width, last)
        tail = self.m - self.block
        places, kinds = [none], [none]
        while len(at):
            h = hashes[at + tail]
            skip = self.shift[h].astype(np.int64)
            hit = skip == 0
            if hit.any():
                places.append(at[hit])
                kinds.append(h[hit])
            at = at + np.maximum(skip, 1)
            live = at < end
            at, end = at[live], end[live]
        return np.concatenate(places), np.concatenate(kinds)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of all occurrences, each compared in full."""
        place, h = self.candidates(text)
        low, high = np.searchsorted(self.suffix, h), np.searchsorted(self.suffix, h, "right")
        found_p, found_k = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = 0
        while True:  # the step-th pattern of every candidate's bucket
            live = low + step < high
            if not live.any():
                break
            low, high, place = low[live], high[live], place[live]
            kind = self.order[low + step]
            size = self.lengths[kind]
            fits = place + size <= len(text)
            p, k = place[fits], kind[fits]
            same = self._equal(text, p, k)
            found_p.append(p[same])
            found_k.append(self.numbers[k[same]])
            step += 1
        return np.concatenate(found_p), np.concatenate(found_k)

    def _equal(self, text: np.ndarray, place: np.ndarray, kind: np.ndarray) -> np.ndarray:
        same = np.ones(len(place), bool)
        left = np.arange(len(place))
        at = 0
        while len(left):
            left = left[at < self.lengths[kind[left]]]
            ok = text[place[left] + at] == self.bytes[self.begin[kind[left]] + at]
            same[left[~ok]] = False
            left = left[ok]
            at += 1
        return same


class Matcher:
    """All patterns of a block, in classes of length."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.words = np.array([p.count(b" ") - 1 for p in patterns], np.int64)
        self.longest = max(map(len, patterns), default=0)
        by_class: dict[int, list[int]] = {}
        for k, p in enumerate(patterns):
            by_class.setdefault(int(np.searchsorted(CLASSES, len(p), "right")), []).append(k)
        self.classes = [WuManber([patterns[k] for k in ks], ks) for ks in by_class.values()]

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [c.find(text) for c in self.classes]
        none = np.empty(0, np.int64)
        return (
            np.concatenate([none, *(p for p, _ in found)]),
            np.concatenate([none, *(k for _, k in found)]),
        )


#: Of a document: words, runs of hit words as [first, last) and numbers of windows.
Hits = tuple[int, np.ndarray, np.ndarray]


def search(texts: Iterable[str | None], matcher: Matcher) -> list[Hits]:
    """Hits of each text; texts are searched together up to ``BATCH_BYTES``."""
    out: list[Hits] = []
    held: list[list[bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        lines = [b" " + b" ".join(w) + b" " if w else b"" for w in held]
        # A zero byte between documents is in no pattern: matches never cross.
        text = np.frombuffer(b"\0".join(lines) + b"\0", np.uint8)
        n = np.array([len(x) + 1 for x in lines], np.int64)
        starts = np.cumsum(n) - n
        place, window = _find_in_parts(text, matcher)
        doc = np.searchsorted(starts, place, "right") - 1
        order = np.argsort(doc, kind="stable")
        doc, place, window = doc[order], place[order], window[order]
        low = np.searchsorted(doc, np.arange(len(held)))
        high = np.searchsorted(doc, np.arange(len(held)), "right")
        for k, words in enumerate(held):
            a, b = int(low[k]), int(high[k])
            spans = np.empty((0, 2), np.int64)
            if a < b:
                w = np.array([len(x) + 1 for x in words], np.int64)
                at = np.cumsum(w) - w
                first = np.searchsorted(at, place[a:b] - starts[k])
                stop = first + matcher.words[window[a:b]]
                spans = merged(np.stack([first, stop], axis=1))
            out.append((len(words), spans, np.unique(window[a:b])))
        held.clear()
        size = 0

    for text in texts:
        words = words_of(text)
        held.append(words)
        size += sum(map(len, words)) + len(words)
        if size >= BATCH_BYTES:
            flush()
    if held:
        flush()
    return out


def _find_in_parts(text: np.ndarray, matcher: Matcher) -> tuple[np.ndarray, np.ndarray]:
    """Parts overlap by the longest pattern less one byte; a place counts once."""
    places, windows = [], []
    over = max(matcher.longest - 1, 0)
    for at in range(0, len(text), 2 * BATCH_BYTES):
        place, window = matcher.find(text[at : at + 2 * BATCH_BYTES + over])
        own = place < 2 * BATCH_BYTES
        places.append(place[own] + at)
        windows.append(window[own])
    return np.concatenate(places), np.concatenate(windows)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted runs [first, last) that cover the same places."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > top[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], top[last]], axis=1)


def _matcher(name: str, patterns) -> Matcher:
    """The worker's tables for a block; those of one block are held at a time."""
    return held(("patterns", name), lambda: Matcher(patterns.value))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window) of every item; null and wordless texts have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                found = windows_of(text, window)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())],
                        ["item_id", "window"],
                    )

    slim = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return slim.mapInArrow(cut, "item_id string, window binary")


def pattern_blocks(spark: SparkSession, windows: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """(name, broadcast patterns) for each block; a block's size is checked."""
    small_batches(spark)
    distinct = stage(spark, windows.select("window").distinct(), "windows")
    total = distinct.agg(F.sum(F.length("window"))).first()[0] or 0
    n = -(-total // block_bytes)
    name, blocks = uuid.uuid4().hex, []
    for k in range(n):
        block = distinct.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        found = sorted(bytes(r["window"]) for r in block.toLocalIterator())
        if found:
            blocks.append((f"{name}-{k}", spark.sparkContext.broadcast(found)))
    return blocks


HITS = """doc_id long, row long, digest long, size long, n_words long,
    spans array<struct<first:long,last:long>>, windows array<binary>"""


def scan(documents: DataFrame, block, all_rows: bool = True) -> DataFrame:
    """What one block of patterns hits in each document (doc_id, text).

    ``digest`` and ``size`` of the text with doc_id name equal rows across blocks.
    ``all_rows`` false leaves out documents without hits.
    """
    name, patterns = block or ("none", None)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, patterns) if patterns is not None else Matcher([])
        kinds = [
            pa.int64(),
            pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
            pa.list_(pa.binary()),
        ]
        for batch in batches:
            texts = (t.as_py() for t in batch[4])
            cols, keep = ([], [], []), []
            for k, (n, spans, found) in enumerate(search(texts, matcher)):
                if all_rows or len(found):
                    keep.append(k)
                    cols[0].append(n)
                    cols[1].append([{"first": a, "last": b} for a, b in spans.tolist()])
                    cols[2].append([matcher.patterns[w] for w in found.tolist()])
            own = batch.select([0, 1, 2, 3]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))],
                ["doc_id", "row", "digest", "size", "n_words", "spans", "windows"],
            )

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("text").alias("digest"),
        F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("size"),
        "text",
    ).mapInArrow(find, HITS)


def leaks(
    spark: SparkSession,
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    A null text has no words, in documents and items alike. Repeated rows are judged
    alike, each. An item of null id is searched for, but has no id to list. Empty
    tables give no rows or no hits. Other columns are not read.
    """
    windows = stage(spark, item_windows(benchmark, window), "items")
    blocks = pattern_blocks(spark, windows, block_bytes)
    hits = stage(spark, scan(documents, blocks[0] if blocks else None), "hits")
    key = ["doc_id", "digest", "size"]
    for block in blocks[1:]:
        # Equal rows have equal hits, so one of them stands for all.
        more = scan(documents, block, all_rows=False).groupBy(*key).agg(
            F.first("spans").alias("more_spans"), F.first("windows").alias("more_windows")
        )
        more = more.select(*(F.col(k).alias(f"of_{k}") for k in key), "more_spans", "more_windows")
        same = [hits[k].eqNullSafe(more[f"of_{k}"]) for k in key]
        hits = hits.join(more, same, "left").select(
            *key,
            "row",
            "n_words",
            F.concat("spans", F.coalesce("more_spans", F.array())).alias("spans"),
            F.concat("windows", F.coalesce("more_windows", F.array())).alias("windows"),
        )
    if blocks[1:]:
        hits = stage(spark, hits, "hits")
    listed = (
        hits.select("row", F.explode("windows").alias("window"))
        .join(windows.distinct(), "window")
        .groupBy(F.col("row").alias("of"))
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("top")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["top"]))).alias("n"),
            F.greatest(acc["top"], s["last"]).alias("top"),
        ),
        lambda acc: acc["n"],
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    return hits.join(listed, hits["row"] == listed["of"], "left").select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


def without_leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents``, all columns, without those that hold a window of the benchmark.

    Null and empty texts hold none and stay; repeated rows stay or go together. Items without
    words have no window. Empty tables take nothing away.
    """
    kept = documents
    for name, patterns in pattern_blocks(spark, stage(spark, item_windows(benchmark), "items")):
        kept = kept.filter(_is_clean(name, patterns)("text"))
    return kept


def _is_clean(name: str, patterns):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not len(w) for _, _, w in search(texts, _matcher(name, patterns))], dtype=bool)

    return clean


def op7(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(spark, documents, benchmark)
