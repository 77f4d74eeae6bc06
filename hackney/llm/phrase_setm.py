"""Phrases by set-oriented mining over stored occurrence relations.

The relation of length 1 has every occurrence of a word: its place and its word. Places
count upwards through the pieces of a text and skip one at each end of a piece, so
"same piece, next position" is the place plus one. Each round

1. sorts the blocks' grams, which brings together the rows of a gram;
2. from that one sort both counts the groups, summing a gram's occurrences over
   blocks, and keeps the rows of those that are frequent;
3. merge-joins the occurrences left with themselves, place with place plus one, and
   writes the relation that is one word longer.

A relation is stored in blocks of some ``BLOCK_WORDS`` words of one language: a row for each
different gram with how often the block has it, and one row with the occurrences in
order of place, packed. No piece lies in two blocks, so the merge join stays in its
block, and what Spark shuffles are grams counted by block and numbers of frequent
grams, never occurrences by gram. Words are numbered
once, by the table of frequent words; a longer gram is the numbers of its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hackney.operators.numbering import rows_before

from .scratch import dropping_shuffles, small_batches, stage
from .worker import groups, release

LEAST = 10
LONGEST = 3
SHARE = 50
TOP = 2000
#: Words and ends of pieces of a block; its last run of pieces may go beyond.
BLOCK_WORDS = 2_000_000
NO_LANG = "und"

_ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS))
_NOTHING, _END = 0, 1  # codes of what is no word
#: Rows of a relation: grams of a block, numbered by ``at``, and one with its occurrences.
_WORDS = pa.schema(
    [
        ("block", pa.int64()),
        ("lang", pa.string()),
        ("at", pa.int32()),
        ("word", pa.string()),
        ("times", pa.int64()),
        ("occurrences", pa.binary()),
    ]
)
_WORDS_DDL = "block long, lang string, at int, word string, times long, occurrences binary"
_OCCURRENCES = -1  # ``at`` of the row that has them; sorts before the grams


def _names(size: int) -> list[str]:
    return [f"w{k}" for k in range(1, size + 1)]


def _gram_schema(size: int) -> pa.Schema:
    numbers = [(name, pa.int64()) for name in [*_names(size), "times"]]
    lead, end = list(_WORDS)[:3], [("occurrences", pa.binary())]
    return pa.schema([*lead, *numbers, *end])


def _gram_ddl(size: int) -> str:
    numbers = ", ".join(f"{name} long" for name in [*_names(size), "times"])
    return f"block long, lang string, at int, {numbers}, occurrences binary"


def pack(place: np.ndarray, gram: np.ndarray) -> bytes:
    """Occurrences in order of place, as compressed differences and gram numbers."""
    both = np.stack([np.diff(place, prepend=0), gram]).astype("<i4")
    # like bytes of all numbers side by side
    return zstandard.compress(both.reshape(2, -1, 1).view(np.uint8).transpose(0, 2, 1).tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    gap, gram = raw.reshape(2, 4, -1).transpose(0, 2, 1).copy().view("<i4")[..., 0]
    return np.cumsum(gap), gram


def _rows(schema: pa.Schema, block: int, lang: str, place: np.ndarray, gram: np.ndarray, *columns):
    """Batches of a block: the row of its occurrences, then its grams."""
    none = [pa.nulls(1, f.type) for f in list(schema)[3:-1]]
    lead = [pa.array([block]), pa.array([lang]), pa.array([_OCCURRENCES], pa.int32()), *none, pa.array([pack(place, gram)])]
    yield pa.RecordBatch.from_arrays(lead, schema=schema)
    for k in range(0, len(columns[0]), 50_000):
        part = [pa.array(c[k : k + 50_000], f.type) for c, f in zip(columns, list(schema)[3:-1], strict=True)]
        n = len(part[0])
        at = pa.array(np.arange(k, k + n, dtype=np.int32))
        own = [pa.array(np.full(n, block)), pa.repeat(pa.scalar(lang), n), at, *part, pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(own, schema=schema)


class _Block:
    """Occurrences of words of one language, as they come."""

    def __init__(self):
        self.codes = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.found: list[np.ndarray] = []
        self.units = 0
        self.codes[b""], self.codes[b"\n"]  # _NOTHING, _END

    def add(self, text: bytes) -> None:
        """Takes whole pieces, lower-cased, each ended by a line end."""
        units = (text.replace(b"\n", b" \n ") + b" \n").split(b" ")
        codes = np.fromiter(map(self.codes.__getitem__, units), np.int32, len(units))
        self.found.append(codes[codes != _NOTHING])
        self.units += len(self.found[-1])

    def rows(self, block: int, lang: str) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.found)
        place = np.flatnonzero(codes != _END)
        gram = codes[place] - 2
        words = [w.decode() for w in list(self.codes)[2:]]
        if words:
            yield from _rows(_WORDS, block, lang, place, gram, words, np.bincount(gram, minlength=len(words)))


def _runs(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes that end where a piece ends."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b"\n", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def word_blocks(block_words: int):
    """Blocks of the relation of words, of rows (lang, text), for ``mapInArrow``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[str, _Block] = {}
        total, made = 0, 0
        first = TaskContext.get().partitionId() << 33

        for batch in batches:
            for lang, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                for run in _runs((text.as_py() or "").encode().translate(_LOWER)):
                    block = held.setdefault(lang, _Block())
                    block.add(run)
                    total += len(block.found[-1])
                    # many languages together hold no more than two blocks
                    if block.units >= block_words or total >= 2 * block_words:
                        largest = max(held, key=lambda name: held[name].units)
                        block = held.pop(largest)
                        total -= block.units
                        yield from block.rows(first + made, largest)
                        made += 1
        for name, block in held.items():
            yield from block.rows(first + made, name)
            made += 1

    return read


def merge_join(place: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, head, tail) of occurrences whose next place is an occurrence too.

    Both sides are the same relation, sorted by place, so the merge looks one row ahead.
    """
    at = np.flatnonzero(place[1:] == place[:-1] + 1)
    return place[at], number[at], number[at + 1]


def extend(size: int):
    """The relation of grams of ``size`` words, of the one a word shorter, for ``mapInArrow``.

    Rows (block, at, lang, words' numbers, occurrences) are sorted by block and at: a block has
    its occurrences first, then those of its grams that are frequent.
    """
    schema, words = _gram_schema(size), _names(size - 1)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in groups(batches, "block"):
            place, gram = unpack(rows["occurrences"][0].as_py())
            at = rows["at"][1:].to_numpy()
            numbers = [rows[c][1:].to_numpy() for c in words]
            row = np.full(int(gram.max()) + 1, -1, np.int64)
            row[at] = np.arange(len(at))
            row = row[gram]
            frequent = row >= 0
            place, head, tail = merge_join(place[frequent], row[frequent])
            if len(place):
                pairs, gram, times = np.unique(head * len(at) + tail, return_inverse=True, return_counts=True)
                head, tail = pairs // len(at), pairs % len(at)
                columns = [*(n[head] for n in numbers), numbers[-1][tail], times]
                yield from _rows(schema, rows["block"][0].as_py(), rows["lang"][0].as_py(), place, gram, *columns)

    return longer


def _stage(spark: SparkSession, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """A step's table; the shuffles that it took hold more than the table and go with the step."""
    with dropping_shuffles(spark):
        return stage(spark, df, name, compression)


def _numbered(spark: SparkSession, counted: DataFrame, name: str) -> DataFrame:
    """``counted``, written, each row with a number of its own, without gaps."""
    rows = _stage(spark, counted.withColumn("mark", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("piece", F.shiftright("mark", 33))
    pieces = rows_before(rows.groupBy("piece").agg(F.count("*").alias("rows")), "piece", "rows")
    number = F.col("rows_before") + F.col("mark") - F.shiftleft("piece", 33)
    rows = rows.join(pieces.drop("rows"), "piece").withColumn("id", number)
    return _stage(spark, rows.drop("piece", "mark", "rows_before"), f"{name}-numbered")


def _count(relation: DataFrame, *gram: str) -> DataFrame:
    """(lang, gram, f): the groups of a relation, summed from their counts by block."""
    grams = relation.filter(F.col("at") != _OCCURRENCES)
    return grams.groupBy("lang", *gram).agg(F.sum("times").alias("f"))


def _kept(relation: DataFrame, words: list[str], least: int) -> DataFrame:
    """The blocks' grams that are frequent, each with f; ``first`` marks one row of a gram.

    Rows of a gram, one a block at most, meet in one sort; it is counted and kept there, so
    nothing is joined and no gram is shuffled twice. Numbers differ by language.
    """
    grams = relation.filter(F.col("at") != _OCCURRENCES).select("block", "at", "lang", *words, "times")
    same = Window.partitionBy(*words)
    rows = grams.withColumn("f", F.sum("times").over(same)).withColumn("first", F.col("block") == F.min("block").over(same))
    return rows.filter(F.col("f") >= least).drop("times")


def _longer(spark: SparkSession, relation: DataFrame, keep: DataFrame, size: int) -> DataFrame:
    """The relation of ``size`` words: the grams of ``keep``, merge-joined with themselves."""
    words = _names(size - 1)
    places = relation.filter(F.col("at") == _OCCURRENCES).select("block", "at", "lang", "occurrences")
    rows = places.unionByName(keep.select("block", "at", *words), allowMissingColumns=True)
    rows = rows.select("block", "at", "lang", *words, "occurrences")
    rows = rows.repartition("block").sortWithinPartitions("block", "at")
    return _stage(spark, rows.mapInArrow(extend(size), _gram_ddl(size)), f"occurrences-{size}", "zstd")


def frequent_phrases(
    spark: SparkSession,
    documents: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    block_words: int = BLOCK_WORDS,
) -> tuple[list[DataFrame], DataFrame]:
    """Frequent grams of each length, and the words of each language (lang, n).

    The first table is (lang, w1, word, f), where w1 is the word's number; that of length k is
    (lang, w1 to wk, f). Numbers differ by language too.
    """
    small_batches(spark)
    texts = documents.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").filter("text is not null")
    relation = _stage(spark, texts.mapInArrow(word_blocks(block_words), _WORDS_DDL), "words", "zstd")
    words = _stage(spark, _count(relation, "word"), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    tables = [_numbered(spark, words.filter(F.col("f") >= least), "frequent-1").withColumnRenamed("id", "w1")]
    grams = relation.filter(F.col("at") != _OCCURRENCES)
    keep = grams.join(tables[0].select("lang", "word", "w1"), ["lang", "word"])
    for size in range(2, longest + 1):
        relation, own = _longer(spark, relation, keep, size), _names(size)
        if size < longest:
            keep = _stage(spark, _kept(relation, own, least), f"kept-{size}", "zstd")
            tables.append(keep.filter("first").select("lang", *own, "f"))
        else:
            frequent = _count(relation, *own).filter(F.col("f") >= least)
            tables.append(_stage(spark, frequent, f"frequent-{size}"))
    return tables, totals


def _cuts(size: int) -> Column:
    """The lowest-scoring cut of words 1 to ``size``: struct of score, k, l and r.

    ``part_i_j`` is f of words i to j. Products stay exact: 38 decimal digits hold 10**6 * a * a
    up to counts of 10**15.
    """

    def number(name: str) -> str:
        return f"cast({name} as decimal(19, 0))"

    def cut(k: int) -> Column:
        left, right = f"part_1_{k}", f"part_{k + 1}_{size}"
        # both as decimal(38, 0); the quotient is a whole number of at most 10**6
        top = f"cast(1000000 as decimal(7, 0)) * cast({number('a')} * {number('a')} as decimal(31, 0))"
        below = f"cast({number(left)} * {number(right)} as decimal(38, 0))"
        score = F.expr(f"cast({top} as decimal(38, 0)) div {below}").alias("score")
        return F.struct(score, F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    cuts = [cut(k) for k in range(1, size)]
    return cuts[0] if len(cuts) == 1 else F.least(*cuts)


def _with_parts(tables: list[DataFrame], size: int) -> DataFrame:
    """Grams of ``size`` words, spelled, with f of every part that a cut leaves."""
    rows = tables[size - 1].withColumnRenamed("f", "a")
    for width in range(1, size):
        for i in (1, size - width + 1):
            own = _names(size)[i - 1 : i - 1 + width]
            part = tables[width - 1].select(*_names(width), F.col("f").alias(f"part_{i}_{i + width - 1}"))
            rows = rows.join(part.toDF(*own, part.columns[-1]), own)
    for name in _names(size):
        word = tables[0].select(F.col("w1").alias(name), F.col("word").alias(f"word_{name}"))
        rows = rows.join(word, name)
    return rows.withColumn("phrase", F.concat_ws(" ", *(f"word_{name}" for name in _names(size))))


def mine(
    spark: SparkSession,
    documents: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    share: int = SHARE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every candidate phrase: lang, size, phrase, a, l, r, n, score and dropped.

    A phrase of 2 to ``longest`` words is a candidate if it occurs ``least`` times in its language.
    ``dropped``: its words lie inside a longer candidate that occurs at least ``share``
    percent as often. Null texts and languages without a candidate give no rows, a null
    language counts as ``und``. Repeated rows count again.
    """
    tables, totals = frequent_phrases(spark, documents, longest, least, block_words)
    out, around = [], None
    for size in range(longest, 1, -1):
        words = _names(size)
        rows = _with_parts(tables, size).withColumn("cut", _cuts(size))
        rows = rows.select("lang", F.lit(size).alias("size"), *words, "phrase", "a", "cut.l", "cut.r", "cut.score")
        if around is None:
            rows = rows.withColumn("most", F.lit(0).cast("long"))
        else:
            rows = rows.join(around, words, "left").withColumn("most", F.coalesce("most", F.lit(0)))
        out.append(rows.withColumn("dropped", F.col("most") * 100 >= F.col("a") * share).drop(*words))
        # How often the most frequent gram that is one word longer occurs around each; a gram
        # longer still occurs no more often, and holds one of these.
        ends = tables[size - 1].select(*words[:-1], "f").union(tables[size - 1].select(*words[1:], "f"))
        around = _stage(spark, ends.groupBy(*words[:-1]).agg(F.max("f").alias("most")), "around")
    found = reduce(DataFrame.unionByName, out).drop("most")
    return found.join(totals, "lang").select("lang", "size", "phrase", "a", "l", "r", "n", "score", "dropped")


def op12(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``TOP`` phrases.

    Null texts count as empty, a null language as ``und``; repeated rows count again.
    Ties go by a, then by the bytes of the phrase. An empty table gives no rows.
    Columns other than text and lang are not read.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    rows = _stage(spark, mine(spark, documents).filter("not dropped"), "candidates")
    rows = rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= TOP)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
