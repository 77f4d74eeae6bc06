"""Rows that operators must bear: nulls, empty and long texts, ties, repeated rows."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"
DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # names that operators use inside
        StructField("row", StringType()),
        StructField("print", StringType()),
        StructField("runs", StringType()),
        StructField("of", StringType()),
        StructField("k1", StringType()),
    ]
)

SENTENCE = "The quick brown fox jumps over the lazy dog, and no one minds at all."
LONG = " ".join(f"word{k % 997} and{k}" for k in range(60_000)) + "."
PASSAGE = " ".join(f"passage{k}" for k in range(80)) + "."
TEXTS = [
    (1, SENTENCE),
    (2, SENTENCE),
    (3, None),
    (4, ""),
    (5, " \n\t \n"),
    (None, SENTENCE + " Twice."),
    (None, None),
    (7, LONG),
    (8, "é" * 700),
    (9, "aaaa " * 300),
    (9, "aaaa " * 300),
    (10, f"Before. {PASSAGE}\nAfter this comes other text, ending well."),
    (11, f"Elsewhere {PASSAGE} it goes on differently. ÀÉÎ <|endoftext|> .. ,"),
    (12, "one two three"),
    (13, "\x00\x85   mixed \x1c İI"),
]


def documents(spark, rows=TEXTS, extra=("r", "p", "x", "o", "k")):
    data = [(i, t, None if i == 2 else "en", "src0", None if t is None else len(t), *extra) for i, t in rows]
    return spark.createDataFrame(data, DOCUMENTS).repartition(3)


def sorted_rows(df, *columns):
    """Rows as tuples, nulls first; order does not matter."""
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))


def by_plain(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
