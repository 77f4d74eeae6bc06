"""Dated Parquet exports of the products."""

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hackney.operators.numbering import rows_before
from hackney.operators.selection import newest_span, seconds_of
from hackney.plans.gold import fact_trips
from hackney.plans.products import PRODUCTS
from hackney.sources.storage import delete_path

DEFAULT_MAX_ROWS = 1000
ALL_ROWS = -1
# A limit up to this is taken as a top-k by one task and written as one file.
ONE_TASK_ROWS = 100_000


@dataclass(frozen=True)
class ExportResult:
    product: str
    rows: int
    path: str


def newest_first(product: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Rows by pickup time, newest first, NULL times leading.

    The other columns break ties: the cut is repeatable, and a moment shared by
    many rows still splits into sort ranges. ``-1`` keeps all rows.
    """
    if max_rows < ALL_ROWS:
        raise ValueError(f"max_rows must be -1 or more, not {max_rows}")
    others = [c for c in product.columns if c != "pickup_datetime"]
    ordered = product.orderBy(F.col("pickup_datetime").desc_nulls_first(), *others)
    return ordered if max_rows == ALL_ROWS else ordered.limit(max_rows)


def _first_rows(product: DataFrame, max_rows: int, stage: str) -> DataFrame:
    """Exactly the first ``max_rows`` of ``newest_first``, by many tasks.

    The product is written once. Histograms of its times find the span with the last
    row to keep; rows newer than that are in, older ones out, and only those in it are
    sorted to be cut.
    """
    product.write.mode("overwrite").parquet(f"{stage}/rows")
    rows = product.sparkSession.read.schema(product.schema).parquet(f"{stage}/rows")
    span = newest_span(rows, "pickup_datetime", max_rows)
    if span is None:
        return newest_first(rows, ALL_ROWS)
    at = seconds_of(rows, "pickup_datetime")
    if span.high is None:
        newer, last = rows.where(F.lit(False)), rows.where("pickup_datetime IS NULL")
    else:
        newer = rows.where((at >= span.high) | F.col("pickup_datetime").isNull())
        last = rows.where((at >= span.low) & (at < span.high))
    if span.above + span.inside > max_rows:
        last = _cut(last, max_rows - span.above, f"{stage}/last")
    return newest_first(newer.unionByName(last), ALL_ROWS)


def _cut(rows: DataFrame, count: int, stage: str) -> DataFrame:
    """The first ``count`` of ``rows`` in the order of ``newest_first``.

    The sorted rows are written with their place in their sort range. Counting the
    ranges tells how many rows lie before each, and so which rows to keep.
    """
    newest_first(rows, ALL_ROWS).withColumn(
        "_mark", F.monotonically_increasing_id()
    ).write.mode("overwrite").parquet(stage)
    # The upper bits of a mark are the number of its sort range.
    marked = rows.sparkSession.read.parquet(stage).withColumn("_range", F.shiftright("_mark", 33))
    sizes = marked.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = rows_before(sizes, "_range", "_size").select("_range", "rows_before")
    place = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("rows_before")
    return marked.join(before, "_range").where(place < count).select(*rows.columns)


def export_product(
    product: DataFrame,
    name: str,
    out: str,
    max_rows: int = DEFAULT_MAX_ROWS,
    export_date: date | None = None,
) -> ExportResult:
    """Write one product below ``<out>/products/<name>/export_date=<day>``.

    The same day is replaced, other days stay. An export of at most ``ONE_TASK_ROWS``
    rows is one file; a larger one is as many as its sort has ranges.
    """
    day = (export_date or date.today()).isoformat()
    root = f"{out}/products/{name}"
    path = f"{root}/export_date={day}"
    seen = Observation(f"export_{name}")
    stage = f"{out}/products/_stage/{name}"
    if max_rows > ONE_TASK_ROWS:
        rows = _first_rows(product, max_rows, stage)
    else:
        rows = newest_first(product, max_rows)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    if ALL_ROWS < max_rows <= ONE_TASK_ROWS:
        rows = rows.coalesce(1)
    # Dynamic mode swaps the day in only after the job has succeeded.
    rows.withColumn("export_date", F.lit(day)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("export_date").parquet(root)
    count = seen.get["rows"]
    if max_rows > ONE_TASK_ROWS:
        delete_path(product.sparkSession, stage)
    if count == 0:
        # No rows make no partition, and the day must not keep an old export.
        product.limit(0).coalesce(1).write.mode("overwrite").parquet(path)
    return ExportResult(name, count, path)


def export_products(
    spark: SparkSession,
    warehouse: str,
    out: str,
    max_rows: int = DEFAULT_MAX_ROWS,
    export_date: date | None = None,
    names: list[str] | None = None,
    buckets: int = 64,
) -> list[ExportResult]:
    """Export every registered product (or ``names``) from the fact table."""
    fact = fact_trips(spark, warehouse, buckets).read()
    return [
        export_product(PRODUCTS[name](fact), name, out, max_rows, export_date)
        for name in (names or PRODUCTS)
    ]


def register_views(spark: SparkSession, warehouse: str, buckets: int = 64) -> None:
    """The products and the report as temporary views of the session."""
    from hackney.plans.gold import dim_date, v_trip_report

    fact = fact_trips(spark, warehouse, buckets).read()
    for name, product in PRODUCTS.items():
        product(fact).createOrReplaceTempView(name)
    dates = dim_date(spark, warehouse).read()
    v_trip_report(fact, dates).createOrReplaceTempView("v_trip_report")
