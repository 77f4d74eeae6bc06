"""The whole run: raw, silver, gold."""

from dataclasses import dataclass

from pyspark.sql import SparkSession

from hackney.operators.intervals import Ranges
from hackney.plans.gold import build_gold
from hackney.plans.ingest import DEFAULT_CHUNK_SIZE, IngestResult, ingest
from hackney.plans.silver import build_silver


@dataclass(frozen=True)
class PipelineResult:
    raw: IngestResult
    silver_batches: Ranges
    gold_built: bool


def run_pipeline(
    spark: SparkSession,
    source: str | None,
    warehouse: str,
    load_mode: str = "incremental",
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    file: str | None = None,
    buckets: int = 64,
    parts: int = 1,
    key_filters: bool = False,
) -> PipelineResult:
    """Ingest what is new, then bring silver and gold up to date.

    Later stages look at pending batches rather than at this run's new files,
    so a run that failed half way is finished by the next one. ``key_filters`` is for
    ids without any order: new files get filters that tell which of them a merge needs.
    """
    raw = ingest(spark, source, warehouse, load_mode, chunk_size, file)
    batches = build_silver(spark, warehouse, load_mode, buckets, parts=parts, key_filters=key_filters)
    built = build_gold(spark, warehouse, load_mode, buckets, parts, key_filters)
    return PipelineResult(raw, batches, built)
