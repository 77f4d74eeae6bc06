"""Times the headline queries; prints one JSON line.

Each query runs to a no-op sink, so every row and column is computed and
nothing is collected. A query counts with the better of two runs, which leaves
JVM warm-up out.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from hackney.queries import QUERIES  # noqa: E402
from hackney.schemas import SILVER  # noqa: E402
from hackney.session import local_session  # noqa: E402
from hackney.sources.tables import KeyedTable  # noqa: E402

HEADLINE = [
    "eta_training",
    "demand_prediction",
    "traffic_analysis",
    "traffic_analysis_daily",
    "rolling_1h",
    "rolling_24h",
    "lookahead_next_1h",
    "heatmap_grid",
    "silver_validate",
    "silver_build",
    "silver_last_write_wins",
    "upsert_silver",
    "fact_trips",
    "v_trip_report",
    "batch_assignment",
    "sha256_fingerprint",
    "incremental_new_files",
    "export_latest_n",
    "export_all_sorted",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("hackney-bench", os.environ.get("BENCH_CPUS", "8"))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    def merge() -> float:
        """One row of a hundred of the stored silver rows, changed, and as many new."""
        folder = tempfile.mkdtemp(prefix="hackney-bench-")
        rows = QUERIES["silver_build"](spark, sf_dir).withColumn(
            "updated_at", F.current_timestamp()
        )
        table = KeyedTable(spark, folder, SILVER, ["id"], buckets=16)
        table.merge(rows)
        batch = rows.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0)
        new = batch.withColumn("id", F.concat(F.lit("new"), "id"))
        start = time.perf_counter()
        table.merge(batch.unionByName(new))
        return round(time.perf_counter() - start, 3)

    times = {name: min(run(name), run(name)) for name in HEADLINE}
    times["merge_one_percent"] = min(merge(), merge())
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
