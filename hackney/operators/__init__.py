from hackney.operators.incremental import (
    distinct_batches,
    first_delivery,
    insert_if_absent,
    max_batch_no,
    new_files,
    pending_batches,
)
from hackney.operators.intervals import Ranges, as_numbers, as_ranges, pending_ranges
from hackney.operators.latest import (
    first_by_key,
    latest_by_key,
    merge_by_key,
    repeated_keys,
)
from hackney.operators.numbering import assign_batches, number_by_key, rows_before
from hackney.operators.rolling import Frame, rolling_statistics
from hackney.operators.validation import RULES, clean, rule_counts, validate

__all__ = [
    "Frame",
    "RULES",
    "Ranges",
    "as_numbers",
    "as_ranges",
    "assign_batches",
    "clean",
    "distinct_batches",
    "first_by_key",
    "first_delivery",
    "insert_if_absent",
    "latest_by_key",
    "max_batch_no",
    "merge_by_key",
    "new_files",
    "number_by_key",
    "pending_batches",
    "pending_ranges",
    "repeated_keys",
    "rolling_statistics",
    "rows_before",
    "rule_counts",
    "validate",
]
