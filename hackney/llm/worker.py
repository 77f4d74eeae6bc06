"""What a Python worker keeps from one task to the next.

Workers serve tasks of all operators in turn. What an operator keeps to be quicker in
its next task (a tokenizer's words, search tables) is let go when a task of
another operator, or for other data, begins: memory never adds up over a pipeline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

_HELD: dict[Any, Any] = {}


def held(name: Any, make: Callable[[], Any]) -> Any:
    """The object of this name, made if the worker does not hold it; others go."""
    if name not in _HELD:
        release()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """For tasks that keep nothing; what earlier batches took goes back as well."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key``, a number, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if b == a:
                continue
            if held and held[-1][key][0] != batch[key][int(a)]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
