"""Groups of rows inside a stream of Arrow batches.

``DataFrame.repartition(keys).sortWithinPartitions(keys)`` followed by
``mapInArrow`` sees each group as one run of rows.  ``runs`` re-cuts the stream
at group ends, so a worker holds one batch plus one unfinished group; callers
bound the size of a group before the shuffle (by splitting large ones).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new run begins, 0 excluded."""
    differs = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for key in keys:
        column = table.column(key).to_numpy()
        differs |= column[1:] != column[:-1]
    return np.flatnonzero(differs) + 1


def blocks_of_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs with the bounds of each run (length = runs + 1)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        cuts = _changes(table, keys)
        if len(cuts) == 0:
            continue
        last = int(cuts[-1])
        yield table.slice(0, last), np.concatenate(([0], cuts))
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.concatenate(([0], _changes(table, keys), [table.num_rows]))
