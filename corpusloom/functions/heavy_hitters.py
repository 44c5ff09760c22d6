"""Arrow function that keeps the frequent values of a task in bounded space. It is sent to the workers by value."""

from __future__ import annotations

import sys
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def summaries(capacity: int):
    """Batches of a list column to ``kind, value, n``: the values a task counted, by at most ``capacity`` counters.

    Whenever there are twice as many, all counters lose the count of the first one that is to go. A value without a counter
    occurs at most as often as counters have lost in all, and one with a counter at most that much more often than it says.
    Two rows without a value tell this loss and the number of all values.
    """

    def run(batches):
        counters: Counter = Counter()
        lost = total = 0
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten())
            values, counts = found.field("values").to_pylist(), found.field("counts").to_pylist()
            total += sum(counts)
            counters.update(dict(zip(values, counts)))
            if len(counters) > 2 * capacity:
                cut = sorted(counters.values(), reverse=True)[capacity]
                counters = Counter({v: n - cut for v, n in counters.items() if n > cut})
                lost += cut
        rows = [("value", v, n) for v, n in counters.items()] + [("lost", None, lost), ("total", None, total)]
        kinds, values, counts = zip(*rows)
        columns = [pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "value", "n"])

    return run
