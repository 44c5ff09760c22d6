"""Which epochs were the best so far, kept right while epoch records arrive late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FLAGS = "run string, epoch int, value double, is_best boolean, revision bigint"


class BestSoFar(StatefulProcessor):
    """State of a run: the value of each epoch, its flag as given last, and a count of revisions.

    A late epoch can take the flag from later ones. Whatever changes is given again under a higher revision.
    """

    def __init__(self, lower_is_better: bool, start: float):
        self.lower_is_better, self.start = lower_is_better, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epochs = handle.getMapState("epochs", "epoch int", "value double, is_best boolean")
        self.revision = handle.getValueState("revision", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: (v[0], v[1]) for k, v in self.epochs.iterator()}
        flags = {epoch: flag for epoch, (_, flag) in known.items()}
        values = {epoch: value for epoch, (value, _) in known.items()}
        fresh = set()
        for part in rows:
            for epoch, value in zip(part["epoch"], part["value"]):
                values[int(epoch)] = float(value)
                fresh.add(int(epoch))
        revision = (self.revision.get()[0] if self.revision.exists() else 0) + 1
        self.revision.update((revision,))
        best, changed = self.start, []
        for epoch in sorted(values):
            value = values[epoch]
            flag = value < best if self.lower_is_better else value > best
            best = value if flag else best
            if epoch in fresh or flags.get(epoch) != flag:
                self.epochs.updateValue((epoch,), (value, flag))
                changed.append((key[0], epoch, value, flag, revision))
        yield pd.DataFrame(changed, columns=["run", "epoch", "value", "is_best", "revision"])

    def close(self) -> None:
        pass


def streamed_improvements(epochs: DataFrame, metric: str, lower_is_better: bool = True, start: float | None = None) -> DataFrame:
    """``run, epoch, value, is_best, revision`` of a stream of epoch records: a row for each flag that is new or has changed.

    Records without run, epoch or value are ignored; a repeated epoch takes the place of the one before. State is a row for
    each epoch of a run. Needs the RocksDB state store. :func:`latest_flags` gives what holds at last.
    """
    first = start if start is not None else (float("inf") if lower_is_better else float("-inf"))
    rows = epochs.select("run", "epoch", F.col(metric).cast("double").alias("value")).where("run is not null and epoch is not null and value is not null")
    return rows.groupBy("run").transformWithStateInPandas(BestSoFar(lower_is_better, first), FLAGS, "Update", "None")


def latest_flags(flags: DataFrame) -> DataFrame:
    """``run, epoch, is_best`` of the highest revision of each epoch; a row that was written twice counts once."""
    last = F.max_by("is_best", "revision").alias("is_best")
    return flags.groupBy("run", "epoch").agg(last)
