"""Training-event analytics.

Running values over a long epoch are computed in two levels: blocks of consecutive steps are scanned side by side, and each
starts from the totals of the blocks before it. One epoch that holds most of the events is many blocks, not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 10_000


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def nsp_accuracy(rows: DataFrame) -> DataFrame:
    """Percent of rows whose highest of two ``logits`` is the label ``is_next``."""
    hit = (_argmax(F.col("logits")) == F.col("is_next")).cast("double")
    return rows.agg(F.coalesce(F.avg(hit) * 100, F.lit(0.0)).alias("nsp_acc"), F.count("*").alias("n"))


def mlm_accuracy(labelled: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of labelled positions predicted right; no labelled position gives 0."""
    joined = labelled.join(predicted, keys, "left")
    right = F.coalesce(F.sum((F.col("prediction") == F.col("label")).cast("bigint")), F.lit(0))
    return joined.agg((right / F.greatest(F.lit(1), F.count("*")) * 100).alias("mlm_acc"), F.count("*").alias("n"))


def cross_entropy(logits: Column, label: Column) -> Column:
    """``log(sum(exp(logits))) - logits[label]``, shifted by the highest logit."""
    values = F.transform(logits, lambda v: v.cast("double"))
    top = F.array_max(logits).cast("double")
    total = F.aggregate(
        F.transform(F.arrays_zip(values.alias("v"), F.array_repeat(top, F.size(logits)).alias("m")), lambda z: F.exp(z["v"] - z["m"])),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.log(total) + top - F.get(logits, label).cast("double")


def batch_losses(nsp: DataFrame, mlm: DataFrame) -> DataFrame:
    """Per ``batch_id`` the mean next-sentence and masked-token losses and their sum; no masked position costs nothing."""
    by_nsp = nsp.groupBy("batch_id").agg(F.avg(cross_entropy(F.col("logits"), F.col("is_next"))).alias("nsp_loss"))
    by_mlm = mlm.groupBy("batch_id").agg(F.avg(cross_entropy(F.col("logits"), F.col("label"))).alias("mlm_loss"))
    joined = by_nsp.join(by_mlm, "batch_id", "left").fillna(0.0, ["mlm_loss"])
    return joined.withColumn("loss", F.col("nsp_loss") + F.col("mlm_loss"))


def qa_batch_losses(rows: DataFrame) -> DataFrame:
    """Per ``batch_id`` half the sum of the mean start and end losses."""
    start = F.avg(cross_entropy(F.col("start_logits"), F.col("start_position")))
    end = F.avg(cross_entropy(F.col("end_logits"), F.col("end_position")))
    return rows.groupBy("batch_id").agg(((start + end) * 0.5).alias("loss"))


def _block_scan(events: DataFrame, by: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """Running sums in ``order`` within ``by``, over blocks of ``BLOCK`` consecutive values of a whole-number order, and
    whether the row ``is_last``."""
    blocked = events.withColumn("_block", F.expr(f"`{order}` div {BLOCK}"))
    totals = blocked.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    blocks = W.partitionBy(*by).orderBy("_block")
    before = blocks.rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *by,
        "_block",
        F.lead("_block").over(blocks).isNull().alias("_last_block"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums],
    )
    steps = W.partitionBy(*by, "_block").orderBy(order)
    inside = steps.rowsBetween(W.unboundedPreceding, 0)
    local = blocked.withColumns(
        {**{f"_l_{n}": F.sum(c).over(inside) for n, c in sums.items()}, "_end": F.lead(order).over(steps).isNull()}
    )
    joined = local.join(starts, [*by, "_block"])
    made = {n: F.col(f"_s_{n}") + F.col(f"_l_{n}") for n in sums}
    return joined.withColumns({**made, "is_last": F.col("_end") & F.col("_last_block")}).select(
        *events.columns, *sums, "is_last"
    )


def running_means(events: DataFrame, order: str = "step", by: tuple[str, ...] = ("run", "epoch")) -> DataFrame:
    """Adds the batch number ``i``, the mean loss of the run's epoch so far and whether the batch ``is_last`` in it."""
    scanned = _block_scan(
        events, list(by), order, {"_sum": F.col("batch_loss"), "_n": F.lit(1).cast("bigint")}
    )
    means = scanned.withColumns({"i": F.col("_n") - 1, "running_loss": F.col("_sum").cast("double") / F.col("_n")})
    return means.drop("_sum", "_n")


def running_accuracy(
    events: DataFrame, correct: str, total: str, name: str, order: str = "step", by: tuple[str, ...] = ("run", "epoch")
) -> DataFrame:
    """Adds the accuracy in percent of the run's epoch so far, weighted by elements."""
    scanned = _block_scan(events, list(by), order, {"_c": F.col(correct), "_e": F.col(total)})
    return scanned.withColumn(name, F.col("_c").cast("double") / F.greatest(F.lit(1), F.col("_e")) * 100).drop("_c", "_e", "is_last")


def epoch_summary(batches: DataFrame, by: tuple[str, ...] = ("run", "epoch")) -> DataFrame:
    """Per run and epoch the mean of the batch losses, whatever their sizes, and accuracies weighted by elements."""
    losses = [F.avg(c).alias(f"avg_{c}") for c in ("loss", "mlm_loss", "nsp_loss")]
    accuracies = [
        (F.sum(f"{t}_correct") / F.greatest(F.lit(1), F.sum(f"{t}_total")) * 100).alias(f"{t}_acc")
        for t in ("mlm", "nsp")
    ]
    return batches.groupBy(*by).agg(*losses, *accuracies)


def logged_steps(steps: DataFrame, log_freq: int) -> DataFrame:
    """Every ``log_freq``-th batch of an epoch and its last one, from the result of :func:`running_means`."""
    return steps.filter((F.pmod("i", F.lit(log_freq)) == 0) | F.col("is_last"))


def improvements(epochs: DataFrame, metric: str, lower_is_better: bool = True, start: float | None = None) -> DataFrame:
    """Adds ``is_best``: whether the epoch beats every earlier one (and ``start``). Input has one row per run and epoch."""
    before = W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    seen = (F.min if lower_is_better else F.max)(metric).over(before)
    bound = F.lit(start if start is not None else (float("inf") if lower_is_better else float("-inf")))
    best = (F.least if lower_is_better else F.greatest)(F.coalesce(seen, bound), bound)
    beats = F.col(metric) < best if lower_is_better else F.col(metric) > best
    return epochs.withColumn("is_best", beats)


def best_epoch(flagged: DataFrame) -> DataFrame:
    """The epoch whose checkpoint is kept: the last improvement of each run."""
    return flagged.filter("is_best").groupBy("run").agg(F.max("epoch").alias("epoch"))


def final_metrics(events: DataFrame, split: str, metrics: list[str]) -> DataFrame:
    """The metrics of the last epoch record of a split, per run."""
    chosen = events.filter((F.col("event") == "epoch") & (F.col("split") == split))
    last = F.max_by(F.struct("epoch", *metrics), "epoch").alias("m")
    return chosen.groupBy("run").agg(last).select("run", "m.*")


def epoch_curve(events: DataFrame, metrics: list[str]) -> DataFrame:
    """Epoch records in order, per run and split."""
    chosen = events.filter(F.col("event") == "epoch").select("run", "split", "epoch", *metrics)
    return chosen.orderBy("run", "split", "epoch")
