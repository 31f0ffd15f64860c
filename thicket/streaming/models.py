"""Models in Structured Streaming: scoring a stream, and training on micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import row_metric
from ..operators.booster import Booster
from ..operators.frame import Frame


def score(model: Booster, stream: DataFrame, out: str = "prediction") -> DataFrame:
    """A stream with a prediction column; stateless, so any output mode works."""
    return model.predict(stream, out=out)


def windowed_metric(scored: DataFrame, ts: str, metric: str = "rmse", window: str = "1 hour", late: str = "2 hours", prediction: str = "prediction", label: str = "label") -> DataFrame:
    """(start, end, value, n): a row metric for each event-time window, with a watermark."""
    grouped = scored.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"))
    return grouped.agg(row_metric(metric, F.col(prediction), F.col(label)).alias("value"), F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "value", "n")


class IncrementalTrainer:
    """For ``foreachBatch``: adds rounds to a model with every micro-batch.

    A batch id that was seen is skipped, so a replayed batch trains once.
    """

    def __init__(self, model: Booster, frame_of: Callable[[DataFrame], Frame], rounds: int = 1, strategy: str = "auto"):
        self.model, self.frame_of, self.rounds, self.strategy, self.seen = model, frame_of, rounds, strategy, -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.seen or batch.isEmpty():
            return
        self.model = self.model.continue_fit(self.frame_of(batch), self.rounds, strategy=self.strategy)
        self.seen = batch_id
