"""Continuous monitoring: scores arrive as a stream, falls against the last score of a URL come out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "url string, ts timestamp, previous double, current double, delta double"


def regressions(stream: DataFrame, url: str = "url", ts: str = "ts", score: str = "score", threshold: float = 5.0) -> DataFrame:
    """(url, ts, previous, current, delta) of the audits whose score fell by more than the threshold.

    The state of a URL is its last score and time. Audits of one batch are taken in the order of
    time; audits older than the state compare to nothing and leave it alone. NULL scores are skipped.
    """
    rows = stream.select(F.col(url).alias("url"), F.col(ts).cast("timestamp").alias("ts"), F.col(score).cast("double").alias("score")).dropna()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        out = []
        frames = [b for b in batches if len(b)]
        if frames:
            for r in pd.concat(frames).sort_values(["ts", "score"], kind="stable").itertuples():
                stamp = r.ts.value
                if at is not None and stamp < at:
                    continue
                if last is not None and round(r.score - last, 1) < -threshold:
                    out.append((key[0], r.ts, last, r.score, round(r.score - last, 1)))
                last, at = float(r.score), stamp
            state.update((last, at))
        yield pd.DataFrame(out, columns=["url", "ts", "previous", "current", "delta"])

    return rows.groupBy("url").applyInPandasWithState(update, OUTPUT, "last double, at long", "append", GroupStateTimeout.NoTimeout)


def windowed_scores(stream: DataFrame, ts: str, score: str, keys: list[str], window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Count and mean score per key and window; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score"))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Starts handle(batch, id) on every batch: once over what is there, or at an interval."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stop_below(minimum: float, score: str = "score") -> Callable[[DataFrame, int], None]:
    """A handler that ends the stream at the first batch with a score below the minimum."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        worst = batch.agg(F.min(score).alias("m")).collect()[0].m
        if worst is not None and worst < minimum:
            raise ValueError(f"score {worst} is below {minimum}")

    return handle
