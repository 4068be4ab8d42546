"""Comparisons of scores over time and between groups: regressions, baselines, thresholds, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_previous(history: DataFrame, key: str, order: list[str], scores: list[str], bucket: Column | None = None) -> DataFrame:
    """Adds prev_<score> of the row before, per key and in the given order (time first).

    Rows are compared within (key, bucket), the day by default; the first row of a bucket gets the
    last row of the key's bucket before. No task sorts a whole key, however many rows it has.
    """
    rows = history.withColumn("_b", F.to_date(order[0]) if bucket is None else bucket)
    inner = W.partitionBy(key, "_b").orderBy(*order)
    rows = rows.withColumns({"_first": F.row_number().over(inner) == 1} | {f"_in_{s}": F.lag(s).over(inner) for s in scores})
    ends = rows.groupBy(key, "_b").agg(F.max_by(F.struct(*scores), F.struct(*order)).alias("_last"))
    before = ends.select(key, "_b", F.lag("_last").over(W.partitionBy(key).orderBy("_b")).alias("_before"))
    joined = rows.join(before, [key, "_b"])
    previous = {f"prev_{s}": F.when(F.col("_first"), F.col(f"_before.{s}")).otherwise(F.col(f"_in_{s}")) for s in scores}
    return joined.withColumns(previous).drop("_b", "_first", "_before", *[f"_in_{s}" for s in scores])


def regressions(history: DataFrame, key: str, order: list[str], score: str, pillars: list[str], threshold: float = 5.0) -> DataFrame:
    """Rows whose score fell by more than the threshold, with the rounded change of every pillar."""
    rows = with_previous(history, key, order, [score, *pillars])
    deltas = {f"delta_{s}": F.bround(F.col(s) - F.col(f"prev_{s}"), 1) for s in [score, *pillars]}
    return rows.withColumns(deltas).filter(F.col(f"delta_{score}") < -threshold)


def latest(history: DataFrame, key: str, order: list[str], n: int = 1) -> DataFrame:
    """The last n rows per key with their place, newest first; planned as a group limit before the shuffle."""
    w = W.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return history.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def against_baseline(current: DataFrame, baseline: DataFrame, key: str, scores: list[str], threshold: float = 5.0, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """(key, pillar, previous, current, delta) of the scores that got worse by more than the threshold."""
    c = current.select(key, F.inline(F.array(*[F.struct(F.lit(s).alias("pillar"), F.col(s).cast("double").alias("current")) for s in scores])))
    b = baseline.select(key, F.inline(F.array(*[F.struct(F.lit(s).alias("pillar"), F.col(s).cast("double").alias("previous")) for s in scores])))
    delta = F.bround(F.col("current") - F.col("previous"), 1)
    worse = F.when(F.col("pillar").isin(*lower_is_better), delta > threshold).otherwise(delta < -threshold) if lower_is_better else delta < -threshold
    return c.join(b, [key, "pillar"]).withColumn("delta", delta).filter(worse).select(key, "pillar", "previous", "current", "delta")


def threshold_failures(df: DataFrame, key: str, minima: dict[str, float | None], maxima: dict[str, float | None]) -> DataFrame:
    """(key, pillar, actual, bound) of every violated bound; equality passes, bounds of None are skipped."""
    checks = [F.when(F.col(c) < v, F.struct(F.lit(c).alias("pillar"), F.col(c).cast("double").alias("actual"), F.lit(float(v)).alias("bound"))) for c, v in minima.items() if v is not None]
    checks += [F.when(F.col(c) > v, F.struct(F.lit(c).alias("pillar"), F.col(c).cast("double").alias("actual"), F.lit(float(v)).alias("bound"))) for c, v in maxima.items() if v is not None]
    return df.select(key, F.inline(F.array_compact(F.array(*checks))))


def pairwise(a: DataFrame, b: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """(key, pillar, score_a, score_b, delta, winner) of two sets of scores, in long form."""
    x = a.select(key, F.inline(F.array(*[F.struct(F.lit(s).alias("pillar"), F.col(s).cast("double").alias("score_a")) for s in scores])))
    y = b.select(key, F.inline(F.array(*[F.struct(F.lit(s).alias("pillar"), F.col(s).cast("double").alias("score_b")) for s in scores])))
    delta = F.bround(F.col("score_a") - F.col("score_b"), 1)
    winner: Column = F.when(delta > 0, "a").when(delta < 0, "b").otherwise("tie")
    return x.join(y, [key, "pillar"]).withColumn("delta", delta).withColumn("winner", winner)
