"""Recency-weighted change and hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 90.0


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def decayed(events: DataFrame, key: list[str], seconds: Column, now: Column | int, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """Per key the sum of 0.5 ^ (age / half-life); times after `now` have age 0. Partial sums combine before the shuffle."""
    now = F.lit(now) if isinstance(now, int) else now
    age = F.greatest(F.lit(0), now - seconds) / 86400.0
    return events.groupBy(*key).agg(F.sum(F.pow(F.lit(0.5), age / half_life_days)).alias("weight"), F.count("*").alias("n_changes"))


def hotspots(records: DataFrame, path: str, weight: str, complexity: str, lines: str) -> DataFrame:
    """score (0 to 100): change and density, each over its maximum, multiplied. Rows at 0 are dropped; no rows if a maximum is 0.

    The maxima are one row, joined back; no window over all rows.
    """
    density = F.when(F.col(lines) > 0, F.col(complexity) / F.col(lines)).otherwise(F.lit(0.0))
    r = records.withColumn("density", density)
    top = r.agg(F.max(weight).alias("__w"), F.max("density").alias("__d"))
    r = r.crossJoin(F.broadcast(top)).filter("__w > 0 and __d > 0")  # one row
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(weight) / F.col("__w") * (F.col("density") / F.col("__d")) * 100))
    return r.withColumn("score", score).filter("score > 0").drop("__w", "__d")


def top(records: DataFrame, n: int = 10, path: str = "path") -> DataFrame:
    """The best n by score, equal ones by path components."""
    order = F.split(path, "/") if dict(records.dtypes)[path] == "string" else F.col(path)
    return records.orderBy(F.desc("score"), order).limit(n)
