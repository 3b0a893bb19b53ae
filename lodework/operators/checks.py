"""Threshold checks: metrics against limits, breakdowns by category, name suffixes, summaries and report groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.functions.scalars import severity


def tripped(records: DataFrame, keys: list[str], limits: dict[str, tuple[Column, float]], eligible: Column | None = None) -> DataFrame:
    """A row (keys, kind, metric, threshold, severity) for each metric strictly over its limit.

    Narrow: the metrics of a record are filtered as an array before it is taken apart, so that records
    without a finding never become rows.
    """
    if eligible is not None:
        records = records.filter(eligible)
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), metric.cast("long").alias("metric"), F.lit(limit).cast("long").alias("threshold")) for kind, (metric, limit) in limits.items()])
    rows = records.select(*keys, F.inline(F.filter(found, lambda x: x["metric"] > x["threshold"])))
    return rows.withColumn("severity", severity(F.col("metric"), F.col("threshold")))


def breakdown(members: DataFrame, parent: list[str], category: Column, categories: list[str], limit: int | None = None) -> DataFrame:
    """Counts of the categories for each parent and their total; members of no listed category don't count. Only parents over the limit, if there is one."""
    counted = members.select(*parent, category.alias("__c"))
    out = counted.groupBy(*parent).agg(*[F.count_if(F.col("__c") == c).alias(f"n_{c.lower()}") for c in categories])
    total = sum((F.col(f"n_{c.lower()}") for c in categories[1:]), F.col(f"n_{categories[0].lower()}"))
    out = out.withColumn("total", total)
    return out.filter(F.col("total") > limit) if limit is not None else out


def suffixed(records: DataFrame, scope: list[str], name: str, arity: Column, counts: Column | None = None) -> DataFrame:
    """Names that occur more than once in their scope get /arity. Records for which `counts` is false neither count nor change."""
    takes = F.coalesce(counts, F.lit(False)) if counts is not None else F.lit(True)
    n = F.sum(F.when(takes, 1).otherwise(0)).over(Window.partitionBy(*scope, name))
    return records.withColumn(name, F.when(takes & (n > 1), F.concat_ws("/", F.col(name), arity.cast("string"))).otherwise(F.col(name)))


def report_groups(findings: DataFrame, place: list[str]) -> DataFrame:
    """One row for each place: its greatest severity and its findings, the most severe first, then by kind."""
    each = F.collect_list(F.struct((-F.col("severity")).alias("o"), "kind", "metric", "threshold"))
    groups = findings.groupBy(*place).agg(F.max("severity").alias("severity"), F.count("*").alias("n_findings"), F.array_sort(each).alias("f"))
    return groups.withColumn("kinds", F.transform("f", lambda x: x["kind"])).drop("f")


def summary(records: DataFrame, findings: DataFrame, excluded: Column, kinds: list[str]) -> DataFrame:
    """One row: eligible and excluded records, and findings of each kind."""
    totals = records.agg(F.count_if(~excluded).alias("eligible"), F.count_if(excluded).alias("excluded"))
    counts = findings.agg(*[F.count_if(F.col("kind") == k).alias("n_" + k.replace("-", "_")) for k in kinds])
    return totals.crossJoin(counts)  # one row each


def all_hold(rows: DataFrame, group: list[str], test: Column) -> DataFrame:
    """Groups of which every row passes."""
    return rows.groupBy(*group).agg(F.bool_and(test).alias("__all"), F.count("*").alias("n_rows")).filter("__all").drop("__all")


def fan_out(uses: DataFrame, owner: str, other: str) -> DataFrame:
    """How many distinct others each owner refers to, itself left out."""
    return uses.filter(F.col(owner) != F.col(other)).groupBy(owner).agg(F.countDistinct(other).alias("fan_out"))
