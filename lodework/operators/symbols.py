"""Symbol tables: declarations merged by key, ids in first-seen order, and candidate name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.functions.tables import Scratch


def merged(rows: DataFrame, keys: list[str], order: list[str], first: list[str] = (), bits: list[str] = (), flags: list[str] = (), unions: list[str] = ()) -> DataFrame:
    """One row a key: `first` from the earliest row by `order`, `bits` or-ed, `flags` any, `unions` (arrays) joined without repeats.

    All aggregates combine before the shuffle.
    """
    o = F.struct(*order)
    aggs = [F.min_by(F.struct(*first), o).alias("__first")] if first else []
    aggs += [F.bit_or(c).alias(c) for c in bits] + [F.bool_or(c).alias(c) for c in flags]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions]
    aggs += [F.min(o).alias("first_seen"), F.count("*").alias("n_parts")]
    out = rows.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in first], *bits, *flags, *unions, "first_seen", "n_parts")


def dense_ids(symbols: DataFrame, scratch: Scratch, order: str = "first_seen", name: str = "symbol_id") -> DataFrame:
    """Ids 0, 1, ... in first-seen order, counted over ranges of it so that no task sorts all rows. The ranges are written, so both uses see the same."""
    parts = scratch.save(symbols.repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    local = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    return local.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__i") - 1).drop("__p", "__before", "__i")  # one row a partition


def by_full_name(refs: DataFrame, scopes: Column, path: str, types: DataFrame, fqn: str, id_: str, keep: list[str]) -> DataFrame:
    """(keep, id) for every type that scope.path names in full, for each scope ('' is none): one equi-join, the union of all hits."""
    cand = refs.withColumn("__p", F.explode(F.array_distinct(scopes))).withColumn("__c", F.when(F.col("__p") == "", F.col(path)).otherwise(F.concat_ws(".", "__p", path)))
    return cand.join(types.select(F.col(fqn).alias("__c"), F.col(id_).alias("__id")).distinct(), "__c").select(*keep, F.col("__id").alias(id_)).distinct()


def by_segment(refs: DataFrame, path: str, types: DataFrame, simple: str, id_: str, keep: list[str]) -> DataFrame:
    """(keep, id) for every type whose simple name is a segment of the path: what a reference that names nothing in full may mean."""
    found = types.select(F.col(simple).alias("__s"), F.col(id_).alias("__id")).distinct()
    return refs.withColumn("__s", F.explode(F.array_distinct(F.split(path, "\\.")))).join(found, "__s").select(*keep, F.col("__id").alias(id_)).distinct()


def unresolved(refs: DataFrame, hits: DataFrame, key: str, use_fallback: Column | None = None) -> DataFrame:
    """References without any hit, and those marked for the fallback whatever was found."""
    missing = refs.join(hits.select(key).distinct(), key, "left_anti")
    return missing if use_fallback is None else missing.unionByName(refs.filter(use_fallback).select(*missing.columns)).distinct()


def resolved(refs: DataFrame, prefixes: Column, path: str, types: DataFrame, fqn: str, simple: str, id_: str, use_fallback: Column | None = None) -> DataFrame:
    """(ref columns, id, how) for every type that a reference can mean: all full names that a prefix gives, else types by simple name for every segment of the path."""
    key = F.xxhash64(*refs.columns, F.concat_ws("\1", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in refs.columns]))
    r = refs.withColumn("__k", key)
    hits = by_full_name(r, prefixes, path, types, fqn, id_, ["__k", *refs.columns])
    loose = by_segment(unresolved(r, hits, "__k", use_fallback), path, types, simple, id_, refs.columns)
    return hits.drop("__k").withColumn("how", F.lit("name")).unionByName(loose.withColumn("how", F.lit("segment")))
