"""Shared plumbing of the training-data operators: Arrow helpers, samples, and the core's written tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.functions.arrow import raw as raw
from lodework.functions.arrow import slices as slices
from lodework.functions.tables import Scratch as Scratch

#: Words are runs of anything but these six ASCII bytes.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_columns(docs: DataFrame, text: str, kinds: dict[str, pa.DataType], begin) -> DataFrame:
    """The rows of docs, without `text`, with new columns computed from whole texts.

    begin() runs once in each task and returns a function from a list of texts (null: empty)
    to one list for each new column. A column of docs that has the name of a new one is replaced.
    """
    keep = [c for c in docs.columns if c != text and c not in kinds]
    sql = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made = [pa.array(x, k) for x, k in zip(work(texts), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + made, names=[*keep, *kinds])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{c}` {sql[k]}" for c, k in kinds.items()])
    return docs.select(*keep, text).mapInArrow(run, schema)


def chosen(rows: DataFrame, group: str, key: str, most: int, seed: str, most_groups: int = 100) -> tuple[DataFrame, dict]:
    """Rows whose key's hash is small enough that about 1.2 * `most` of each group are left (all of a small one), with that hash as __u; and the count of rows of each group.

    Counting reads nothing but the group. Of more than most_groups groups the most frequent are
    looked at, equal ones by name: this bounds what is fitted, not what is scored. The same rows are chosen on
    every run, however they are partitioned.
    """
    counted = rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).groupBy(group).agg(F.count("*").alias("__n"))
    counted = counted.orderBy(F.desc("__n"), group).limit(most_groups)
    counts = {r[0]: r[1] for r in counted.collect()}
    u = F.xxhash64(F.col(key).cast("string"), F.lit(seed)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    shares = counted.sparkSession.createDataFrame([(g, min(1.0, (1.2 * most + 20) / n)) for g, n in counts.items()], counted.select(group).schema.add("__share", "double"))
    return rows.join(F.broadcast(shares), group).withColumn("__u", u).filter("__u < __share").drop("__share"), counts


def bounded_sample(rows: DataFrame, group: str, key: str, text: str, most: int, most_bytes: int, scratch: Scratch) -> dict:
    """(key, text) lists by group of rows that chosen() has left: at most `most` keys a group in the order of __u, and at most most_bytes of texts a group.

    Repeated rows of a key are one before anything reaches the driver, and texts are gathered only after
    their lengths have been added up.
    """
    one = rows.filter(F.col(text).isNotNull()).groupBy(group, key).agg(F.min("__u").alias("u"), F.min(text).alias("text"))
    one = scratch.save(one, "sample")
    taken, seen, used = [], Counter(), Counter()
    sizes = one.select(group, key, "u", F.octet_length("text").alias("n")).collect()  # numbers of about 1.2 * most rows a group
    for r in sorted(sizes, key=lambda r: (r["u"], str(r[key]))):
        if seen[r[group]] < most and used[r[group]] + r["n"] <= most_bytes:
            seen[r[group]] += 1
            used[r[group]] += r["n"]
            taken.append((r[group], r[key]))
    out: dict = {}
    if taken:
        wanted = one.sparkSession.createDataFrame(taken, one.select(group, key).schema)
        for r in sorted(one.join(F.broadcast(wanted), [group, key]).collect(), key=lambda r: (r["u"], str(r[key]))):
            out.setdefault(r[group], []).append((r[key], r["text"]))
    scratch.drop("sample")
    return out
