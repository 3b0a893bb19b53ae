"""Duplicates: maximal repeated token runs, cut to whole lines, ranked by impact and thinned by cover."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.functions.scalars import any_glob
from lodework.functions.tables import Scratch
from lodework.lang.extract import file_tokens
from lodework.operators import repeats


@dataclass
class Options:
    mode: str = "exact"
    min_tokens: int = 50
    min_lines: int = 5
    min_occurrences: int = 2
    ignore: tuple[str, ...] = ()


@dataclass
class Dupes:
    groups: DataFrame
    counts: dict[str, int]


def duplicates(files: DataFrame, scratch: Scratch, options: Options = Options(), root: str = "") -> Dupes:
    """groups: token_count, line_count, impact, occurrences [(file, start_line, start_column, end_line, end_column)], in rank order.

    files: file_id, path, is_generated (by path), content. Generated and ignored files are left out before
    anything is read.
    """
    rel = F.expr(f"substr(path, {len(root) + 2})") if root else F.col("path")
    kept = files.filter(~F.col("is_generated")).filter(~any_glob(rel, list(options.ignore)))
    t = file_tokens(kept).withColumn("key", repeats.token_key(F.col("kind"), F.col("token"), options.mode))
    t = scratch.save(t, "tokens")
    keyed = t.select("file_id", "pos", F.col("key").alias("token"))
    sequences = scratch.save(repeats.token_sequences(keyed, "file_id"), "sequences")
    found = repeats.maximal_repeats(sequences, "file_id", options.min_tokens, scratch, options.min_occurrences)
    found = scratch.save(found.withColumn("group", F.xxhash64("length", F.col("occurrences").cast("string"))), "repeats")
    lines = scratch.save(repeats.token_lines(t, "file_id"), "lines")
    cut = repeats.snapped(found, lines, "file_id", options.min_tokens, options.min_lines)
    best = repeats.uncovered(repeats.ranked(cut.filter(F.size("occurrences") >= options.min_occurrences)), scratch)
    o = best.select("group", "n_tokens", "n_lines", "impact", F.explode("occurrences").alias("o")).select("group", "n_tokens", "n_lines", "impact", F.col("o.id").alias("file_id"), F.col("o.pos").alias("pos"))
    first = t.select("file_id", "pos", F.col("line").alias("start_line"), F.col("col").alias("start_column"))
    last = t.select("file_id", F.col("pos").alias("last"), "end_line", F.col("end_col").alias("end_column"))
    o = o.withColumn("last", F.col("pos") + F.col("n_tokens") - 1).join(first, ["file_id", "pos"]).join(last, ["file_id", "last"]).join(kept.select("file_id", F.col("path").alias("file")), "file_id")
    each = F.struct("file_id", "pos", "file", "start_line", "start_column", "end_line", "end_column")
    groups = o.groupBy("group", "n_tokens", "n_lines", "impact").agg(F.array_sort(F.collect_list(each)).alias("occurrences"))
    order = F.transform("occurrences", lambda x: F.struct(x["file_id"], x["pos"]))
    groups = scratch.save(groups.withColumn("__order", order), "groups")
    row = groups.agg(F.count("*").alias("g"), F.coalesce(F.sum(F.col("n_lines") * F.size("occurrences")), F.lit(0)).alias("l")).first()
    out = groups.orderBy(F.desc("impact"), F.desc("n_tokens"), "__order").select(F.col("n_tokens").alias("token_count"), F.col("n_lines").alias("line_count"), "impact", "occurrences")
    return Dupes(out, {"groups": row["g"], "duplicated_lines": row["l"], "files": kept.count()})
