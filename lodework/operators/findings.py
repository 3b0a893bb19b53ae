"""Filters on findings: inline markers, globs and recorded baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.functions.scalars import any_glob

#: Kinds whose markers count anywhere in the file.
FILE_WIDE = ("unused-file", "large-file")


def markers(lines: DataFrame, word: str = "lodework", rules: list[str] | None = None) -> DataFrame:
    """(file, line, rule): what `// word:off [rules]` switches off on its line and `// word:off-next [rules]` on the next; rule is null for all.

    Only the text right after the first // of a line is a marker. A comma list ends at white space; no
    list means every rule, and a list of unknown rules alone none.
    """
    after = F.expr("substr(content, nullif(instr(content, '//'), 0))")
    m = lines.withColumn("__c", after).filter(F.col("__c").isNotNull())
    form = F.regexp_extract("__c", rf"^//\s*{word}:(off-next|off)(?![\w-])", 1)
    names = F.regexp_extract("__c", rf"^//\s*{word}:(?:off-next|off)(?![\w-])[ \t]*(\S*)", 1)
    m = m.withColumn("form", form).filter("form <> ''").withColumn("names", names)
    listed = F.filter(F.split("names", ","), lambda x: x != "")
    m = m.withColumn("rule", F.explode_outer(F.when(F.col("names") == "", F.array(F.lit(None).cast("string"))).otherwise(listed)))
    if rules is not None:
        m = m.filter((F.col("names") == "") | F.col("rule").isin(rules))
    return m.select("file", (F.col("line") + F.when(F.col("form") == "off-next", 1).otherwise(0)).alias("line"), "rule").distinct()


def unknown_rules(lines: DataFrame, rules: list[str], word: str = "lodework") -> DataFrame:
    """(file, line, rule) of markers that name a rule there is none of."""
    return markers(lines, word).filter(F.col("rule").isNotNull() & ~F.col("rule").isin(rules))


def unmarked(findings: DataFrame, marks: DataFrame, file_wide: tuple[str, ...] = FILE_WIDE) -> DataFrame:
    """Findings (file, line, kind) that no mark (file, line, rule) switches off: two anti-joins, the marks of file-wide kinds match by file."""
    m = marks.select(F.col("file").alias("__f"), F.col("line").alias("__l"), F.col("rule").alias("__r"))
    rule = F.col("__r").isNull() | (F.col("__r") == F.col("kind"))
    here = findings.filter(~F.col("kind").isin(*file_wide)).join(m, (F.col("file") == F.col("__f")) & (F.col("line") == F.col("__l")) & rule, "left_anti")
    wide = findings.filter(F.col("kind").isin(*file_wide)).join(m, (F.col("file") == F.col("__f")) & rule, "left_anti")
    return here.unionByName(wide)


def not_ignored(findings: DataFrame, path: str, globs: list[str]) -> DataFrame:
    return findings.filter(~any_glob(F.col(path), globs))


def cycles_not_ignored(cycles: DataFrame, members: Column, globs: list[str]) -> DataFrame:
    """Cycles of which no member lies in an ignored file."""
    return cycles.filter(~F.exists(members, lambda m: any_glob(m, globs)))


def baseline_of(findings: DataFrame, keys: tuple[str, ...] = ("kind", "name")) -> DataFrame:
    """The greatest metric of each key: what is accepted from now on."""
    return findings.groupBy(*keys).agg(F.max("metric").alias("metric"))


def over_baseline(findings: DataFrame, recorded: DataFrame, keys: tuple[str, ...] = ("kind", "name")) -> DataFrame:
    """Findings that are not recorded, or whose metric is over every record of their key."""
    ceiling = recorded.groupBy(*keys).agg(F.max("metric").alias("__ceiling"))
    return findings.join(ceiling, list(keys), "left").filter(F.col("__ceiling").isNull() | (F.col("metric") > F.col("__ceiling"))).drop("__ceiling")


def stale_records(recorded: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("kind", "name")) -> DataFrame:
    """Recorded keys that no finding has; one that got worse isn't stale."""
    return recorded.join(findings.select(*keys).distinct(), list(keys), "left_anti")


def cycle_key(members: Column) -> Column:
    return F.array_join(F.array_sort(members), "\n")


def as_json(findings: DataFrame, fields: list[Column]) -> DataFrame:
    """One JSON document a row; nulls are left out."""
    return findings.select(F.to_json(F.struct(*fields)).alias("json"))
