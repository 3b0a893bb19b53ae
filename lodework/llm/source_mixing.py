"""Mixing sources to target weights (operator 6): Efraimidis-Spirakis keys under token budgets.

DataFrame functions only. Each source gets a budget of words; whole epochs come first, and the
rest is filled in the order of exponential keys scaled by a document's quality weight. A source
may hold most of the corpus, so its rows are never sorted in one task: keys fall into KEY_BUCKETS
ranges whose sums are prefix-summed (a table bounded by sources * KEY_BUCKETS), which settles
every row but those of the one range in which the budget ends; only that range is ordered. Texts
are scanned once: sizes and keys are a written table, and all later steps read its narrow columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodework.llm.common import WORD, Scratch

KEY_BUCKETS = 1 << 12
WEIGHTS = (5, 2, 1)
TOTAL_SHARE, MOST_EPOCHS = 1.5, 2.0


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """The share of letters among a text's code points, at least 0.05: prose comes before markup and noise."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.length(text)
    return F.when(F.length(text) > 0, F.greatest(letters, F.lit(0.05))).otherwise(F.lit(0.05))


def sampling_key(key: str, text: str, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u in (0, 1) from a hash of the key, or of the text where there is no key: the smallest keys are a weighted sample without replacement."""
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    digest = F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 12)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def budgets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with the weight and target of each source.

    Sources in code-point order, null last, take the weights in turn. A target is the least of
    most * source_size and weight * level, with the one level at which the targets add up to
    share * all sizes: with sources in the order of the level that fills them, it is what is
    left after the filled ones, over the weights of the others. One row a source is sorted here.
    """
    everything = Window.partitionBy(F.lit(1))
    in_order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")
    w = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    w = w.withColumn("goal", share * F.sum("source_size").over(everything))
    rising = Window.partitionBy(F.lit(1)).orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled, used = F.sum("cap").over(rising) - F.col("cap"), F.sum("weight").over(rising) - F.col("weight")
    w = w.withColumn("level", (F.col("goal") - filled) / (F.sum("weight").over(everything) - used))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"])
    return w.withColumn("target", F.least("cap", F.col("weight") * F.col("level"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", weight=quality_weight, with_text: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes, repeats counted).

    Each source's taken words add up to its target, rounded: the document in which the budget ends
    is taken in part. Null texts have size 0; null sources are one source, the last. Repeated
    rows count as often as they occur; rows with equal keys are ordered by the key column and size.
    Rows without a key draw by their text. Reruns agree, however the rows are partitioned. A column that has the
    name of a result is replaced, other columns stay; without with_text the text goes. Texts are read once:
    sizes and keys are written, with what is returned. An empty table gives an empty result.
    """
    taken_names = {"size", "source_size", "target", "taken", "__key", "__bucket", "__s"}
    docs = docs.drop(*(taken_names & set(docs.columns)))
    sized = docs.withColumn("size", word_count(text)).withColumn("__key", sampling_key(key, text, weight(text), seed)).withColumn("__s", F.col(source))
    sized = sized.withColumn("__bucket", F.least(F.lit(KEY_BUCKETS - 1), F.floor(KEY_BUCKETS * (1 - F.exp(-F.col("__key"))))).cast("int"))
    if not with_text:
        docs, sized = docs.drop(text), sized.drop(text)
    sized = scratch.save(sized, "sized")
    sums = scratch.save(sized.groupBy(F.col("__s").alias("source"), F.col("__bucket").alias("bucket")).agg(F.sum("size").alias("words")), "sums")
    targets = budgets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("words").over(by_source)).alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("t.*", "bucket", "words", "upto")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ends = ends.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # One row a source: the range in which its budget ends, and the words before that range.
    ends = ends.groupBy("source", "source_size", "target", "epochs", "rest").agg(F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("end"))
    ends = ends.select(F.col("source").alias("__source"), "source_size", "target", F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"), F.col("end.bucket").alias("__end"), F.col("end.before").alias("__before"))
    ends = scratch.save(ends, "ends")
    joined = sized.join(ends, F.col("__s").eqNullSafe(F.col("__source")))
    at_end = F.coalesce(F.col("__bucket") == F.col("__end"), F.lit(False))
    outside = joined.filter(~at_end).withColumn("__part", F.when(F.coalesce(F.col("__bucket") < F.col("__end"), F.lit(True)), F.col("size")).otherwise(0))
    order = Window.partitionBy("__s").orderBy("__key", key, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = joined.filter(at_end).withColumn("__upto", F.sum("size").over(order) + F.col("__before"))
    inside = inside.withColumn("__part", F.round(F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), F.col("__rest") - (F.col("__upto") - F.col("size")))))).drop("__upto")
    both = outside.withColumn("__part", F.col("__part").cast("long")).unionByName(inside.withColumn("__part", F.col("__part").cast("long")))
    both = both.withColumn("taken", F.col("__epochs") * F.col("size") + F.col("__part"))
    return both.select(*docs.columns, "size", "source_size", "target", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, Scratch(spark, "mix"), with_text=False).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each whole copy, and the one that a budget ends in cut after its last word that is taken."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__row"))  # whatever the other columns are called
    mixed = mix(packed, Scratch(spark, "mix-stage")).withColumn("__whole", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int"))
    mixed = mixed.withColumn("__cut", F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int"))
    whole = mixed.filter("__whole > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__whole"))))
    cut = mixed.filter("__cut > 0").withColumn("text", F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.col("__cut")), ""), r"[\x20\x09-\x0D]+$", ""))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return whole.select("__row.*").unionByName(cut.select(*[(new[c] if c in new else F.col("__row")[c]).alias(c) for c in docs.columns]))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0)
         / CASE WHEN length(text) > 0 THEN greatest(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / length(text), 0.05) ELSE 0.05 END AS k
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)) AS weight FROM totals),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS goal FROM weighed),
levels AS (
  SELECT *, (goal - (sum(cap) OVER w - cap)) / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS level
  FROM capped WINDOW w AS (ORDER BY full_at, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at)) AS target FROM levels),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + round(greatest(0.0, least(CAST(size AS DOUBLE), rest - before))) AS BIGINT) AS taken
FROM running
"""
