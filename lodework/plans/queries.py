"""Queries on the driver's tables, one or more for each operator, and their SQL.

The tables stand in for source trees: documents for files, parts for names, order lines for references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.functions import scalars
from lodework.functions.tables import Scratch, read
from lodework.operators import checks, churn, findings, graph, repeats, symbols

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


WORDS = r"[^\x20\x09-\x0D]+"
LIMITS = {"many-words": 400, "many-lines": 15, "long-word": 18, "many-chars": 3000}
METRICS_SQL = r"""m AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
         CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS lines,
         CAST(coalesce(list_max(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: length(w))), 0) AS BIGINT) AS longest,
         n_chars AS chars FROM documents),
f AS (
  SELECT doc_id, source, kind, metric, threshold, CASE WHEN threshold = 0 THEN CAST(metric AS DOUBLE) ELSE metric / threshold END AS severity FROM (
    SELECT doc_id, source, 'many-words' AS kind, words AS metric, CAST(400 AS BIGINT) AS threshold FROM m UNION ALL
    SELECT doc_id, source, 'many-lines', lines, 15 FROM m UNION ALL
    SELECT doc_id, source, 'long-word', longest, 18 FROM m UNION ALL
    SELECT doc_id, source, 'many-chars', chars, 3000 FROM m) WHERE metric > threshold)
"""


def _tripped(spark: SparkSession, d: str, *more: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("__w", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0)))
    longest = F.coalesce(F.array_max(F.transform("__w", F.length)), F.lit(0))
    metrics = {"many-words": F.size("__w"), "many-lines": scalars.line_count(F.coalesce("text", F.lit(""))), "long-word": longest, "many-chars": F.col("n_chars")}
    return checks.tripped(docs, ["doc_id", "source", *more], {k: (metrics[k], v) for k, v in LIMITS.items()})


@query("q01_large_record", "SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS metric, len(string_split(coalesce(text, ''), chr(10))) / 10 AS severity FROM documents WHERE len(string_split(coalesce(text, ''), chr(10))) > 10")
def q01(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return checks.tripped(docs, ["doc_id"], {"large-file": (scalars.line_count(F.col("text")), 10)}).select("doc_id", "metric", "severity")


@query("q02_metric_unpivot", f"WITH {METRICS_SQL} SELECT * FROM f")
def q02(spark, d):
    return _tripped(spark, d)


@query(
    "q03_breakdown",
    "SELECT * FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus IN ('O', 'F')) AS total FROM orders GROUP BY o_custkey) WHERE total > 8",
)
def q03(spark, d):
    return checks.breakdown(read(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus"), ["O", "F"], 8)


MERGE_SQL = """merged AS (
  SELECT user_id, event_type, min(event_id) AS first_event, arg_min(CAST(floor(epoch(ts)) AS BIGINT), event_id) AS first_ts, bool_or(value > 50) AS any_large, count(*) AS n_parts
  FROM events GROUP BY user_id, event_type)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", churn.epoch_seconds("ts").cast("long").alias("first_ts"), (F.col("value") > 50).alias("any_large"))
    return symbols.merged(e, ["user_id", "event_type"], ["event_id"], first=["first_ts"], flags=["any_large"])


@query("q04_merge", f"WITH {MERGE_SQL} SELECT * FROM merged")
def q04(spark, d):
    return _merged(spark, d).withColumn("first_event", F.col("first_seen.event_id")).drop("first_seen")


@query("q05_dense_ids", f"WITH {MERGE_SQL} SELECT user_id, event_type, row_number() OVER (ORDER BY first_event) - 1 AS symbol_id FROM merged")
def q05(spark, d):
    return symbols.dense_ids(_merged(spark, d), Scratch(spark, "dense")).select("user_id", "event_type", F.col("symbol_id").cast("long").alias("symbol_id"))


@query(
    "q06_resolve",
    """WITH types AS (SELECT r_name || '.' || n_name AS fqn, n_name, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey),
refs AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN r_name || '.' || n_name ELSE n_name END AS path, CASE WHEN c_custkey % 3 = 0 THEN ['', r_name] WHEN c_custkey % 3 = 1 THEN ['', 'ASIA'] ELSE [''] END AS prefixes FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
cand AS (SELECT c_custkey, path, CASE WHEN p = '' THEN path ELSE p || '.' || path END AS c FROM (SELECT c_custkey, path, unnest(prefixes) AS p FROM refs)),
hits AS (SELECT DISTINCT c_custkey, path, n_nationkey, 'name' AS how FROM cand JOIN types ON c = fqn)
SELECT * FROM hits UNION ALL
SELECT DISTINCT c_custkey, path, n_nationkey, 'segment' FROM (SELECT c_custkey, path, unnest(string_split(path, '.')) AS s FROM refs WHERE c_custkey NOT IN (SELECT c_custkey FROM hits)) JOIN types ON s = n_name""",
)
def q06(spark, d):
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    full = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.concat_ws(".", "r_name", "n_name").alias("fqn"))
    c = read(spark, d, "customer").join(full, F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.when(F.col("c_custkey") % 5 == 0, F.col("fqn")).otherwise(F.col("n_name"))
    prefixes = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(""), F.col("r_name"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit(""), F.lit("ASIA"))).otherwise(F.array(F.lit("")))
    refs = c.select("c_custkey", path.alias("path"), prefixes.alias("prefixes"))
    out = symbols.resolved(refs, F.col("prefixes"), "path", full.select("n_nationkey", "n_name", "fqn"), "fqn", "n_name", "n_nationkey")
    return out.drop("prefixes")


@query("q07_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01')")
def q07(spark, d):
    used = read(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1996-07-01'").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query(
    "q08_closure",
    "WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn - 1 AS dst FROM conversations WHERE turn > (SELECT min(turn) FROM conversations)), c AS (SELECT * FROM e WHERE dst IN (SELECT conv_id * 1000 + turn FROM conversations) UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src WHERE e.dst IN (SELECT conv_id * 1000 + turn FROM conversations)) SELECT * FROM c",
)
def q08(spark, d):
    ids = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("src")).distinct()
    edges = ids.withColumn("dst", F.col("src") - 1).join(ids.select(F.col("src").alias("dst")), "dst", "left_semi")
    return graph.closure(edges, Scratch(spark, "closure"))


TRADE_SQL = """trade AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS cents
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
big AS (SELECT src, dst FROM trade WHERE cents > (SELECT quantile_disc(cents, 0.9) FROM trade) AND src <> dst)"""


def _trade(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("cents"))
    order, supplier = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    customer = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    sold = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    sums = sold.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum("cents").alias("cents"))
    limit = sums.agg(F.expr("percentile_disc(0.9) within group (order by cents)").alias("__limit"))
    return sums.crossJoin(F.broadcast(limit)).filter("cents > __limit and src <> dst").select("src", "dst")  # one row


@query("q09_reach", f"WITH RECURSIVE {TRADE_SQL}, r AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 0 UNION SELECT dst FROM r JOIN big ON src = id) SELECT * FROM r")
def q09(spark, d):
    return graph.reach(_trade(spark, d), read(spark, d, "nation").filter("n_regionkey = 0").select("n_nationkey"), Scratch(spark, "reach"))


@query(
    "q10_gated_reach",
    """WITH RECURSIVE line AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem),
step AS (SELECT a.l_suppkey || ':' || a.l_partkey AS src, CAST(b.l_partkey AS VARCHAR) AS name, CAST(b.l_suppkey AS VARCHAR) AS dst, b.l_quantity AS q FROM line a JOIN line b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
members AS (SELECT DISTINCT l_suppkey || ':' || l_partkey AS id, CAST(l_suppkey AS VARCHAR) AS parent, CAST(l_partkey AS VARCHAR) AS name FROM line),
uses AS (SELECT DISTINCT src, name FROM step UNION SELECT DISTINCT '1', CAST(l_partkey AS VARCHAR) FROM line WHERE l_suppkey = 1),
edges AS (SELECT DISTINCT src, dst FROM step WHERE q > 49 UNION SELECT id, parent FROM members),
live(id, k) USING KEY (id) AS (
  SELECT '1', 0
  UNION
  SELECT DISTINCT id, k FROM (
  SELECT e.dst AS id, 0 AS k FROM live JOIN edges e ON e.src = live.id WHERE e.dst NOT IN (SELECT id FROM recurring.live)
  UNION ALL
  SELECT m.id, 0 FROM live JOIN uses u ON u.src = live.id JOIN members m ON m.name = u.name JOIN recurring.live p ON p.id = m.parent WHERE m.id NOT IN (SELECT id FROM recurring.live)
  UNION ALL
  SELECT m.id, 0 FROM live JOIN members m ON m.parent = live.id JOIN uses u ON u.name = m.name JOIN recurring.live p ON p.id = u.src WHERE m.id NOT IN (SELECT id FROM recurring.live)))
SELECT id FROM live""",
)
def q10(spark, d):
    """Containers are suppliers, members (supplier, part) with the part as name. A live member uses the part of the next line of its order; a large quantity leads to that line's supplier."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    nxt = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"))
    step = line.join(nxt, ["l_orderkey", "l_linenumber"])
    member = F.concat_ws(":", "l_suppkey", "l_partkey")
    members = line.select(member.alias("id"), F.col("l_suppkey").cast("string").alias("parent"), F.col("l_partkey").cast("string").alias("name")).distinct()
    members = members.withColumn("is_member", F.lit(True)).withColumn("ungated", F.lit(False)).withColumn("root", F.lit(False))
    owners = line.select(F.col("l_suppkey").cast("string").alias("id")).distinct().withColumns({"parent": F.lit(None).cast("string"), "name": F.lit(None).cast("string"), "is_member": F.lit(False), "ungated": F.lit(False), "root": F.col("id") == "1"})
    first = line.filter("l_suppkey = 1").select(F.lit("1").alias("src"), F.col("l_partkey").cast("string").alias("name"))
    uses = step.select(member.alias("src"), F.col("p").cast("string").alias("name")).unionByName(first)
    edges = step.filter("q > 49").select(member.alias("src"), F.col("s").cast("string").alias("dst"))
    none = members.select(F.col("parent"), F.col("id").alias("child")).limit(0)
    return graph.gated_reach(owners.unionByName(members), edges, uses, none, Scratch(spark, "gated"))


@query("q11_forall", "SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag = 'R')")
def q11(spark, d):
    return checks.all_hold(read(spark, d, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R")


@query("q12_fanout", f"WITH {TRADE_SQL} SELECT src, count(DISTINCT dst) AS fan_out FROM big GROUP BY src")
def q12(spark, d):
    return checks.fan_out(_trade(spark, d), "src", "dst")


CHAIN_SQL = "e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_linestatus = b.l_linestatus AND a.l_partkey <> b.l_partkey)"


def _chain(spark: SparkSession, d: str, returned: bool = True) -> DataFrame:
    """Edges from the part of a line to the part of the next line of its order: of all lines, or between returned ones of one status, which are components of many sizes."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(("l_linestatus", "l_returnflag") if returned else ()))
    if returned:
        line = line.filter("l_returnflag = 'R'").drop("l_returnflag")
    keys = ["l_orderkey", "l_linenumber", *(("l_linestatus",) if returned else ())]
    nxt = line.withColumn("l_linenumber", F.col("l_linenumber") - 1).withColumnRenamed("l_partkey", "dst")
    return line.withColumnRenamed("l_partkey", "src").join(nxt, keys).filter("src <> dst").select("src", "dst").distinct()


SCC_SQL = f"{CHAIN_SQL}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), scc AS (SELECT a.src AS id, least(min(a.dst), a.src) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)"


@query("q13_scc", f"WITH RECURSIVE {SCC_SQL} SELECT * FROM scc")
def q13(spark, d):
    return graph.strong_components(_chain(spark, d), Scratch(spark, "scc"))


@query(
    "q14_cycle",
    f"""WITH RECURSIVE {SCC_SQL}, p AS (
  SELECT component, component AS at, [component] AS path FROM scc WHERE id = component
  UNION ALL SELECT p.component, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.at JOIN scc ON scc.id = e.dst AND scc.component = p.component WHERE NOT list_contains(p.path, e.dst)),
closed AS (SELECT p.component, path FROM p JOIN e ON e.src = p.at AND e.dst = p.component WHERE len(path) > 1),
best AS (SELECT component, arg_min(path, (len(path), path)) AS path FROM closed GROUP BY component)
SELECT b.component, array_to_string(b.path, ',') AS path, coalesce(string_agg(CAST(scc.id AS VARCHAR), ',' ORDER BY scc.id) FILTER (NOT list_contains(b.path, scc.id)), '') AS others FROM best b JOIN scc USING (component) GROUP BY ALL""",
)
def q14(spark, d):
    s = Scratch(spark, "cycles")
    return _cycles(s.save(_chain(spark, d)), s)


@query("q38_scc_whole")
def q38(spark, d):
    """q13 on all next-line edges."""
    return graph.strong_components(_chain(spark, d, False), Scratch(spark, "scc-whole"))


@query("q39_cycle_whole")
def q39(spark, d):
    """q14 on all next-line edges."""
    s = Scratch(spark, "cycles-whole")
    return _cycles(s.save(_chain(spark, d, False)), s)


def _cycles(edges: DataFrame, s: Scratch) -> DataFrame:
    out = graph.shortest_cycles(edges, graph.strong_components(edges, s), s)
    return out.select("component", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


TOKENS_SQL = r"""lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
raw AS (SELECT doc_id, line, generate_subscripts(ws, 1) AS i, unnest(ws) AS token FROM (SELECT doc_id, line, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws FROM lines)),
tokens AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, i) - 1 AS pos, line, token FROM raw)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return repeats.text_tokens(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("q15_tokens", f"WITH {TOKENS_SQL} SELECT * FROM tokens")
def q15(spark, d):
    return _tokens(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("line").cast("long").alias("line"), "token")


@query("q16_semantic_key", f"WITH {TOKENS_SQL} SELECT CASE WHEN regexp_full_match(token, '[0-9]+') THEN 'integer_literal' ELSE 'word|' || token END AS key, count(*) AS n FROM tokens GROUP BY 1")
def q16(spark, d):
    kind = F.when(F.col("token").rlike("^[0-9]+$"), F.lit("integer_literal")).otherwise(F.lit("word"))
    key = F.replace(repeats.token_key(kind, F.col("token"), "semantic"), F.lit("\0"), F.lit("|"))
    return _tokens(spark, d).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("q17_exact_copies", r"SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY regexp_replace(lower(trim(text)), '[ \t\r\n]+', ' ', 'g') HAVING count(*) > 1")
def q17(spark, d):
    norm = F.regexp_replace(F.lower(F.trim("text")), r"[ \t\r\n]+", " ")
    return read(spark, d, "documents").filter("text is not null").groupBy(F.sha2(norm, 256).alias("k")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1").drop("k")


GRAMS_SQL = f"""{TOKENS_SQL}, per AS (SELECT doc_id, list(token ORDER BY pos) AS ws FROM tokens GROUP BY doc_id),
grams AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(ws[i : i + 49], ' ')) AS g, CASE WHEN i = 1 THEN 'start:' || doc_id ELSE 't:' || ws[i - 1] END AS l FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM per WHERE len(ws) >= 50)),
groups AS (SELECT g, count(*) AS n_occurrences, count(DISTINCT l) > 1 AS left_maximal, min((doc_id, pos)) AS first FROM grams GROUP BY g HAVING count(*) >= 2)"""


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return repeats.text_sequences(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return repeats.text_lines(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("q18_kgram_groups", f"WITH {GRAMS_SQL} SELECT grams.doc_id, grams.pos, n_occurrences FROM grams JOIN groups USING (g)")
def q18(spark, d):
    grams = repeats.kgrams(_sequences(spark, d), "doc_id", 50)  # hashed twice, which costs less than to write and read them
    return grams.join(repeats.repeated_kgrams(grams), "gram").select("doc_id", F.col("pos").cast("long").alias("pos"), "n_occurrences")


@query("q19_left_maximal", f"WITH {GRAMS_SQL} SELECT grams.doc_id, grams.pos, n_occurrences FROM grams JOIN groups USING (g) WHERE left_maximal")
def q19(spark, d):
    grams = repeats.kgrams(_sequences(spark, d), "doc_id", 50)
    return grams.join(repeats.repeated_kgrams(grams).filter("left_maximal"), "gram").select("doc_id", F.col("pos").cast("long").alias("pos"), "n_occurrences")


def _occurrence_text(o):
    return F.array_join(F.transform(o, lambda x: F.concat_ws(":", x["id"].cast("string"), x["pos"].cast("string"))), ",")


@query(
    "q20_maximal_repeats",
    # Sorted, the texts from a 50-gram on that share a beginning lie side by side: repeats are the intervals between drops of the shared length.
    f"""WITH {GRAMS_SQL},
occ AS (SELECT grams.g, grams.doc_id, grams.pos, grams.l, array_to_string(per.ws[grams.pos + 1 :], ' ') || ' ' AS s FROM grams JOIN groups USING (g) JOIN per USING (doc_id) WHERE left_maximal),
sorted AS (SELECT *, row_number() OVER w AS i, lag(s) OVER w AS before, l IS DISTINCT FROM lag(l) OVER w AS turn FROM occ WINDOW w AS (PARTITION BY g ORDER BY s, doc_id, pos)),
near AS (SELECT g, i, doc_id, pos, l, CASE WHEN i > 1 THEN coalesce(list_position(list_transform(list_zip(string_split(rtrim(s, ' '), ' '), string_split(rtrim(before, ' '), ' ')), lambda x: x[1] IS DISTINCT FROM x[2]), TRUE) - 1, len(string_split(rtrim(s, ' '), ' '))) ELSE 0 END AS shared FROM sorted),
cuts AS (SELECT DISTINCT a.g, a.i, a.shared AS length FROM near a WHERE a.i > 1),
bounds AS (SELECT c.g, c.length, max(b.i) FILTER (b.i <= c.i AND b.shared < c.length) AS lo, coalesce(min(b.i) FILTER (b.i > c.i AND b.shared < c.length), max(b.i) + 1) AS hi FROM cuts c JOIN near b USING (g) GROUP BY c.g, c.i, c.length),
spans AS (SELECT DISTINCT g, length, lo, hi FROM bounds),
members AS (SELECT s.g, s.length, s.lo, n.doc_id, n.pos, n.l FROM spans s JOIN near n ON n.g = s.g AND n.i >= s.lo AND n.i < s.hi),
found AS (SELECT length, count(*) AS n, string_agg(doc_id || ':' || pos, ',' ORDER BY doc_id, pos) AS occurrences FROM members GROUP BY g, length, lo HAVING count(DISTINCT l) > 1)
SELECT CAST(length AS INTEGER) AS length, CAST(n AS INTEGER) AS n, occurrences FROM found""",
)
def q20(spark, d):
    out = repeats.maximal_repeats(_sequences(spark, d), "doc_id", 50, Scratch(spark, "repeats"))
    return out.select("length", F.size("occurrences").alias("n"), _occurrence_text("occurrences").alias("occurrences"))


def _runs_of_50(spark: SparkSession, d: str, s: Scratch) -> DataFrame:
    """The left-maximal 50-token repeats as groups."""
    grams = repeats.kgrams(_sequences(spark, d), "doc_id", 50)
    kept = repeats.repeated_kgrams(grams).filter("left_maximal").select("gram")
    groups = grams.join(kept, "gram").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("id"), "pos"))).alias("occurrences"))
    return s.save(groups.select(F.col("gram").alias("group"), F.lit(50).alias("length"), "occurrences"), "runs")


SNAP_SQL = f"""{GRAMS_SQL},
edge AS (SELECT *, line IS DISTINCT FROM lag(line) OVER w AS a, line IS DISTINCT FROM lead(line) OVER w AS b FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
occ AS (SELECT g, doc_id, pos FROM grams JOIN groups USING (g) WHERE left_maximal),
off AS (SELECT o.g, o.doc_id, o.pos AS p, t.pos - o.pos AS o, t.line, t.a, t.b FROM occ o JOIN edge t ON t.doc_id = o.doc_id AND t.pos BETWEEN o.pos AND o.pos + 49),
flags AS (SELECT g, o, bool_and(a) AS a, bool_and(b) AS b FROM off GROUP BY g, o),
cut AS (SELECT g, min(o) FILTER (a) AS lo, max(o) FILTER (b) AS hi FROM flags GROUP BY g),
span AS (SELECT off.g, doc_id, p, lo, hi, min(line) AS s, max(line) AS e FROM off JOIN cut USING (g) WHERE lo <= hi AND hi - lo + 1 >= 20 AND (o = lo OR o = hi) GROUP BY ALL),
snapped AS (SELECT g, hi - lo + 1 AS n_tokens, min(e - s + 1) AS n_lines, count(*) AS n, string_agg(doc_id || ':' || (p + lo), ',' ORDER BY doc_id, p) AS occurrences FROM span GROUP BY g, lo, hi HAVING min(e - s + 1) >= 2)"""


@query("q21_snap", f"WITH {SNAP_SQL} SELECT n_tokens, n_lines, n, occurrences FROM snapped")
def q21(spark, d):
    s = Scratch(spark, "snap")
    out = repeats.snapped(_runs_of_50(spark, d, s), _lines(spark, d), "doc_id", 20, 2)
    return out.select(F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_lines").cast("long").alias("n_lines"), F.size("occurrences").cast("long").alias("n"), _occurrence_text("occurrences").alias("occurrences"))


@query("q22_impact", f"WITH {SNAP_SQL} SELECT DISTINCT n_tokens, n, n_tokens * (n - 1) AS impact, occurrences FROM snapped ORDER BY impact DESC, n_tokens DESC, occurrences LIMIT 20")
def q22(spark, d):
    s = Scratch(spark, "impact")
    out = repeats.ranked(repeats.snapped(_runs_of_50(spark, d, s), _lines(spark, d), "doc_id", 20, 2))
    out = out.select(F.col("n_tokens").cast("long").alias("n_tokens"), F.size("occurrences").cast("long").alias("n"), "impact", _occurrence_text("occurrences").alias("occurrences")).distinct()
    return out.orderBy(F.desc("impact"), F.desc("n_tokens"), "occurrences").limit(20)  # a top-k report


@query("q23_cover")
def q23(spark, d):
    s = Scratch(spark, "cover")
    found = repeats.snapped_repeats(_sequences(spark, d), _lines(spark, d), "doc_id", 50, s, 2, 50, 1)
    kept = repeats.uncovered(repeats.ranked(found), s)
    return kept.select("n_tokens", "n_lines", "impact", _occurrence_text("occurrences").alias("occurrences"))


NOW_SQL = "now AS (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) AS n FROM events)"
DECAY_SQL = f"{NOW_SQL}, w AS (SELECT user_id, sum(pow(0.5, greatest(0, n - CAST(floor(epoch(ts)) AS BIGINT)) / 86400.0 / 90.0)) AS weight, count(*) AS n_changes, count(DISTINCT event_type) AS types FROM events, now GROUP BY user_id)"


def _decayed(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_type", churn.epoch_seconds("ts").alias("s"))
    now = e.agg(F.max("s").alias("__now"))
    return churn.decayed(e.crossJoin(F.broadcast(now)), ["user_id"], F.col("s"), F.col("__now"))  # one row


@query("q24_decay", f"WITH {DECAY_SQL} SELECT user_id, round(weight, 6) AS weight, n_changes FROM w")
def q24(spark, d):
    return _decayed(spark, d).withColumn("weight", F.round("weight", 6))


HOT_SQL = f"{DECAY_SQL}, h AS (SELECT user_id, round(least(100, greatest(0, weight / max(weight) OVER () * ((types / n_changes) / max(types / n_changes) OVER ()) * 100)), 4) AS score FROM w)"


def _hot(spark: SparkSession, d: str) -> DataFrame:
    types = read(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("types"))
    return churn.hotspots(_decayed(spark, d).join(types, "user_id"), "user_id", "weight", "types", "n_changes").select("user_id", F.round("score", 4).alias("score"))


@query("q25_hotspot", f"WITH {HOT_SQL} SELECT * FROM h WHERE score > 0")
def q25(spark, d):
    return _hot(spark, d)


@query("q26_topk", f"WITH {HOT_SQL} SELECT * FROM h WHERE score > 0 ORDER BY score DESC, user_id LIMIT 10")
def q26(spark, d):
    return churn.top(_hot(spark, d), 10, "user_id")  # a top-k report


@query(
    "q27_marker_filter",
    f"WITH {METRICS_SQL}, off AS (SELECT DISTINCT doc_id, CASE WHEN quality = 1 THEN 'many-words' END AS rule FROM labels WHERE toxic = 1) SELECT doc_id, kind, metric FROM f WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.doc_id = f.doc_id AND (rule IS NULL OR rule = kind))",
)
def q27(spark, d):
    marks = read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("file"), F.lit(1).alias("line"), F.when(F.col("quality") == 1, F.lit("many-words")).alias("rule")).distinct()
    found = _tripped(spark, d).withColumn("file", F.col("doc_id")).withColumn("line", F.lit(1))
    return findings.unmarked(found, marks, ("many-chars",)).select("doc_id", "kind", "metric")


@query("q28_glob_filter", r"SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^(?:.*1.*)$') AND NOT regexp_matches(url, '^(?:https?://(?:.*/)?[^/]*7\.html)$')")
def q28(spark, d):
    return findings.not_ignored(read(spark, d, "pages").select("page_id", "url"), "url", ["*1*"]).filter(~F.col("url").rlike(r"^(?:https?://(?:.*/)?[^/]*7\.html)$")).select("page_id")


@query("q29_baseline", f"WITH {METRICS_SQL}, rec AS (SELECT kind, source AS name, max(metric) AS metric FROM f JOIN documents USING (doc_id, source) WHERE lang = 'en' GROUP BY ALL) SELECT f.kind, f.source AS name, f.doc_id, f.metric FROM f LEFT JOIN rec ON rec.kind = f.kind AND rec.name = f.source WHERE rec.metric IS NULL OR f.metric > rec.metric")
def q29(spark, d):
    """What all documents trip over what the English ones of their source did."""
    found = _tripped(spark, d, "lang").withColumnRenamed("source", "name")
    return findings.over_baseline(found.select("kind", "name", "doc_id", "metric"), findings.baseline_of(found.filter("lang = 'en'")))


@query("q30_stale", f"WITH {METRICS_SQL}, rec AS (SELECT kind, doc_id AS name, max(metric) AS metric FROM f GROUP BY ALL) SELECT kind, name, metric FROM rec WHERE name IN (SELECT doc_id FROM labels WHERE quality = 0)")
def q30(spark, d):
    """Everything is recorded; then the documents that labels call bad are gone."""
    found = _tripped(spark, d).withColumnRenamed("doc_id", "name")
    bad = read(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("name"))
    return findings.stale_records(findings.baseline_of(found), found.join(bad, "name", "left_anti"))


@query("q31_baseline_build", f"WITH {METRICS_SQL} SELECT kind, source AS name, max(metric) AS metric FROM f GROUP BY kind, source")
def q31(spark, d):
    return findings.baseline_of(_tripped(spark, d).withColumnRenamed("source", "name"))


@query("q32_group_report", f"WITH {METRICS_SQL} SELECT doc_id, max(severity) AS severity, count(*) AS n_findings, string_agg(kind, ',' ORDER BY -severity, kind) AS kinds FROM f GROUP BY doc_id")
def q32(spark, d):
    return checks.report_groups(_tripped(spark, d), ["doc_id"]).withColumn("kinds", F.array_join("kinds", ","))


@query(
    "q33_summary",
    f"WITH {METRICS_SQL} SELECT count(*) FILTER (coalesce(lang <> 'en', TRUE)) AS excluded, count(*) FILTER (NOT coalesce(lang <> 'en', TRUE)) AS eligible, (SELECT count(*) FROM f WHERE kind = 'many-words') AS n_many_words, (SELECT count(*) FROM f WHERE kind = 'many-lines') AS n_many_lines, (SELECT count(*) FROM f WHERE kind = 'long-word') AS n_long_word, (SELECT count(*) FROM f WHERE kind = 'many-chars') AS n_many_chars FROM documents",
)
def q33(spark, d):
    return checks.summary(read(spark, d, "documents"), _tripped(spark, d), F.coalesce(F.col("lang") != "en", F.lit(True)), list(LIMITS))


PREFIX_SQL = r"""pre AS (SELECT page_id, url, html, list_transform(range(1, len(string_split(url, '/')) + 1), lambda n: array_to_string(string_split(url, '/')[1 : n], '/')) AS ps FROM pages),
reg AS (SELECT DISTINCT CASE WHEN length(html) > 3000 THEN ps[len(ps) - 1] ELSE ps[3] END AS prefix FROM pre WHERE len(ps) > 3)"""


@query("q34_prefix_assign", f"WITH {PREFIX_SQL}, e AS (SELECT page_id, unnest(ps) AS prefix, generate_subscripts(ps, 1) AS depth FROM pre) SELECT p.page_id, x.prefix FROM pages p LEFT JOIN (SELECT page_id, arg_max(prefix, depth) AS prefix FROM e JOIN reg USING (prefix) GROUP BY page_id) x USING (page_id)")
def q34(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    parts = F.split("url", "/")
    pre = read(spark, d, "pages").withColumn("ps", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    roots = pre.filter("size(ps) > 3").select(F.when(F.length("html") > 3000, F.element_at("ps", F.size("ps") - 1)).otherwise(F.element_at("ps", 3)).alias("prefix")).distinct()
    from lodework.sources.workspace import deepest_prefix

    return deepest_prefix(pages, "page_id", "url", roots, "prefix")


@query("q35_generated", r"SELECT page_id, (lower(url) LIKE '%.g.cs' OR lower(url) LIKE '%7' OR list_contains(string_split(lower(url), '/'), 'www')) AS is_generated FROM pages")
def q35(spark, d):
    return read(spark, d, "pages").select("page_id", scalars.generated_by_path(F.col("url"), (".g.cs", "7"), "www").alias("is_generated"))


@query("q36_arity_suffix", "SELECT p_partkey, CASE WHEN p_size > 5 AND count(*) FILTER (p_size > 5) OVER (PARTITION BY p_brand, p_name) > 1 THEN p_name || '/' || p_size ELSE p_name END AS p_name FROM part")
def q36(spark, d):
    return checks.suffixed(read(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size"), ["p_brand"], "p_name", F.col("p_size"), F.col("p_size") > 5).select("p_partkey", "p_name")


@query(
    "q37_json",
    f"""WITH {METRICS_SQL} SELECT '{{"kind":"' || f.kind || '","name":' || doc_id || CASE WHEN lang = 'en' AND source IS NOT NULL THEN ',"project":' || to_json(source) ELSE '' END
  || ',"metric":' || metric || ',"threshold":' || threshold || ',"severity":' || CAST(round(severity * 100) / 100 AS VARCHAR) || '}}' AS json FROM f JOIN documents USING (doc_id, source)""",
)
def q37(spark, d):
    rows = _tripped(spark, d, "lang").withColumn("project", F.when(F.col("lang") == "en", F.col("source")))
    return findings.as_json(rows, [F.col("kind"), F.col("doc_id").alias("name"), F.col("project"), F.col("metric"), F.col("threshold"), scalars.rounded(F.col("severity"), 2).alias("severity")])
