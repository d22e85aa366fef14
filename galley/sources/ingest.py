"""Ingestion: staged files, jobs in JSON, stage metadata, settings, sidecars, logs, report exports; and the sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.operators.states import latest_per_key
from galley.operators.text import is_refusal
from galley.sources.tables import read

#: Fixed values.
KINDS, PROFILES = ("packet", "consistency1", "consistency2", "complement"), ("quick", "standard", "thorough")
LENSES, STATUSES = ("typo", "grammar", "numbers", "gap"), ("done", "warning", "error")
PROMPT = 200_000
JOB = "id string, kind string, profile string, mode string, prompt string, pdf string"


def stage_batch(files: DataFrame, existing: DataFrame, most: int) -> DataFrame:
    """New files (name, content, order) once per name, length and bytes, without those staged already; none at all if more than `most` are new."""
    tidy = lambda df: df.withColumn("length", F.length("content")).withColumn("digest", F.sha2("content", 256))
    key = ["name", "length", "digest"]
    new = tidy(files).join(tidy(existing).select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min("order").alias("order"))
    n = new.agg(F.count(F.lit(1)).alias("total"))
    return new.join(n, F.col("total") <= most).drop("total")


def parse_jobs(raw: DataFrame) -> DataFrame:
    """Jobs from JSON text (column value): problem is null for a good one; masked jobs lose their pdf."""
    j = raw.select(F.from_json("value", JOB).alias("j")).select("j.*")
    problem = F.when(F.col("id").isNull(), "no id").when(F.coalesce(F.length("prompt"), F.lit(0)) > PROMPT, "prompt too long").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind").when(~F.coalesce(F.col("profile").isin(*PROFILES), F.lit(False)), "profile")
    return j.withColumn("problem", problem).withColumn("pdf", F.when(F.col("mode") == "masked", F.lit(None).cast("string")).otherwise(F.col("pdf")))


def stage_metadata(packets: DataFrame) -> DataFrame:
    """Stage columns from a nested struct or flat fields, nested first; bad ones are marked."""
    index = F.coalesce("stage.index", "stage_index")
    total = F.coalesce("stage.total", "stage_total")
    return packets.withColumn("index", index).withColumn("total", total).withColumn("bad", ~F.coalesce((index >= 1) & (index <= total), F.lit(False)))


def overlay_settings(defaults: Column, own: Column) -> Column:
    """A map of settings over the defaults; keys that the defaults lack are left out."""
    return F.map_from_entries(F.transform(F.map_entries(defaults), lambda e: F.struct(e["key"], F.coalesce(F.element_at(own, e["key"]), e["value"]))))


def assign_target(files: DataFrame) -> DataFrame:
    """Which of a drop's files (drop_id, name, language) is the target: language, then the name's votes, else ask."""
    vote = lambda c: F.when(F.lower(c).rlike(r"(^|[^a-z])(en|eng|english)([^a-z]|$)"), 1).when(F.lower(c).rlike(r"(^|[^a-z])(ja|jp|jpn|japanese)([^a-z]|$)"), -1).otherwise(0)
    spoken = F.when(F.col("language") == "英語", 1).when(F.col("language") == "日本語", -1).otherwise(0)
    f = files.withColumn("spoken", spoken).withColumn("voted", vote(F.col("name")))
    g = f.groupBy("drop_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("spoken") == 1).cast("int")).alias("en"), F.max_by("name", F.struct("spoken", "name")).alias("by_language"), F.sum((F.col("voted") == 1).cast("int")).alias("named"), F.max_by("name", F.struct("voted", "name")).alias("by_name"))
    return g.select("drop_id", F.when(F.col("n") > 2, None).when(F.col("en") == 1, F.col("by_language")).when((F.col("en") == 0) & (F.col("named") == 1), F.col("by_name")).alias("target"))


def sidecar_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, at, line) of a sidecar under their last header `===== PDF P.n / ROLE ... =====`: page and role."""
    header = r"^===== PDF P\.([0-9]+) / ([A-Z_]+)"
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    h = F.when(F.col("line").rlike(header), F.struct(F.regexp_extract("line", header, 1).cast("int").alias("page"), F.regexp_extract("line", header, 2).alias("role")))
    marked = lines.withColumn("own", h).withColumn("under", F.last("own", ignorenulls=True).over(w))
    return marked.where("own is null and under is not null").select("doc_id", "at", "line", "under.page", "under.role")


def valid_extracts(raw: DataFrame, version: int = 1) -> DataFrame:
    """Extracts in JSON text (column value) of the right schema version whose text has the digest it claims."""
    j = raw.select(F.from_json("value", "schema string, version int, text string, sha256 string").alias("j")).select("j.*")
    return j.where((F.col("version") == version) & (F.sha2("text", 256) == F.col("sha256")))


def log_counts(lines: DataFrame) -> DataFrame:
    """Day by day: lines, attach failures, stalls and refusals of log lines `[time] message`; lines without a time are left out."""
    at = F.try_to_timestamp(F.regexp_extract("value", r"^\[([0-9-]+ [0-9:]+)\]", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    n = lambda p: F.sum(F.lower("value").rlike(p).cast("long"))
    return lines.withColumn("at", at).where("at is not null").groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("lines"), n("attach failed").alias("attach"), n("stall").alias("stalls"), n("refus").alias("refusals"))


def report_to_run(findings: DataFrame) -> DataFrame:
    """Live findings of a report as scored rows: certain ones are findings, the others uncertain candidates."""
    live = findings.where("excluded_reason is null or trim(excluded_reason) = ''")
    kind = F.when(F.coalesce("needs_human_review", F.lit(False)), "uncertain").otherwise("finding")
    return live.select("packet_id", "page", "quote", kind.alias("kind"))


def pass_stats_rows(rows: DataFrame) -> DataFrame:
    """Rows fit for the statistics file: listed lenses and statuses, counts within 0..100000, coverage within [0, 1]."""
    ok = F.col("lens").isin(*LENSES) & F.col("status").isin(*STATUSES)
    return rows.where(ok).withColumn("findings_new", F.least(F.greatest("findings_new", F.lit(0)), F.lit(100_000))).withColumn("coverage", F.least(F.greatest("coverage", F.lit(0.0)), F.lit(1.0)))


def append_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").option("header", True).option("escape", '"').csv(folder)


def refusal_rows(turns: DataFrame) -> DataFrame:
    """timestamp, completed_by, elapsed_ms of turns (at, completed_by, elapsed_ms, text) that decline, fit for the refusals file: times in UTC with milliseconds, no negative durations."""
    refused = turns.where(is_refusal(F.col("text")))
    return refused.select(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.coalesce("completed_by", F.lit("")).alias("completed_by"), F.greatest(F.coalesce(F.col("elapsed_ms").cast("long"), F.lit(0)), F.lit(0)).alias("elapsed_ms"))


def staged_pdfs(files: DataFrame) -> DataFrame:
    """name, pages, problem of files (name, content; of the binaryFile source too): the first reason against one, or null.

    A PDF starts with its mark and says where it ends. Page objects are counted where they can be read; in a file with
    object streams, which are compressed, they can't, so its number of pages is null and no reason against it.
    """
    text = F.decode("content", "ISO-8859-1")
    pages = F.regexp_count(text, F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    size = F.coalesce(F.length("content"), F.lit(0))
    problem = F.when(~F.coalesce(F.lower("name").endswith(".pdf"), F.lit(False)), "name").when(size == 0, "empty").when(~text.startswith("%PDF-"), "type").when(~F.right(text, F.lit(1024)).contains("%%EOF"), "truncated")
    readable = problem.isNull() & (pages > 0) & ~text.contains("/ObjStm")
    return files.select("name", F.when(readable, pages).cast("long").alias("pages"), problem.alias("problem"))


def write_report(findings: DataFrame, folder: str) -> None:
    """CSV and JSON with every finding, excluded ones too; an existing report is an error."""
    findings.write.option("header", True).option("escape", '"').csv(f"{folder}/csv")
    findings.write.json(f"{folder}/json")


def write_report_folder(findings: DataFrame, parent: str, name: str) -> str:
    """Writes a report to a folder of that name, or `name (2)` and so on where it exists, and gives the name; whatever was written is removed if that fails."""
    if not name or name in (".", "..") or re.search(r"[\\/:]", name):
        raise ValueError("not a folder's name")
    spark = findings.sparkSession
    path = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{parent.rstrip('/')}/{n}")
    system = path(name).getFileSystem(spark._jsc.hadoopConfiguration())
    free = next(n for n in (name, *(f"{name} ({k})" for k in range(2, 10_000))) if not system.exists(path(n)))
    try:
        write_report(findings, f"{parent.rstrip('/')}/{free}")
    except Exception:
        system.delete(path(free), True)
        raise
    return free


def next_revision(journal: DataFrame, states: DataFrame) -> DataFrame:
    """states (job_id, state) with the next revision of their job."""
    last = journal.groupBy("job_id").agg(F.max("revision").alias("last"))
    return states.join(last, "job_id", "left").select("job_id", (F.coalesce("last", F.lit(0)) + 1).alias("revision"), "state")


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of each packet (packet_id, at, ...)."""
    return latest_per_key(old.unionByName(new), "packet_id", ["at"])


def expired(files: DataFrame, protected: DataFrame, days: int) -> DataFrame:
    """Files (id, at) older than so many days before the newest one, except protected ids."""
    newest = files.agg(F.max("at").alias("newest"))
    return files.join(newest, F.col("at") < F.col("newest") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("newest").join(protected, "id", "left_anti")


def s02_stage_batch(spark, d):
    f = read(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.encode(F.col("c_nationkey").cast("string"), "UTF-8").alias("content"), F.col("c_custkey").alias("order"))
    old = read(spark, d, "supplier").select(F.lit("BUILDING").alias("name"), F.encode(F.col("s_nationkey").cast("string"), "UTF-8").alias("content"))
    return stage_batch(f, old, 1000).select("name", "length", "order")


def s03_parse_jobs(spark, d):
    o = read(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "packet").otherwise("consistency1").alias("kind"), F.when(F.col("o_orderpriority").startswith("1"), "odd").otherwise("quick").alias("profile"), F.when(F.col("o_totalprice") > 100000, "masked").alias("mode"), F.lit("p").alias("prompt"), F.lit("x.pdf").alias("pdf"))).alias("value"))
    return parse_jobs(o).groupBy("problem", "pdf", "kind").agg(F.count(F.lit(1)).alias("n"))


def s04_stage_metadata(spark, d):
    li = read(spark, d, "lineitem").select(F.when(F.col("l_tax") > 0.04, F.struct(F.col("l_linenumber").alias("index"), F.lit(5).alias("total"))).alias("stage"), F.lit(2).alias("stage_index"), F.when(F.col("l_discount") > 0.02, 3).alias("stage_total"))
    return stage_metadata(li).groupBy("index", "total", "bad").agg(F.count(F.lit(1)).alias("n"))


def s05_settings(spark, d):
    defaults = F.create_map(F.lit("workers"), F.lit("4"), F.lit("timeout"), F.lit("240"))
    own = F.create_map(F.lit("workers"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")), F.lit("other"), F.lit("x"))
    s = read(spark, d, "customer").select(overlay_settings(defaults, own).alias("s"))
    return s.select(F.col("s")["workers"].alias("workers"), F.col("s")["timeout"].alias("timeout"), F.size("s").cast("long").alias("size")).groupBy("workers", "timeout", "size").agg(F.count(F.lit(1)).alias("n"))


def s06_assign_target(spark, d):
    n = read(spark, d, "nation")
    both = n.select(F.col("n_nationkey").alias("drop_id"), F.concat("n_name", F.lit("_en.pdf")).alias("name"), F.when(F.col("n_regionkey") > 2, "英語").otherwise("その他").alias("language")).union(n.select("n_nationkey", F.concat("n_name", F.lit("_ja.pdf")), F.when(F.col("n_regionkey") > 1, F.lit("日本語")).otherwise("英語")))
    return assign_target(both)


def s07_sidecar(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("===== PDF P."), F.col("l_linenumber").cast("string"), F.lit(" / TARGET_CHECK / x ====="))).otherwise("text").alias("line"))
    return sidecar_lines(li).groupBy("page", "role").agg(F.count(F.lit(1)).alias("n"))


def s08_valid_extracts(spark, d):
    raw = read(spark, d, "documents").select(F.to_json(F.struct(F.lit("extract").alias("schema"), F.when(F.col("lang") == "de", 2).otherwise(1).alias("version"), "text", F.when(F.col("lang") == "fr", "no").otherwise(F.sha2("text", 256)).alias("sha256"))).alias("value"))
    return valid_extracts(raw).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


def s09_log_counts(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.when(F.col("value") > 80, "Stall seen").when(F.col("value") > 60, "attach failed").otherwise("fine")).alias("value"))
    return log_counts(e)


def s11_report_to_run(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("packet_id"), F.col("l_linenumber").alias("page"), F.lit("q").alias("quote"), F.when(F.col("l_tax") > 0.05, "duplicate").when(F.col("l_tax") > 0.03, " ").alias("excluded_reason"), F.when(F.col("l_discount") > 0.05, F.col("l_discount") > 0.07).alias("needs_human_review"))
    return report_to_run(li).groupBy("kind", "page").agg(F.count(F.lit(1)).alias("n"))


def k01_pass_stats(spark, d):
    li = read(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "typo").when(F.col("l_returnflag") == "R", "gap").otherwise("odd").alias("lens"), F.when(F.col("l_linestatus") == "F", "done").otherwise("error").alias("status"), (F.col("l_extendedprice") * 3).cast("int").alias("findings_new"), (F.col("l_discount") * 20 - 0.2).alias("coverage"))
    return pass_stats_rows(li).groupBy("lens", "status").agg(F.sum("findings_new").alias("findings_new"), F.min("coverage").alias("low"), F.max("coverage").alias("high"), F.count(F.lit(1)).alias("n"))


def k03_next_revision(spark, d):
    j = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("revision"))
    return next_revision(j, read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("state")))


def k04_upsert_manifest(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("packet_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").alias("at"), F.col("l_returnflag").alias("flag"), "l_discount")
    return upsert_manifest(li.where("l_discount < 0.05").drop("l_discount"), li.where("l_discount >= 0.05").drop("l_discount")).select("packet_id", "flag", F.col("at.l_orderkey").alias("job"))


def k07_expired(spark, d):
    files = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return expired(files, read(spark, d, "lineitem").where("l_tax > 0.06").select(F.col("l_orderkey").alias("id")).distinct(), 1000)


def x36_digests(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def s01_staged_pdfs(spark, d):
    o = read(spark, d, "orders")
    body = F.concat(F.when(F.col("o_orderstatus") == "P", "").otherwise("%PDF-1.7\n"), F.repeat(F.lit("<< /Type /Page >> "), F.pmod("o_orderkey", F.lit(4)).cast("int")), F.lit("<< /Type /Pages >>"), F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "<< /Type /ObjStm >>").otherwise(""), F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise("\n%%EOF\n"))
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderpriority") == "2-HIGH", ".txt").otherwise(".PDF"))
    return staged_pdfs(o.select(name.alias("name"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("").cast("binary")).otherwise(body.cast("binary")).alias("content")))


def k02_refusals(spark, d):
    e = read(spark, d, "events")
    text = F.when(F.col("value") > 60, "申し訳ございません。それには回答できません。").when(F.col("value") > 30, "Something went wrong").otherwise("The page is fine")
    return refusal_rows(e.select(F.col("ts").alias("at"), F.col("event_type").alias("completed_by"), (F.col("event_id") - 5).alias("elapsed_ms"), text.alias("text"))).groupBy("completed_by").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_ms").alias("ms"), F.min(F.substring("timestamp", 1, 10)).alias("first"))


QUERIES = {f.__name__: f for f in (s01_staged_pdfs, k02_refusals, s02_stage_batch, s03_parse_jobs, s04_stage_metadata, s05_settings, s06_assign_target, s07_sidecar, s08_valid_extracts, s09_log_counts, s11_report_to_run, k01_pass_stats, k03_next_revision, k04_upsert_manifest, k07_expired, x36_digests)}

ORACLE_SQL = {
    "s02_stage_batch": "SELECT c_mktsegment AS name, CAST(len(CAST(c_nationkey AS VARCHAR)) AS INT) AS length, min(c_custkey) AS \"order\" FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT s_nationkey FROM supplier)) GROUP BY c_mktsegment, c_nationkey",
    "s03_parse_jobs": "SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'profile' END AS problem, CASE WHEN o_totalprice > 100000 THEN NULL ELSE 'x.pdf' END AS pdf, CASE WHEN o_orderstatus = 'F' THEN 'packet' ELSE 'consistency1' END AS kind, count(*) AS n FROM orders GROUP BY 1, 2, 3",
    "s04_stage_metadata": "SELECT CASE WHEN l_tax > 0.04 THEN l_linenumber ELSE 2 END AS index, CASE WHEN l_tax > 0.04 THEN 5 WHEN l_discount > 0.02 THEN 3 END AS total, CASE WHEN l_tax > 0.04 THEN l_linenumber > 5 ELSE l_discount <= 0.02 END AS bad, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
    "s05_settings": "SELECT CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '4' END AS workers, '240' AS timeout, 2 AS size, count(*) AS n FROM customer GROUP BY 1",
    "s06_assign_target": "SELECT n_nationkey AS drop_id, CASE WHEN n_regionkey <= 1 THEN n_name || '_ja.pdf' ELSE n_name || '_en.pdf' END AS target FROM nation",
    "s07_sidecar": "SELECT page, 'TARGET_CHECK' AS role, count(*) AS n FROM (SELECT l_returnflag, last_value(CASE WHEN l_returnflag = 'A' THEN l_linenumber END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS page FROM lineitem) WHERE l_returnflag <> 'A' AND page IS NOT NULL GROUP BY page",
    "s08_valid_extracts": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents WHERE lang NOT IN ('de', 'fr') GROUP BY 1",
    "s09_log_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS lines, count(*) FILTER (WHERE value > 60 AND value <= 80) AS attach, count(*) FILTER (WHERE value > 80) AS stalls, 0 AS refusals FROM events GROUP BY 1",
    "s11_report_to_run": "SELECT CASE WHEN l_discount > 0.07 THEN 'uncertain' ELSE 'finding' END AS kind, l_linenumber AS page, count(*) AS n FROM lineitem WHERE l_tax <= 0.05 GROUP BY 1, 2",
    "s01_staged_pdfs": """SELECT o_orderkey || CASE WHEN o_orderpriority = '2-HIGH' THEN '.txt' ELSE '.PDF' END AS name, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') OR o_orderstatus = 'P' OR o_orderkey % 5 = 0 OR o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 4 END AS pages,
CASE WHEN o_orderpriority = '2-HIGH' THEN 'name' WHEN o_orderpriority = '5-LOW' THEN 'empty' WHEN o_orderstatus = 'P' THEN 'type' WHEN o_orderpriority = '1-URGENT' THEN 'truncated' END AS problem FROM orders""",
    "k02_refusals": "SELECT event_type AS completed_by, count(*) AS n, CAST(sum(greatest(event_id - 5, 0)) AS BIGINT) AS ms, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first FROM events WHERE value > 30 GROUP BY 1",
    "k01_pass_stats": "SELECT CASE l_returnflag WHEN 'A' THEN 'typo' ELSE 'gap' END AS lens, CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'error' END AS status, CAST(sum(least(CAST(trunc(l_extendedprice * 3) AS INT), 100000)) AS BIGINT) AS findings_new, min(greatest(0, least(1, l_discount * 20 - 0.2))) AS low, max(greatest(0, least(1, l_discount * 20 - 0.2))) AS high, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2",
    "k03_next_revision": "SELECT o_orderkey AS job_id, coalesce(max(l_linenumber), 0) + 1 AS revision, o_orderstatus AS state FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus",
    "k04_upsert_manifest": "SELECT packet_id, flag, job FROM (SELECT l_partkey AS packet_id, l_returnflag AS flag, l_orderkey AS job, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1",
    "k07_expired": "SELECT o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 1000 DAYS AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.06)",
    "x36_digests": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
}
