"""URL filters: listed rules first, then a path-template tree judged by smoothed labelled purity.

The tree grows level by level from aggregated paths, as deep as any host has LABELS labelled rows. A segment stays literal
in its node if it is not a number and has LABELS labelled rows of its own, however small its share of the host; all
others become `*`, as nothing could tell them apart. What lies deeper is one `**`. Then sibling branches that differ in
one literal are merged: those of equal purity, to a hundredth, and neighbours in purity that a two-proportion test does
not tell apart. A template whose smoothed purity is below the threshold is rejected. A host with a third of all rows
costs no more than its number of distinct paths, and no window has more than a hundred rows.

Nulls: a null url, or one without ://, has an empty host and path, and is judged as such. A null page_id has no label.
Pages without labels count nowhere in the tree but are judged by it. An empty table gives no rows, and without any labels
every template is allowed. Repeated rows each count. Very long paths are read whole. Columns other than page_id and url
are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.common import Scratch, ascii_lower, small

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled rows that make a segment literal; two-sided 5 % of the normal distribution; weight of the overall purity, in labels; smallest purity allowed.
LABELS, APART, WEIGHT, PUREST = 5, 1.96, 10.0, 0.6


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return pages.withColumn("host", ascii_lower(host)).withColumn("path", path)


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = None
    for said, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, f"{host}{path}") if rule is None else rule.when(fits, f"{host}{path}")
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def tree_depth(paths: DataFrame) -> int:
    """The deepest level at which a host has LABELS labelled rows; below it no segment can be literal. paths: host, segments, labelled."""
    by_size = paths.groupBy("host", F.size("segments").alias("k")).agg(F.sum("labelled").alias("labelled"))
    reach = F.sum("labelled").over(Window.partitionBy("host").orderBy(F.desc("k")))  # a row for each depth of a host
    return by_size.withColumn("reach", reach).where(F.col("reach") >= LABELS).agg(F.max("k")).first()[0] or 0


def path_templates(paths: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(paths (host, path, labelled, good) with their template, an array of literals and `*`, and `**` for what lies deeper; the tree's depth)."""
    none = F.array().cast("array<string>")
    now = paths.withColumn("segments", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("template", none)
    depth = tree_depth(now)
    for k in range(depth):
        now = now.withColumn("segment", F.get("segments", F.lit(k)))
        named = now.where(F.col("segment").isNotNull() & ~F.col("segment").rlike("^[0-9]+$"))
        literal = scratch.write(named.groupBy("host", "template", "segment").agg(F.sum("labelled").alias("own")).where(F.col("own") >= LABELS).select("host", "template", "segment", F.lit(True).alias("literal")), f"literals-{k}")
        side = F.broadcast(literal) if small(literal, 200) else literal
        step = F.when(F.col("segment").isNull(), none).otherwise(F.array(F.when(F.col("literal"), F.col("segment")).otherwise(F.lit("*"))))
        now = scratch.write(now.join(side, ["host", "template", "segment"], "left").withColumn("template", F.concat("template", step)).drop("segment", "literal"), f"level-{k}")
    tail = F.when(F.size("segments") > depth, F.array(F.lit("**"))).otherwise(none)
    return now.withColumn("template", F.concat("template", tail)).drop("segments"), depth


def merge_branches(templates: DataFrame, scratch: Scratch, depth: int) -> DataFrame:
    """templates (host, template, labelled, good) with the merged branch each belongs to (branch, of the same form).

    Siblings differ in one literal segment. A merged segment is named by its first literal and the number of others.
    """
    now = scratch.write(templates.withColumn("branch", F.col("template")), "branches")
    for k in range(depth - 1, -1, -1):
        own = F.get("branch", F.lit(k))
        family = F.expr(f"transform(branch, (s, i) -> if(i = {k}, '+', s))")
        group = now.groupBy("host", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        group = group.where((F.col("labelled") > 0) & own.isNotNull() & ~own.isin("*", "**")).withColumn("family", family).withColumn("literal", own)
        group = scratch.write(group.withColumn("step", F.floor(100 * F.col("good") / F.col("labelled"))), f"siblings-{k}")
        steps = group.groupBy("host", "family", "step").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), F.min("literal").alias("literal"), F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("host", "family").orderBy("step")  # at most 101 steps
        before = F.lag("labelled").over(w), F.lag("good").over(w)
        steps = steps.withColumn("m", before[0]).withColumn("g", before[1])
        pooled = (F.col("good") + F.col("g")) / (F.col("labelled") + F.col("m"))
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("m")))
        apart = F.coalesce(F.abs(F.col("good") / F.col("labelled") - F.col("g") / F.col("m")) > APART * spread, F.lit(True))
        steps = steps.withColumn("cluster", F.sum(apart.cast("int")).over(w))
        name = Window.partitionBy("host", "family", "cluster")
        first, others = F.min("literal").over(name), F.sum("n").over(name) - 1
        steps = steps.withColumn("name", F.when(others > 0, F.concat(first, F.lit("+"), others.cast("string"))).otherwise(first)).select("host", "family", "step", "name")
        merged = F.expr(f"transform(family, (s, i) -> if(i = {k}, name, s))")
        names = scratch.write(group.join(steps, ["host", "family", "step"]).select("host", "branch", merged.alias("merged")), f"names-{k}")
        side = F.broadcast(names) if small(names, 400) else names
        now = scratch.write(now.join(side, ["host", "branch"], "left").withColumn("branch", F.coalesce("merged", "branch")).drop("merged"), f"branches-{k}")
    return now


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. labels: doc_id (that of the page), quality, toxic."""
    scratch = Scratch(pages.sparkSession, "urls")
    named = with_host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path")
    marks = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).cast("long").alias("good"))
    seen = named.join(marks, "page_id", "left").groupBy("host", "path").agg(F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    made, depth = path_templates(scratch.write(seen, "paths"), scratch)
    paths = scratch.write(made, "templates")
    templates = paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    branches = merge_branches(templates, scratch, depth)
    labelled, good = branches.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    prior = good / labelled if labelled else 1.0
    purity = (F.sum("good") + F.lit(WEIGHT * prior)) / (F.sum("labelled") + F.lit(WEIGHT))
    judged = branches.join(branches.groupBy("host", "branch").agg(purity.alias("purity")), ["host", "branch"]).select("host", "template", "branch", "purity")
    judged = scratch.write(judged, "judged")
    by_path = paths.select("host", "path", "template").join(judged, ["host", "template"]).select("host", "path", F.concat(F.lit("/"), F.concat_ws("/", "branch")).alias("template"), "purity")
    rule, verdict = rule_columns(rules)
    own = F.when(F.col("purity") < PUREST, "block").otherwise("allow")
    return named.join(by_path, ["host", "path"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
