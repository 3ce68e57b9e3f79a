"""URL filters by rules and a tree of path templates (operator 6).

Rules come first: a rule fits its host and all subdomains if the path starts with the rule's, and the longest one decides. What
no rule fits is judged by the template its path falls under:

1. Per host the paths form a tree of segments. From the root down, segments of one shape (number, hexadecimal, date, word with digits) become a
   wildcard where they vary: many different values, none of them frequent. Words are variable only where there are very many.
2. Literal branches of one node are of one kind if the same shape mostly follows them; those that do not differ by a G-test, in what follows and, where they
   have labels, in these, from all branches of their kind taken together are merged into one. So a branch without labels shares the verdict of labelled ones like it.
3. The pages that rules judge are the labels. A template's purity is its share of blocked labels, smoothed towards that of its host, and that
   towards that of all hosts; a template with enough labels and a high purity is rejected, all others are allowed.

The tree is built from distinct (host, path) with counts, level by level; every level is an aggregate per node and value and one join back
by node, so that a host with a third of all pages is spread over its nodes and shrinks before each shuffle. Nothing of it is collected.

Null or unparsable urls have an empty host and path, no rule, and are judged as the template of that host. The tree goes as deep as a node has ``least_pages`` pages and
two paths; what is below stands together as one wildcard, so there are as many levels as the deepest such node.
Repeated pages count as often as they occur; an empty table gives no rows. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptide.llm.common import saved
from shoptide.sinks import files

Rules = tuple[tuple[str, str, str], ...]
#: Verdict, host, path.
RULES: Rules = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
                ("block", "com", "/de/"))

SHAPES = (("number", r"^[0-9]+$"), ("date", r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), ("page", r"^[0-9]+\.[a-z]+$"),
          ("hex", r"^(?=.*[0-9])[0-9a-f]{8,}$"), ("mixed", r"^(?=.*[0-9]).+$"))


def host_of(url: Column) -> Column:
    found = F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.contains(url, F.lit("://")), found).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """The rule that decides, as struct (rule, verdict); null if none fits. One condition per rule: for lists of up to some hundred."""
    options = []
    for verdict, site, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(start))
        options.append(F.when(fits, F.struct(F.lit(site + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*options) if options else F.lit(None).cast("struct<rule:string,verdict:string>")


def _shape(segment: Column) -> Column:
    found = F.lit("word")
    for name, pattern in reversed(SHAPES):
        found = F.when(segment.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def _z(g: Column, df: Column) -> Column:
    """A chi-squared statistic as a normal deviate."""
    return (F.pow(g / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def templates(paths: DataFrame, least_pages: int = 5, min_values: int = 5, max_share: float = 0.2, word_values: int = 50,
              similar_z: float = 1.645) -> DataFrame:
    """``paths (host, path, n, blocked, allowed)``, one row per host and path, with ``template``."""
    rows = paths.withColumn("_parts", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    rows, rows_at = saved(rows)
    level = -1
    while True:
        level += 1
        here = F.get("_parts", F.lit(level))
        following = F.get("_parts", F.lit(level + 1))
        after = F.when(following.isNull(), "end").otherwise(_shape(following))
        sizes = rows.where(here.isNotNull()).groupBy("host", "template").agg(F.sum("n").alias("_pages"), F.count(F.lit(1)).alias("_paths"))
        if level and sizes.isEmpty():
            break
        small = sizes.select("host", "template", ((F.col("_pages") < least_pages) | (F.col("_paths") < 2)).alias("_small"))
        rows = rows.join(small, ["host", "template"], "left").withColumn("_small", F.coalesce("_small", F.lit(False)) & here.isNotNull())
        rows = rows.withColumn("template", F.when(F.col("_small"), F.concat("template", F.lit("/{rest}"))).otherwise(F.col("template"))).withColumn(
            "_parts", F.when(F.col("_small"), F.slice("_parts", 1, level)).otherwise(F.col("_parts"))).drop("_small")
        rows = rows.withColumn("_here", here).withColumn("_shape", _shape(F.col("_here")))
        reached = rows.where("_here is not null").withColumn("_after", after)
        values = reached.groupBy("host", "template", "_shape", "_here", "_after").agg(
            *[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")])
        values, values_at = saved(values)
        # Which shapes vary at a node.
        by_value = values.groupBy("host", "template", "_shape", "_here").agg(F.sum("n").alias("n"))
        shapes = by_value.groupBy("host", "template", "_shape").agg(
            F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"), F.max("n").alias("most"))
        least = F.when(F.col("_shape") == "word", word_values).otherwise(min_values)
        varies = shapes.select("host", "template", "_shape", (
            (F.col("values") >= least) & (F.col("most") <= F.greatest(F.lit(2.0), max_share * F.col("n")))).alias("_wild"))
        # Which of the literal branches are alike: G = 2 * sum(observed * ln(observed / expected)).
        literal = values.join(varies.where("not _wild"), ["host", "template", "_shape"], "left_semi")
        cells = literal.select("host", "template", "_here", F.explode(F.array(
            F.struct(F.concat(F.lit("follows "), "_after").alias("cell"), F.col("n").alias("c"), F.lit(0).alias("test")),
            F.struct(F.lit("blocked").alias("cell"), F.col("blocked").alias("c"), F.lit(1).alias("test")),
            F.struct(F.lit("allowed").alias("cell"), F.col("allowed").alias("c"), F.lit(1).alias("test")))).alias("x")).select(
                "host", "template", "_here", "x.*").where("c > 0")
        counted = cells.groupBy("host", "template", "_here", "test", "cell").agg(F.sum("c").alias("c"))
        # Only branches of one kind can be alike: by what mostly follows them.
        kinds = counted.where("test = 0").groupBy("host", "template", "_here").agg(F.max_by("cell", F.struct("c", "cell")).alias("_follows"))
        kinds = kinds.withColumn("kind", F.regexp_replace("_follows", "^follows ", ""))
        counted = counted.join(kinds.select("host", "template", "_here", "kind"), ["host", "template", "_here"])
        branch = counted.groupBy("host", "template", "_here", "test").agg(F.sum("c").alias("branch"))
        pooled = counted.groupBy("host", "template", "kind", "test", "cell").agg(F.sum("c").alias("pool"))
        pools = pooled.groupBy("host", "template", "kind", "test").agg(F.sum("pool").alias("all"), F.count(F.lit(1)).alias("cells"))
        g = (counted.join(branch, ["host", "template", "_here", "test"]).join(pooled, ["host", "template", "kind", "test", "cell"])
             .join(pools, ["host", "template", "kind", "test"])
             .groupBy("host", "template", "kind", "_here", "test", "cells")
             .agg((2 * F.sum(F.col("c") * F.log(F.col("c") * F.col("all") / (F.col("branch") * F.col("pool"))))).alias("g")))
        differs = F.when(F.col("cells") > 1, _z(F.greatest("g", F.lit(0.0)), F.col("cells") - 1) > similar_z).otherwise(F.lit(False))
        alike = g.groupBy("host", "template", "kind", "_here").agg(F.max(differs).alias("_differs")).where("not _differs")
        several = alike.groupBy("host", "template", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        merged = alike.join(several, ["host", "template", "kind"], "left_semi").select(
            "host", "template", "_here", F.concat(F.lit("{before "), "kind", F.lit("}")).alias("_merged"))
        rows = rows.join(varies, ["host", "template", "_shape"], "left").join(merged, ["host", "template", "_here"], "left")
        step = (F.when(F.col("_here").isNull(), "").when(F.col("_wild"), F.concat(F.lit("/{"), "_shape", F.lit("}")))
                .otherwise(F.concat(F.lit("/"), F.coalesce("_merged", "_here"))))
        rows = rows.withColumn("template", F.concat("template", step)).drop("_shape", "_here", "_wild", "_merged")
        rows, next_at = saved(rows)
        for path in (rows_at, values_at):  # both are in the rows just written
            files.remove(paths.sparkSession, path)
        rows_at = next_at
    return rows.drop("_parts")


def judge(pages: DataFrame, rules: Rules = RULES, purity: float = 0.9, min_labels: int = 5, weight: float = 2.0, **tree) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, template_purity`` of every row of ``pages (page_id, url)``."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    decided = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("_rule", decided)
    paths = parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("_verdict", decided["verdict"]).select(
        "host", "path", "n", F.when(F.col("_verdict") == "block", F.col("n")).otherwise(0).alias("blocked"),
        F.when(F.col("_verdict") == "allow", F.col("n")).otherwise(0).alias("allowed"))
    found = templates(paths, **tree)
    counts = found.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    hosts = counts.groupBy("host").agg(F.sum("b").alias("host_b"), F.sum("a").alias("host_a"))
    overall = hosts.agg(((F.sum("host_b") + 1) / (F.sum("host_b") + F.sum("host_a") + 2)).alias("overall")).scalar()
    of_host = (F.col("host_b") + weight * overall) / (F.col("host_b") + F.col("host_a") + weight)
    smoothed = (F.col("b") + weight * of_host) / (F.col("b") + F.col("a") + weight)
    scored = counts.join(hosts, "host").select(
        "host", "template", smoothed.alias("template_purity"), ((F.col("b") + F.col("a") >= min_labels) & (smoothed >= purity)).alias("_reject"))
    of_path = found.select("host", "path", "template").join(scored, ["host", "template"])
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_reject"), "block").otherwise("allow"))
    return ruled.join(of_path, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "template_purity")
