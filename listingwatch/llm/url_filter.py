"""Operator 6: URL filter with a path-template tree.

Rules decide first. For the other URLs a tree of path templates is grown per host, and one over all hosts ("*"):
variable segments become wildcards; at each node a branch whose share of blocked pages does not differ from its siblings'
is merged into the wildcard branch, and of the branches that stand apart those whose shares do not differ from
each other are merged too, neighbour by neighbour in the order of their shares. Labels are the rules' own verdicts. A
template's blocked share is smoothed towards the same path's share over all hosts, and that towards the share of all
labelled pages; templates above one half are rejected.

The tree grows level by level, as deep as labelled paths of one template still differ. All steps are aggregates and
joins over distinct paths, not over pages; what a step joins to is written out first, so that Spark knows its size and
splits a hot tree or path in the join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Segments that name one page: numbers, or long or mixed keys.
VARIABLE = r"^[0-9]+$|^[0-9a-fA-F]{8,}$|^.{32,}$|^[0-9].*[0-9]$"
#: Pages' worth of the wider estimate in a narrower one.
SMOOTHING = 4.0
#: Standard errors by which a branch must differ to stay apart.
APART = 1.96
#: Before a host's name where it names a tree; the tree of all hosts is "*".
OWN = "host:"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path written together), and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def differ(n1: Column, b1: Column, n2: Column, b2: Column, apart: float) -> Column:
    """Whether two blocked shares (b of n pages, each taken with one page of either kind more) differ by `apart` errors."""
    mean = (b1 + b2 + 1) / (n1 + n2 + 2)
    error = F.sqrt(mean * (1 - mean) * (1 / (n1 + 1) + 1 / (n2 + 1)))
    return F.abs((b1 + 1) / (n1 + 2) - (b2 + 1) / (n2 + 2)) > apart * error


def steps_of(rows: DataFrame, apart: float) -> DataFrame:
    """Rows (tree, template, segment, labelled, blocked) of one level -> what each branch adds to the template."""
    node = ["tree", "template"]
    branch = rows.groupBy(*node, "segment").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    siblings = cut(branch.groupBy(*node).agg(F.sum("n").alias("n_all"), F.sum("b").alias("b_all")), "url-nodes")
    n, b = F.col("n"), F.col("b")
    strong = (F.col("segment") != "") & (n > 0) & differ(n, b, F.col("n_all") - n, F.col("b_all") - b, apart)
    branch = cut(branch.join(siblings, node).select(*node, "segment", "n", "b", strong.alias("strong")), "url-branches")
    # branches with the same counts are one point, so a node has far fewer points than branches
    points = branch.where("strong").groupBy(*node, "n", "b").agg(F.count("*").alias("members"), F.min("segment").alias("first"))
    by_share = Window.partitionBy(*node).orderBy((b + 1) / (n + 2), "n", "b")
    new = F.coalesce(differ(n, b, F.lag("n").over(by_share), F.lag("b").over(by_share), apart), F.lit(True))
    points = points.withColumn("new", new.cast("int")).withColumn("group", F.sum("new").over(by_share))
    group = Window.partitionBy(*node, "group")
    name = F.when(F.sum("members").over(group) == 1, F.concat(F.lit("/"), "first")).otherwise(F.concat(F.lit("//"), F.min("first").over(group)))
    points = cut(points.select(*node, "n", "b", name.alias("name")), "url-points")
    named = branch.join(points.withColumn("strong", F.lit(True)), [*node, "n", "b", "strong"], "left")
    step = F.when(F.col("segment") == "", "").otherwise(F.coalesce("name", F.lit("/*")))
    return cut(named.select(*node, "segment", step.alias("step")), "url-steps")


def grow(paths: DataFrame, apart: float = APART) -> DataFrame:
    """(tree, segments, labelled, blocked) -> with `template`: a step for each segment: `/segment` where its branch stands
    apart, `//segment` (the first of those merged) where several do together, else `/*`; `/**` for all that follows
    where no labelled path differs any more."""
    node = ["tree", "template"]
    rows, done, level = cut(paths.withColumn("template", F.lit("")), "url-tree"), None, 0
    while True:
        level += 1
        open_ = rows.groupBy(*node).agg((F.count("*") > 1).alias("several"), F.sum("labelled").alias("all_labelled")).where("several and all_labelled > 0")
        open_ = cut(open_.select(*node, F.lit(True).alias("open")), "url-open")
        rows = rows.join(open_, node, "left")
        rest = rows.where("open is null").drop("open").withColumn("template", F.concat("template", F.when(F.size("segments") >= level, "/**").otherwise("")))
        done = rest if done is None else done.unionByName(rest)
        growing = rows.where("open").drop("open").withColumn("segment", F.coalesce(F.try_element_at("segments", F.lit(level)), F.lit("")))
        growing = cut(growing, "url-level")
        if not growing.limit(1).count():
            return cut(done, "url-tree")
        stepped = growing.join(steps_of(growing, apart), [*node, "segment"]).withColumn("template", F.concat("template", "step")).drop("step")
        stepped = cut(stepped, "url-tree")
        done = done.unionByName(stepped.where("segment = ''").drop("segment"))
        rows = stepped.where("segment <> ''").drop("segment")


def judge(pages: DataFrame, rules=RULES, smoothing: float = SMOOTHING, apart: float = APART) -> DataFrame:
    """page_id, host, path, rule, verdict, template, p_block for each row of pages (page_id, url).

    A null URL or one without `://` has an empty host and path. Repeated rows and null ids are rows like any other;
    other columns are not read. Without any labelled page, p_block is one half and pages are allowed.
    """
    host, path = F.col("host"), F.col("path")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(host, path, rules)
    parsed = parsed.withColumns({"rule": rule, "said": verdict})
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    parsed = parsed.withColumn("segments", F.transform(segments, lambda x: F.when(x.rlike(VARIABLE), "*").otherwise(x)))
    labels = [F.count("said").alias("labelled"), F.count(F.when(F.col("said") == "block", 1)).alias("blocked")]
    distinct = cut(parsed.groupBy("host", "segments").agg(*labels), "url-paths")
    all_hosts = distinct.groupBy("segments").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    own = distinct.select(F.concat(F.lit(OWN), "host").alias("tree"), "segments", "labelled", "blocked")
    trees = grow(own.unionByName(all_hosts.withColumn("tree", F.lit("*"))), apart)
    shares = cut(trees.groupBy("tree", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")), "url-shares")
    leaves = trees.join(shares, ["tree", "template"])
    blocked, labelled = distinct.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = (blocked + 1) / (labelled + 2) if labelled is not None else 0.5
    wide_p = cut(leaves.where("tree = '*'").select("segments", ((F.col("b") + smoothing * F.lit(prior)) / (F.col("n") + smoothing)).alias("p_wide")), "url-wide")
    own_p = leaves.where("tree <> '*'").join(wide_p, "segments")
    p = (F.col("b") + smoothing * F.col("p_wide")) / (F.col("n") + smoothing)
    leaf = cut(own_p.select(F.substring("tree", len(OWN) + 1, 1 << 30).alias("host"), "segments", "template", p.alias("p_block")), "url-leaves")
    judged = parsed.join(leaf, ["host", "segments"])
    found = F.coalesce("said", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", found.alias("verdict"), "template", "p_block")
