r"""URL filter: explicit rules first, then a tree of path templates judged by labelled purity.

A rule is (verdict, host, path): it fits its host and all subdomains, where the path starts with the rule's;
the longest rule that fits decides. Urls that no rule fits are judged by the tree.

The tree has one root for each host, and a level for each path segment. Segments are first generalised by
shape: runs of digits, long hexadecimal ids and long slugs become wildcards. Then, level by level:
- a parent with many children has its rare ones (below 1 / WIDE of its pages) generalised into `*`;
- children whose labelled rates differ by less than the error of a two-proportion test are merged, going
  through the siblings in order of their rates;
- a node's purity is (bad + STRENGTH * purity of its parent) / (labelled + STRENGTH). The parent of a host is
  the whole table.
A template whose purity is `reject_at` or more is rejected. Labels are any 0/1 column; the query takes the
verdicts of the rules, which label the pages that they fit.

Only counts per (host, shapes) enter the tree. Pages are counted after partial counts on each task, so a large
host is split by its shapes, and templates meet the pages again by an ordinary join. Siblings that are
compared are at most WIDE + 1 for each parent. The driver sees two totals, the depth of the tree and whether a
round was the last. A tree of up to DEPTH levels takes a round for each; from there on the segments that all
paths of a node share are taken in one round, as many as they are, so a long path that does not branch is one round.

A null url, and one without `://`, has an empty host and path. An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartline.llm.flat import saved

# The rules of the query, (verdict, host, path).
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
WIDE = 16
DEPTH = 8
STRENGTH = 4.0
ERRORS = 1.96
REJECT_AT = 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both '' without `://`."""
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name, verdict = F.when(fits, of + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def shapes(path: Column) -> Column:
    """The segments of a path by shape."""

    def shape(part: Column) -> Column:
        return (
            F.when(part.rlike(r"^[0-9a-fA-F]{8,}(-?[0-9a-fA-F]{4,})*$") & part.rlike("[0-9]"), "{id}")
            .when((F.char_length(part) > 40) | part.rlike(r"^([^-_]+[-_]){3,}"), "{slug}")
            .otherwise(F.regexp_replace(part, "[0-9]+", "{n}"))
        )

    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(parts, shape)


def templates(pages: DataFrame, *, wide: int = WIDE, strength: float = STRENGTH, errors: float = ERRORS) -> DataFrame:
    """host, shapes, template, purity from pages (host, shapes, bad: 1, 0 or null)."""
    leaves = saved(pages.groupBy("host", "shapes").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("bad").cast("double").alias("labelled"),
    ))
    total = leaves.agg(F.coalesce(F.sum("bad"), F.lit(0.0)), F.coalesce(F.sum("labelled"), F.lit(0.0)), F.coalesce(F.max(F.size("shapes")), F.lit(0))).first()
    prior = (total[0] + 1) / (total[1] + 2)
    hosts = leaves.groupBy("host").agg(((F.sum("bad") + strength * prior) / (F.sum("labelled") + strength)).alias("purity"))
    tree = leaves.join(hosts, "host").withColumn("template", F.array().cast("array<string>"))
    for _ in range(min(total[2], DEPTH)):
        tree = saved(_grown(tree, wide, strength, errors))
    while not tree.where(F.size("template") < F.size("shapes")).isEmpty():
        tree = saved(_grown(saved(_followed(tree, strength)), wide, strength, errors))
    return tree.select("host", "shapes", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def _followed(tree: DataFrame, strength: float) -> DataFrame:
    """The tree with the segments that all longer paths of a node share, and the purity after as many steps."""
    parent = ["host", "template"]
    at = F.size("template")
    rows = tree.withColumn("rest", F.slice("shapes", at + 1, F.greatest(F.size("shapes") - at, F.lit(0))))
    open_ = rows.where(F.size("rest") > 0)
    ends = open_.groupBy(*parent).agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    # What the first and the last in order begin with, all between them begin with.
    unlike = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a != b, F.lit(True))), True)
    shared = F.when(unlike > 0, unlike - 1).otherwise(F.least(F.size("low"), F.size("high"))).cast("int")
    ends = ends.select(*parent, shared.alias("shared"), "all_bad", "all_labelled").where("shared > 0")
    done = open_.join(ends, parent, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    purity = F.aggregate(
        F.slice("rest", 1, F.col("shared")), F.col("purity"), lambda p, _: (F.col("all_bad") + strength * p) / (F.col("all_labelled") + strength)
    )
    done = done.withColumns({"purity": purity, "template": F.concat("template", F.slice("rest", 1, F.col("shared")))})
    return done.select(*tree.columns).unionByName(rows.where(F.size("rest") == 0).select(*tree.columns))


def _grown(tree: DataFrame, wide: int, strength: float, errors: float) -> DataFrame:
    """The tree with one more segment of its templates, and the purity of the nodes it leads to."""
    parent = ["host", "template"]
    rows = tree.withColumn("part", F.get("shapes", F.size("template")))
    children = rows.where(F.col("part").isNotNull()).groupBy(*parent, "purity", "part").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "labelled")))
    fans = children.groupBy(*parent).agg(F.count("*").alias("fan"), F.sum("n").alias("of"))
    rare = (F.col("fan") > wide) & (F.col("n") * wide < F.col("of"))
    named = children.join(fans, parent).withColumn("name", F.when(rare, "*").otherwise(F.col("part")))
    nodes = named.groupBy(*parent, "purity", "name").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    # An unlabelled child shows no rate of its own; it stays with its parent's purity, apart from the others.
    rate = (F.col("bad") + 1) / (F.col("labelled") + 2)
    order = Window.partitionBy(*parent).orderBy((F.col("labelled") == 0), "rate", "name")
    nodes = nodes.withColumns({"rate": rate, "spread": rate * (1 - rate) / (F.col("labelled") + 2)})
    apart = (
        F.lag("rate").over(order).isNull() | (F.col("labelled") == 0)
        | (F.abs(F.col("rate") - F.lag("rate").over(order)) > errors * F.sqrt(F.col("spread") + F.lag("spread").over(order)))
    )
    nodes = nodes.withColumn("new", apart.cast("int")).withColumn("branch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = nodes.groupBy(*parent, "purity", "branch").agg(
        F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.array_sort(F.collect_list("name")).alias("names"),
    )
    judged = merged.select(*parent, "names", ((F.col("bad") + strength * F.col("purity")) / (F.col("labelled") + strength)).alias("node"))
    labels = F.when(F.size("names") == 1, F.get("names", F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join("names", "|"), F.lit(")")))
    of_name = judged.select(*parent, F.explode("names").alias("name"), labels.alias("label"), "node")
    of_part = named.select(*parent, "part", "name").join(of_name, [*parent, "name"]).drop("name")
    grown = rows.join(of_part, [*parent, "part"], "left")
    return grown.select(
        "host", "shapes", "n", "bad", "labelled", F.coalesce("node", "purity").alias("purity"),
        F.when(F.col("label").isNull(), F.col("template")).otherwise(F.array_append("template", F.col("label"))).alias("template"),
    )


def judge(pages: DataFrame, *, url: str = "url", rules=RULES, reject_at: float = REJECT_AT) -> DataFrame:
    """All rows, without the columns it names itself, and host, path, rule, template, purity, verdict."""
    host, path = host_path(F.col(url))
    rows = pages.drop("host", "path", "rule", "by_rule", "shapes", "template", "purity", "verdict") if url != "host" else pages
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "shapes": shapes(F.col("path"))})
    bad = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    found = templates(rows.select("host", "shapes", bad.alias("bad")))
    judged = rows.join(found, ["host", "shapes"], "left")
    learned = F.when(F.col("purity") >= reject_at, "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("by_rule", learned)).drop("by_rule", "shapes")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
