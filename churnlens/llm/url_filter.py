"""URL filter: a path-template tree per host.

1. A URL is cut into host and path; the longest rule that fits decides where
   there is one, and labels the URL for the rest.
2. Id-like path segments become wildcards (``*``, ``*.html``).  Then, at each
   node of the tree, a segment that is rare among many siblings becomes a
   wildcard too.  What is left is the URL's template.
3. Labelled branches of one host and shape whose block rates do not differ
   significantly (two-proportion z-test against the pooled rate) are merged
   and share their labels.  A branch without labels has no rate to test and
   stays on its own.
4. A template's purity is its labelled block rate, smoothed towards the rate
   of its shape over all hosts and that one towards the overall rate; without
   labels it is that smoothed rate of its shape.
   Templates of purity ``reject_at`` or more are blocked.

Every step groups distinct (host, path template) rows with counts, so a host
that holds a third of all URLs costs one row per template and map task.

Defined results: null or a URL without ``://`` has empty host and path, fits
no rule and is judged as the template of those; repeated rows get the same
result; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.frames import documents, written

#: (rule, verdict); a rule is host and path in one, as in ``example.net/en/``.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ID_LIKE = r"^([0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,36}|[^.]*[0-9]{3,}[^.]*)(\.[A-Za-z0-9]{1,5})?$"
MANY_CHILDREN = 16
RARE_SHARE = 0.01
MERGE_Z = 1.96
SMOOTHING = 4.0
REJECT_AT = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null.  The list is
    the user's own and short; each row is compared with all of it."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block")):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(text)).otherwise(found)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def generalised(path: Column) -> Column:
    """Path segments, id-like ones as wildcards."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.when(
        s.rlike(ID_LIKE), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z0-9]{1,5})?$", 0))).otherwise(s))


def templates(paths: DataFrame, many: int, rare: float) -> DataFrame:
    """Adds template and shape to each distinct generalised path: segments
    that are rare among many siblings become wildcards.  The nodes of all
    levels are counted at once, as (host, prefix, segment) rows."""
    key = ["host", "level", "prefix", "seg"]
    steps = paths.select("*", F.posexplode("parts").alias("level", "seg"))
    steps = steps.withColumn("prefix", F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/"))
    children = steps.groupBy(*key).agg(F.sum("n").alias("c"))
    nodes = children.groupBy(*key[:3]).agg(F.count(F.lit(1)).alias("width"), F.sum("c").alias("all")).where(F.col("width") > many)
    few = children.join(nodes, key[:3]).where((F.col("c") < rare * F.col("all")) & ~F.col("seg").startswith("*"))
    few = written(few.select(*key, F.lit(True).alias("few")), "url-rare")
    seg = F.when(F.col("few"), F.lit("*")).otherwise(F.col("seg"))
    steps = steps.join(few, key, "left").withColumn("seg", seg)
    tree = steps.groupBy("host", "parts", "n", "labelled", "blocked").agg(F.sort_array(F.collect_list(F.struct("level", "seg"))).alias("t"))
    kind = F.transform("t", lambda x: F.when(x["seg"].startswith("*") | (x["seg"] == ""), x["seg"]).otherwise("+"))
    return tree.select(
        "host", "parts", "n", "labelled", "blocked",
        F.concat(F.lit("/"), F.array_join(F.transform("t", lambda x: x["seg"]), "/")).alias("template"),
        F.concat(F.lit("/"), F.array_join(kind, "/")).alias("shape"))


def judged(tree: DataFrame, z: float, smoothing: float) -> DataFrame:
    """(host, template, merged, purity) of each template."""
    nodes = tree.groupBy("host", "shape", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    nodes = written(nodes, "url-templates")
    pooled = nodes.groupBy("host", "shape").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    shapes = nodes.groupBy("shape").agg(F.sum("labelled").alias("shape_labelled"), F.sum("blocked").alias("shape_blocked"))
    overall = nodes.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).first()
    rate = ((overall["b"] or 0) + 1.0) / ((overall["l"] or 0) + 2.0)
    p = F.col("all_blocked") / F.greatest("all_labelled", F.lit(1))
    gap = F.abs(F.col("blocked") / F.greatest("labelled", F.lit(1)) - p)
    similar = (F.col("labelled") > 0) & (gap <= z * F.sqrt(p * (1 - p) / F.greatest("labelled", F.lit(1))))
    prior = (F.col("shape_blocked") + smoothing * rate) / (F.col("shape_labelled") + smoothing)
    tested = written(nodes.join(pooled, ["host", "shape"]).withColumn("merged", similar), "url-tested")
    sums = tested.where("merged").groupBy("host", "shape").agg(F.sum("labelled").alias("their_labelled"), F.sum("blocked").alias("their_blocked"))
    out = tested.join(sums, ["host", "shape"], "left").join(shapes, "shape")
    blocked = F.when(F.col("merged"), F.col("their_blocked")).otherwise(F.col("blocked"))
    labelled = F.when(F.col("merged"), F.col("their_labelled")).otherwise(F.col("labelled"))
    return out.select("host", "template", "merged", ((blocked + smoothing * prior) / (labelled + smoothing)).alias("purity"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None,
               many: int = MANY_CHILDREN, rare: float = RARE_SHARE, z: float = MERGE_Z, smoothing: float = SMOOTHING,
               reject_at: float = REJECT_AT) -> DataFrame:
    """(id, host, path, rule, verdict, template, merged, purity) of every row."""
    host, path = url_parts(F.col(f"`{url_col}`").cast("string"))
    base = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    rule, says = matched_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    base = base.withColumns({"rule": rule, "says": says, "parts": generalised(F.col("path"))})
    paths = base.groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("n"), F.count("says").alias("labelled"), F.count(F.when(F.col("says") == "block", 1)).alias("blocked"))
    tree = written(templates(written(paths, "url-paths"), many, rare), "url-tree")
    verdicts = tree.select("host", "parts", "template").join(judged(tree, z, smoothing), ["host", "template"])
    out = base.join(written(verdicts, "url-verdicts"), ["host", "parts"], "left")
    method = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("says", method).alias("verdict"),
                      "template", "merged", "purity")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    return url_filter(documents(spark, sf_dir, "pages"))
