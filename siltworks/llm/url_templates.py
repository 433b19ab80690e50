"""URL filter by a tree of path templates: for each host, path segments that vary become wildcards, branches
that are statistically alike are merged, and templates go whose labelled urls are blocked too purely.

Labels come from rules for hosts and path prefixes; the tree carries them to urls that no rule fits. All is
DataFrame operations; there is one pass for each level, over the urls that reach it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Host and path, and what becomes of urls there.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class Tree:
    """A segment stays a branch of its own if at least `support` urls of the host have it at its node. prior:
    labels that the node above counts for. A template is rejected if its smoothed share of blocked labels is `purity` or
    more. Two neighbours are merged if both have `labelled` labels, their shares of blocked ones don't differ by
    z standard errors, and what lies below them is alike in depth (by half a segment) and in digits (by a fifth of urls)."""

    support: int = 10
    prior: float = 5.0
    purity: float = 0.8
    labelled: int = 5
    z: float = 1.96


def lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    """Host and path of a url; without :// both are empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return lower_ascii(host), path


def by_rules(host, path, rules=RULES):
    """The longest rule (host and path written together) that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape(segment):
    """What kind of segment it is: runs of digits, of hex digits with one among them, and of letters."""
    s = F.regexp_replace(segment, r"\p{L}+", "a")
    return F.regexp_replace(F.regexp_replace(s, r"[0-9]+", "0"), r"(a0|0a)[a0]*", "h")


def labelled_tree(pages: DataFrame, rules=RULES, tree: Tree = Tree()) -> DataFrame:
    """page_id, host, path, rule, rule_verdict, template, purity of each row of pages (page_id, url). template:
    the node in the tree of its host, merged branches under the name of the first; purity: the smoothed share
    of blocked labels there. The tree is as deep as the deepest path. Null and odd urls have an empty host, as a host like others. A host's urls meet
    only in counts, which are summed before they are shuffled."""
    n0, n1, n2, n3, n4, n5, n6, n7 = fresh(pages, "segments", "node", "n", "blocked", "allowed", "segment", "label", "purity_")
    host, path = parts(F.col("url"))
    x = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    x = x.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    x = x.withColumn(n0, F.filter(F.split("path", "/"), lambda s: s != ""))
    x = materialise(x, "url-rows")
    count = (F.count(F.lit(1)).alias(n2), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias(n3), F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias(n4))
    total = x.agg(*count, F.max(F.size(n0)).alias("depth")).first()
    base = (total[n3] + 1) / (total[n3] + total[n4] + 2)

    def smoothed(above):
        return (F.col(n3) + tree.prior * above) / (F.col(n3) + F.col(n4) + tree.prior)

    hosts = x.groupBy("host").agg(*count).select("host", smoothed(F.lit(base)).alias(n7))
    x = x.join(hosts, "host").withColumn(n1, F.lit(""))
    ended = [x.where(F.size(n0) == 0)]
    for level in range(total.depth or 0):
        x = x.where(F.size(n0) > level).withColumn(n5, F.element_at(n0, F.lit(level + 1)))
        kids = x.groupBy("host", n1, n5).agg(*count)
        enough = F.col(n2) >= tree.support
        own = materialise(kids.where(enough).select("host", n1, n5, F.concat(F.lit("="), n5).alias("own_")), "url-own")
        kinds = kids.where(~enough).groupBy("host", n1, shape(F.col(n5)).alias("kind_")).agg(F.sum(n2).alias(n2))
        kinds = kinds.where(enough).select("host", n1, "kind_", F.concat(F.lit("*"), "kind_").alias("wild_"))
        x = x.join(own, ["host", n1, n5], "left").withColumn("kind_", shape(F.col(n5))).join(kinds, ["host", n1, "kind_"], "left")
        x = x.withColumn(n6, F.coalesce("own_", "wild_", F.lit("*"))).drop("own_", "wild_", "kind_", n5)
        x = materialise(x, "url-rows")
        # Neighbours among the labelled branches of a node, by their share of blocked labels, become one where they are alike.
        below = F.size(n0) - (level + 1)
        digits = F.when(F.get(n0, F.lit(level + 1)).rlike("[0-9]"), 1.0).otherwise(0.0)
        branch = x.groupBy("host", n1, n6, n7).agg(*count, F.avg(below).alias("below_"), F.avg(F.when(below > 0, digits).otherwise(0.0)).alias("digits_"))
        branch = materialise(branch, "url-branches")
        labels = F.col(n3) + F.col(n4)
        bare = branch.where(labels == 0).select("host", n1, n6, F.col(n6).alias("to_"), n3, n4, F.col(n7).alias("above_"))
        branch = branch.where(labels > 0)
        raw = F.try_divide(F.col(n3), F.col(n3) + F.col(n4))
        side = Window.partitionBy("host", n1).orderBy(raw, n6)
        last = lambda c: F.lag(c).over(side)
        m, k = F.col(n3) + F.col(n4), last(n3) + last(n4)
        pooled = (F.col(n3) + last(n3) + 1) / (m + k + 2)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), m) + F.try_divide(F.lit(1.0), k)))
        alike = (
            (m >= tree.labelled) & (k >= tree.labelled) & (F.abs(raw - last(raw)) < tree.z * error)
            & (F.abs(F.col("below_") - last("below_")) <= 0.5) & (F.abs(F.col("digits_") - last("digits_")) <= 0.2)
        )
        branch = branch.withColumn("cut_", F.when(F.coalesce(alike, F.lit(False)), 0).otherwise(1)).withColumn("run_", F.sum("cut_").over(side))
        run = Window.partitionBy("host", n1, "run_")
        branch = branch.select("host", n1, n6, F.min(n6).over(run).alias("to_"), *(F.sum(c).over(run).alias(c) for c in (n3, n4)), F.col(n7).alias("above_"))
        branch = branch.unionByName(bare).withColumn("p_", smoothed(F.col("above_"))).select("host", n1, n6, "to_", "p_")
        x = x.join(materialise(branch, "url-branches"), ["host", n1, n6])
        x = x.withColumn(n1, F.concat(F.col(n1), F.lit("/"), F.col("to_"))).withColumn(n7, F.col("p_")).drop("to_", "p_", n6)
        ended.append(x.where(F.size(n0) == level + 1))
    out = (part.select("page_id", "host", "path", "rule", "rule_verdict", F.col(n1).alias("template"), F.col(n7).alias("purity")) for part in ended)
    return reduce(DataFrame.unionByName, out)


def url_verdicts(pages: DataFrame, rules=RULES, tree: Tree = Tree()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: the rule's verdict, or where none fits `block` if
    the template's purity is tree.purity or more, else `allow`. A row per row of pages."""
    x = labelled_tree(pages, rules, tree)
    method = F.when(F.col("purity") >= tree.purity, F.lit("block")).otherwise(F.lit("allow"))
    return x.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "template", F.round("purity", 9).alias("purity"))
