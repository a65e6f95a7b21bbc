"""URL verdicts from rules and, where none fits, from a tree of path templates, with built-in functions only.

A page's host and path are the way from the root of a host's tree to a leaf.  Runs of digits in a path
segment are a wildcard at once; pages that then share host and path are one row, with how many pages
there are and how many of them rules block and allow, so the tree is built from a table of shapes.  Level
after level, each node looks at its branches:

* a branch that few of the node's pages take, where there are many branches, becomes the wildcard ``*``;
* branches whose pages go on alike are merged into ``+`` with the kind of what mostly follows (end, number,
  number with letters, word, other): their shares of these kinds, and of blocked among labelled pages
  where they have any, lie within Hoeffding's bound of the shares of all the node's branches with that
  leading kind, each branch being compared with these together and never with each other branch;
* others stay.

Leaves with equal host and template are one template.  It is rejected if its smoothed purity, the share
of blocked pages among its labelled ones drawn towards the share among all labelled pages, is high.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree's levels; what follows in a path is one more wildcard, so that rounds are bounded.
LEVELS = 8
#: A branch is variable if its node has more than MANY branches and less than one page in MANY takes it.
MANY = 16
#: Confidence of the comparison of branches.
ALPHA = 0.05
SPREAD = math.sqrt(0.5 * math.log(2 / ALPHA))
#: Pages that the overall share counts for, and the purity at which a template is rejected.
PSEUDO, REJECT = 20.0, 0.9
#: Kinds of what follows a branch, as patterns of a segment whose digits are wildcards; others are "other".
KINDS = (("end", "^$"), ("number", "^#$"), ("coded", "#"), ("word", r"^[\p{L}_-]+$"))


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of ``url``; both empty for a null or one without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    """Segments of ``path``, digits as ``#``; those beyond the tree's levels as one ``**``."""
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/", -1), lambda s: s != "")
    return F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS), F.array(F.lit("**")))).otherwise(parts)


def _kind(segment: Column) -> Column:
    kind = F.lit("other")
    for name, pattern in reversed(KINDS):
        kind = F.when(segment.rlike(pattern), name).otherwise(kind)
    return kind


def _level(rows: DataFrame, at: int) -> DataFrame:
    """``rows`` (host, template, parts, n, ...) with the branch at place ``at`` added to their template."""
    names = [name for name, _ in KINDS] + ["other"]
    segment = lambda i: F.coalesce(F.get("parts", F.lit(i)), F.lit(""))
    going = rows.where(F.size("parts") > at).withColumn("branch", segment(at)).withColumn("kind", _kind(segment(at + 1)))
    counts = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in names]
    counts += [F.sum("blocked").alias("blocked"), F.sum(F.col("blocked") + F.col("allowed")).alias("labelled")]
    branches = going.groupBy("host", "template", "branch").agg(F.sum("n").alias("branch_n"), *counts)
    lead = F.lit(names[-1])
    for k in reversed(names):
        lead = F.when(F.col(k) == F.greatest(*names), k).otherwise(lead)
    branches = branches.withColumn("lead", lead)
    figures = ["branch_n", *names, "blocked", "labelled"]
    groups = branches.groupBy("host", "template", "lead").agg(F.count(F.lit(1)).alias("of"), *[F.sum(c).alias(f"all_{c}") for c in figures])
    node = W.partitionBy("host", "template")  # a row for each leading kind
    groups = groups.withColumn("node_n", F.sum("all_branch_n").over(node)).withColumn("node_of", F.sum("of").over(node))

    def near(part: str, whole: str) -> Column:
        """Whether the branch's share of ``part`` in ``whole`` is within the bound of its group's."""
        own, of = F.col(whole), F.col(f"all_{whole}")
        return F.abs(F.col(part) / own - F.col(f"all_{part}") / of) <= SPREAD * (1 / F.sqrt(own) + 1 / F.sqrt(of))

    alike = F.when(F.col("labelled") == 0, True).otherwise(near("blocked", "labelled"))
    for k in names:
        alike = alike & near(k, "branch_n")
    variable = (F.col("node_of") > MANY) & (F.col("branch_n") * MANY < F.col("node_n"))
    token = F.when(variable, "*").when((F.col("of") > 1) & alike, F.concat(F.lit("+"), "lead")).otherwise(F.col("branch"))
    tokens = branches.join(groups, ["host", "template", "lead"]).select("host", "template", "branch", token.alias("token"))
    on = going.join(tokens, ["host", "template", "branch"]).withColumn("template", F.concat("template", F.lit("/"), F.col("token")))
    return on.select(rows.columns)


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, parts, n, blocked, allowed), one row each, with their ``template``.

    A round for each level of the tree that has branches; a round's rows are stored, as the next reads them
    twice, and those whose path has ended take no further part.
    """
    rows, out = shapes.withColumn("template", F.lit("")), None
    deepest = shapes.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    for at in range(deepest):
        ended = rows.where(F.size("parts") <= at)
        out = ended if out is None else out.union(ended)
        rows = stage(_level(rows, at), "level")
    return rows if out is None else out.union(rows)


def rejected(placed: DataFrame, pseudo: float = PSEUDO, reject: float = REJECT) -> DataFrame:
    """host, template, purity of the templates of ``placed`` that are rejected."""
    by = placed.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    all_blocked, all_labelled = placed.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum(F.col("blocked") + F.col("allowed")), F.lit(0))).first()
    share = all_blocked / all_labelled if all_labelled else 0.0
    labelled = F.col("blocked") + F.col("allowed")
    return by.withColumn("purity", (F.col("blocked") + pseudo * share) / (labelled + pseudo)).where(
        (F.col("blocked") > 0) & (F.col("purity") >= reject)
    )


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, pseudo: float = PSEUDO, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict and template for each row of ``pages`` (page_id, url).

    The longest fitting rule decides (equal lengths: the later by code point); else a rejected template
    blocks and any other allows.  A null url, or one without ``://``, has empty host and path and fits no
    rule; an empty path starts with no rule's path; repeated rows are pages of their own; an empty table
    gives an empty result; columns other than page_id and url are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), shape(F.col("path")).alias("parts"))
    one = lambda v: F.count(F.when(F.col("by_rule") == v, 1)).alias({"block": "blocked", "allow": "allowed"}[v])
    shapes = stage(rows.groupBy("host", "parts").agg(F.count(F.lit(1)).alias("n"), one("block"), one("allow")), "shapes")
    placed = stage(templates(shapes).select("host", "parts", "template", "blocked", "allowed"), "templates")
    bad = rejected(placed, pseudo, reject).select("host", "template", F.lit(True).alias("bad"))
    fates = placed.join(bad, ["host", "template"], "left").select("host", "parts", "template", F.coalesce("bad", F.lit(False)).alias("bad"))
    # One row per shape; a shape that many pages share is split by AQE, as nothing above needs its rows together.
    found = rows.join(stage(fates, "fates"), ["host", "parts"], "left")
    own = F.when(F.col("bad"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "template")


def allowed_pages(pages: DataFrame, **options) -> DataFrame:
    """The rows of ``pages`` with an allowed url; rows of equal page_id must have equal urls."""
    good = judged(pages, **options).where("verdict = 'allow'").select(F.col("page_id").alias("_good_page")).distinct()
    return pages.join(good, F.col("page_id").eqNullSafe(F.col("_good_page")), "left_semi")
