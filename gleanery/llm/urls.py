"""URL filters: host and path rules, and a tree of path templates for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .common import LOWER, UPPER, small


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _part(url: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: str) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return _part(url, 2)


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class TemplateTree:
    """A branch keeps its own segment with ``least`` rows and a blocked rate that differs from its siblings' by ``z`` standard
    errors, whatever its share; the other branches merge into a wildcard. Rates lean on the parent's with the weight of ``prior``
    labelled rows. The tree is as deep as the paths."""

    least: int = 5
    z: float = 2.0
    prior: float = 2.0
    cutoff: float = 0.5


def _differs(how: TemplateTree) -> Column:
    """Two-proportion test of a branch against its siblings."""
    rest_known, rest_blocked = F.col("node_known") - F.col("known"), F.col("node_blocked") - F.col("blocked")
    rate = F.col("node_blocked") / F.col("node_known")
    error = F.sqrt(rate * (1 - rate) * (1 / F.col("known") + 1 / rest_known))
    gap = F.abs(F.col("blocked") / F.col("known") - rest_blocked / rest_known)
    return F.when((F.col("known") > 0) & (rest_known > 0), gap > how.z * error).otherwise(False)


def template_verdicts(paths: DataFrame, how: TemplateTree = TemplateTree()) -> DataFrame:
    """(host, path, template, purity) for rows (host, path, n, known, blocked), unique by host and path.

    One pass per level of the tree: counts per branch, which branches stay, the smoothed blocked rate of every node. A path
    leaves the loop where its segments end. Nodes are only ever summed, so a host with most of the rows is spread like any other.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    totals = paths.agg(F.sum("known").alias("known"), F.sum("blocked").alias("blocked"), F.max(F.size(parts)).alias("deep")).first()
    overall = totals["blocked"] / totals["known"] if totals["known"] else 0.0
    rows = paths.select("*", parts.alias("parts"), F.lit("").alias("template"), F.lit(float(overall)).alias("purity"))

    def smoothed(rows: DataFrame) -> DataFrame:
        nodes = rows.groupBy("host", "template").agg(F.sum("known").alias("node_known"), F.sum("blocked").alias("node_blocked"))
        met = rows.join(small(nodes), ["host", "template"])
        rate = (F.col("node_blocked") + how.prior * F.col("purity")) / (F.col("node_known") + how.prior)
        return cut(met.withColumn("purity", rate).drop("node_known", "node_blocked"))

    rows, done = smoothed(rows), []
    for level in range(totals["deep"] or 0):
        going = F.size("parts") > level
        # Paths that end at a node are a branch of it.
        done.append(smoothed(rows.filter(~going)))
        rows = rows.filter(going).withColumn("branch", F.get("parts", F.lit(level)))
        branches = rows.groupBy("host", "template", "branch").agg(*[F.sum(c).alias(c) for c in ("n", "known", "blocked")])
        nodes = branches.groupBy("host", "template").agg(*[F.sum(c).alias(f"node_{c}") for c in ("n", "known", "blocked")])
        stays = branches.join(nodes, ["host", "template"]).filter((F.col("n") >= how.least) & _differs(how)).select("host", "template", "branch", F.lit(True).alias("stays"))
        met = rows.join(small(stays), ["host", "template", "branch"], "left")
        step = F.when(F.col("stays"), F.concat(F.lit("/"), "branch")).otherwise(F.lit("/*"))
        rows = smoothed(met.withColumn("template", F.concat("template", step)).drop("stays", "branch"))
    out = smoothed(rows)
    for more in done:
        out = out.unionByName(more)
    return out.select("host", "path", "template", "purity")


def judge_urls(pages: DataFrame, rules: list[Rule], how: TemplateTree = TemplateTree()) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row for each input row.

    Pages that a rule fits are the labelled rows of the tree; the others get its verdict, block where the smoothed blocked rate
    of their template exceeds the cutoff. A null url, or one without ``://``, has an empty host and path and the
    rate of all such pages. Repeated rows each come back; no labelled rows at all means allow; an empty table gives an empty
    result; columns other than page_id and url are not read.
    """
    name, verdict = rule_of(rules, F.col("host"), F.col("path"))
    split = pages.select(F.col("page_id"), host_of("url").alias("host"), path_of("url").alias("path"))
    ruled = cut(split.withColumn("rule", name).withColumn("verdict", verdict))
    paths = ruled.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count("verdict").alias("known"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    found = small(template_verdicts(cut(paths), how))
    learned = F.when(F.col("purity") > how.cutoff, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "template", "purity")
