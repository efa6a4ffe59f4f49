"""URL filters: rules first, then trust and distrust spread over the link graph of hosts.

Trust flows along links from trusted hosts by personalised PageRank; distrust flows against them from blocked
hosts, since a page that links to bad ones is suspect. A url that no rule judges gets its host's verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_tables, materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DAMPING, ROUNDS = 0.85, 20
#: Rounds between two tables that cut the lineage.
CUT = 5
#: A host is a seed if more than this share of its pages have the verdict by rule.
SEED_SHARE = 0.5
#: A host is blocked if distrust is over this share of its trust and distrust together.
BLOCK_AT = 0.5


def host_of(url: str) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z lowered; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"), "/", 1)).otherwise("")
    host = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the longest rule that fits, or null."""
    expr = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        expr = F.when(fits, rule.name).otherwise(expr)
    return expr


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank (host, score) over edges (src, dst, weight: the share of src's links) from seeds (host, weight).

    A step is one join with the edges and one sum by host, both over hosts, not pages; sums are partial
    aggregates. Every CUT steps the scores become a table in the shared folder. Without edges the seeds keep their
    scores but for what would have flowed on.
    """
    spark = edges.sparkSession
    rounds = 0 if edges.isEmpty() else rounds
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    start = materialize(seeds.select("host", (F.col("weight") / (total or 1.0)).alias("score")), "seeds")
    scores, old = start if rounds else start.withColumn("score", F.col("score") * (1 - DAMPING)), None
    for step in range(1, rounds + 1):
        moved = edges.join(scores, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("weight") * F.col("score") * DAMPING).alias("score"))
        kept = start.select("host", (F.col("score") * (1 - DAMPING)).alias("score"))
        scores = kept.union(moved).groupBy("host").agg(F.sum("score").alias("score"))
        if step % CUT == 0 or step == rounds:
            scores = materialize(scores, "scores")
            if old is not None:
                drop_tables(spark, [old])
            old = scores
    return scores


def links(pages: DataFrame) -> DataFrame:
    """(src, dst): a row for each link of pages (host, html) to another host."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?((?:https?:)?//[^/?#\"'\s<>]+)"), 1)
    out = pages.where(F.instr("html", "//") > 0).select(F.col("host").alias("src"), F.explode(found).alias("link"))
    url = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return out.select("src", url.alias("url")).select("src", host_of("url").alias("dst")).where("src <> dst and src <> '' and dst <> ''")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of pages.

    Null urls and urls without :// have an empty host and path and no rule. Null html has no links. A host that
    neither trust nor distrust reaches is allowed. Rows with equal or null ids stay separate rows. An empty table
    gives an empty result. Urls and pages of any length are read whole. Other columns, whatever their names, are not read.
    """
    verdicts = {r.name: r.verdict for r in rules}
    given = F.create_map(*[F.lit(x) for pair in verdicts.items() for x in pair])
    split = pages.select("page_id", "html", host_of("url").alias("host"), path_of("url").alias("path"))
    split = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("given", given[F.col("rule")])
    urls = split.drop("html")

    share = urls.groupBy("host").agg(
        (F.count_if(F.col("given") == "allow") / F.count(F.lit(1))).alias("allow"), (F.count_if(F.col("given") == "block") / F.count(F.lit(1))).alias("block")
    )
    share = materialize(share.where("host <> ''"), "hosts")
    linked = materialize(links(split).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "links")
    out = linked.groupBy("src").agg(F.sum("n").alias("total"))
    forward = materialize(linked.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight")), "forward")
    into = linked.groupBy("dst").agg(F.sum("n").alias("total"))
    backward = materialize(linked.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("weight")), "backward")
    trust = spread(forward, share.where(F.col("allow") > SEED_SHARE).select("host", F.col("allow").alias("weight")))
    distrust = spread(backward, share.where(F.col("block") > SEED_SHARE).select("host", F.col("block").alias("weight")))
    both = trust.select("host", F.col("score").alias("t"), F.lit(0.0).alias("d")).union(distrust.select("host", F.lit(0.0), "score"))
    hosts = both.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    blocked = materialize(hosts.where(F.col("d") > BLOCK_AT * (F.col("t") + F.col("d"))).select(F.col("host").alias("_host")), "blocked")

    known = urls.join(blocked, F.col("host") == F.col("_host"), "left")
    by_host = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return known.select("page_id", "host", "path", "rule", F.coalesce("given", by_host).alias("verdict"))


def op9(pages: DataFrame) -> DataFrame:
    return judged(pages)
