"""URL rules, and trust spread over the host graph where no rule speaks.

Host edges are the distinct pairs (host of the page, host of a link on it). Two walks
run over them, both personalised PageRank with the damping ``DAMPING``:

* trust starts at hosts whose pages an allow rule names, and follows the links;
* distrust starts at hosts whose pages a block rule names, and follows the links
  backwards: who links to blocked hosts is distrusted.

A host is blocked if its distrust reaches ``THRESHOLD`` of its uniform share and
exceeds its trust. Scores are whole units (``UNITS`` in all), each step divides
without remainder going astray between engines: the verdict does not depend on the
order of additions, so it is the same on every run.

The walks go on until what is still missing from all scores together is a small part of
one uniform share (``PARTS``): from scores of nothing each round adds the mass of paths one
link longer, so scores only grow, and what a round adds is the difference of two sums.
After a round that added ``a``, less than ``a * DAMPING / (100 - DAMPING)`` is missing.
With a number of ``rounds`` they start at the seeds and stop there, as the SQL does.

Everything is DataFrame work. Edges are distinct before they meet scores; sums per
host are combined before the shuffle, and the side of the scores is unique by host,
so a hub's edges can be split over tasks. Scores are written after each round, which
cuts the lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stage

UNITS = 10**15
DAMPING = 85  # hundredths
ROUNDS = 10  # of walks that are to stop before they converge
PARTS = 1000  # of a uniform share: what the last round may add, all hosts together
THRESHOLD = 1  # times the uniform share of a host


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
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and scheme-relative targets of links.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; '' without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def matched(rules: tuple[Rule, ...], host: Column, path: Column, what) -> Column:
    """``what(rule)`` of the longest rule that fits; null if none does.

    Rules are a short list of the caller's; ties in length go to the first.
    """
    found = F.lit(None).cast("string")
    # the rule looked at last is asked first
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(
            path, F.lit(rule.path)
        )
        found = F.when(fits, F.lit(what(rule))).otherwise(found)
    return found


def spread(
    spark: SparkSession,
    edges: DataFrame,
    seeds: DataFrame,
    rounds: int | None,
    units: int = UNITS,
    share: int = 0,
) -> DataFrame:
    """(host, score) by personalised PageRank from ``seeds`` over (src, dst) edges.

    ``rounds`` of None: until a round adds at most ``share / PARTS`` to all scores
    together. Mass at hosts without links out returns to nobody. No seeds: no rows.
    """
    n = seeds.count()
    if not n:
        return seeds.select("host", F.lit(0).cast("long").alias("score"))
    start = seeds.select("host", F.lit(units // n).alias("score"))
    out = edges.groupBy("src").agg(F.count("*").alias("links"))
    weighted = stage(spark, edges.join(out, "src"), "edges")
    back = start.select("host", F.expr(f"score * {100 - DAMPING} div 100").alias("score"))

    def step(scores: DataFrame) -> DataFrame:
        sent = weighted.join(scores, weighted["src"] == scores["host"]).select(
            F.col("dst").alias("host"), F.expr(f"(score * {DAMPING} div 100) div links").alias("score")
        )
        return sent.filter("score > 0").unionByName(back).groupBy("host").agg(F.sum("score").alias("score"))

    if rounds is not None:
        scores = start
        for _ in range(rounds):
            scores = stage(spark, step(scores), "scores")
        return scores
    scores, total, added = back, n * (units // n * (100 - DAMPING) // 100), units
    while added * PARTS > share:
        scores = stage(spark, step(scores), "scores")
        before, total = total, scores.agg(F.sum("score")).first()[0]
        added = total - before
    return scores


def judge(
    spark: SparkSession,
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    rounds: int | None = ROUNDS,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust.

    ``rounds`` of None: the walks go on until they converge (see :func:`spread`).

    A null url or one without ``://`` has an empty host and path, fits no rule and
    is allowed. Null html has no links. Repeated rows are judged alike, each. An
    empty table gives no rows. Links of a host to itself are no edges.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    ruled = urls.select(
        "page_id",
        "host",
        "path",
        matched(rules, F.col("host"), F.col("path"), lambda r: r.name).alias("rule"),
        matched(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("by_rule"),
    )
    links = F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))
    edges = stage(
        spark,
        pages.filter(F.contains(F.col("html"), F.lit("//")))
        .select(host.alias("src"), F.explode(F.array_distinct(links)).alias("to"))
        .select("src", F.translate("to", _UPPER, _LOWER).alias("dst"))
        .filter("src <> dst and src <> '' and dst <> ''")
        .distinct(),
        "links",
    )
    # A hot host meets the grouping as one row for each task.
    seeds = stage(
        spark,
        ruled.filter("by_rule is not null and host <> ''").groupBy("host", "by_rule").agg(F.count("*").alias("n")),
        "seeds",
    )
    blocked = seeds.filter("by_rule = 'block'").select("host")
    trusted = seeds.filter("by_rule = 'allow'").select("host").join(blocked, "host", "left_anti")
    hosts = (
        edges.select(F.col("src").alias("host"))
        .union(edges.select("dst"))
        .union(seeds.select("host"))
        .distinct()
        .count()
    )
    uniform = UNITS // max(hosts, 1)
    share = UNITS * threshold // max(hosts, 1)
    trust = spread(spark, edges, trusted, rounds, share=uniform)
    backwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = spread(spark, backwards, blocked, rounds, share=uniform)
    scores = (
        trust.select("host", F.col("score").alias("trust"), F.lit(0).cast("long").alias("distrust"))
        .unionByName(
            distrust.select("host", F.lit(0).cast("long").alias("trust"), F.col("score").alias("distrust"))
        )
        .groupBy("host")
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )
    by_method = F.when(
        (F.col("distrust") >= share) & (F.col("distrust") > F.col("trust")), F.lit("block")
    ).otherwise(F.lit("allow"))
    return ruled.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", by_method).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"),
        F.coalesce("distrust", F.lit(0)).alias("distrust"),
    )


def op2(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The verdict of every page, by walks that have converged."""
    return judge(spark, pages, rounds=None).select("page_id", "host", "path", "rule", "verdict")
