"""URL filters with trust and distrust spread over the host graph (operator 10).

A url is judged by the longest rule that fits it.  Urls without a rule are
judged by their host: personalised PageRank spreads trust from trusted seeds
along links, and distrust from blocked seeds against them (who links to a
blocked host is suspect).  A host is blocked if its distrust reaches
``floor`` shares of an even spread and ``ratio`` times its trust.

Seeds follow from the rules: a host most of whose pages a rule blocks is a
blocked seed, one with allowed and no blocked pages a trusted seed.  Links are
absolute or protocol-relative href and src values; links within a host are not
edges.  Edges are summed by host pair before anything else, and ranks move by
joins, so a host with any number of pages or links is never one task's work.

Defined results: host and path of a null url or one without ``://`` are empty
and such urls are allowed; a null html has no links; repeated rows are judged
one by one, repeated links count; without edges ranks stay at the seeds; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.llm.common import discard, materialise, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    rule: str  # host, a slash, the rest of the path
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


RULES = (UrlRule("net/", False), UrlRule("example.net/en/", True), UrlRule("example.com/de/", False), UrlRule("org/fr/", True))


def host_of(after: Column) -> Column:
    """Host at the start of what follows ``//``."""
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, F.lit("://")) > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")


def with_rule(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and rule_allows."""
    rest = F.coalesce(_rest(F.col(url)), F.lit(""))
    df = pages.withColumn("host", host_of(rest)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    rule, allows = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, allows = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.allow)).otherwise(allows)
    return df.withColumn("rule", rule).withColumn("rule_allows", allows)


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = pages.select(host_of(F.coalesce(_rest(F.col(url)), F.lit(""))).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("link"))
    dst = host_of(F.substring(F.col("link"), F.instr(F.col("link"), F.lit("//")) + 2, F.length("link")))
    return links.select("src", dst.alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def rounds_to(tolerance: float, damping: float) -> int:
    """After so many rounds ranks change by less than ``tolerance``: each round's change is at most ``damping`` of the last, and the first's at most 4."""
    return max(1, math.ceil(math.log(tolerance / 4) / math.log(damping)) + 1)


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust), each summing to 1, over ``edges`` (src, dst, n).

    Rounds end where ranks change by less than ``tolerance`` in all; ``rounds``
    sets their number instead.
    """
    edges = materialise(edges, "host-edges")
    if edges.isEmpty():
        return seeds
    out_w = edges.groupBy("src").agg(F.sum("n").alias("out"))
    in_w = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = materialise(edges.join(out_w, "src").join(in_w, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("down"), (F.col("n") / F.col("into")).alias("up")), "host-shares")
    linked = shares.select(F.explode(F.array(F.struct(F.col("src").alias("host"), F.lit(1).alias("gives"), F.lit(0).alias("takes")), F.struct(F.col("dst").alias("host"), F.lit(0).alias("gives"), F.lit(1).alias("takes")))).alias("x")).groupBy("x.host").agg(F.max("x.gives").alias("gives"), F.max("x.takes").alias("takes"))
    zero = F.lit(0.0)
    hosts = linked.join(seeds, "host", "full").select("host", F.coalesce("gives", F.lit(0)).alias("gives"), F.coalesce("takes", F.lit(0)).alias("takes"), F.coalesce("trust", zero).alias("s"), F.coalesce("distrust", zero).alias("d"))
    now = materialise(hosts.select("*", F.col("s").alias("trust"), F.col("d").alias("distrust"), F.lit(4.0).alias("change")), "ranks")
    for _ in range(rounds or rounds_to(tolerance, damping)):
        # What moves along links; the rest, which hosts without links hold, goes back to the seeds.
        t, b, change = now.agg(F.sum(F.col("trust") * F.col("gives")), F.sum(F.col("distrust") * F.col("takes")), F.sum("change")).first()
        if rounds is None and change < tolerance:
            break
        down = shares.join(now.select(F.col("host").alias("src"), "trust"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("trust") * F.col("down")).alias("t"))
        up = shares.join(now.select(F.col("host").alias("dst"), "distrust"), "dst").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("distrust") * F.col("up")).alias("b"))
        trust = (1 - damping * t) * F.col("s") + damping * F.coalesce("t", zero)
        distrust = (1 - damping * b) * F.col("d") + damping * F.coalesce("b", zero)
        moved = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        after = now.join(down, "host", "left").join(up, "host", "left").select("host", "gives", "takes", "s", "d", trust.alias("trust"), distrust.alias("distrust"), moved.alias("change"))
        after = materialise(after, "ranks")
        discard(now)
        now = after
    discard(edges)
    discard(shares)
    return now.select("host", "trust", "distrust")


def url_filter(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", rules: tuple[UrlRule, ...] = RULES, floor: float = 0.1, ratio: float = 2.0) -> DataFrame:
    """id, host, path, rule, verdict and the host's ranks for every row of ``pages``."""
    judged = with_rule(pages.select(F.col(id_col), F.col(url).alias("__url")), "__url", rules).drop("__url")
    allowed, blocked = F.count_if(F.col("rule_allows")), F.count_if(~F.col("rule_allows"))
    hosts = judged.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), allowed.alias("a"), blocked.alias("b"))
    hosts = materialise(hosts.select("host", F.when((F.col("a") > 0) & (F.col("b") == 0), F.col("n")).otherwise(0).cast("double").alias("t"), F.when(2 * F.col("b") > F.col("n"), F.col("n")).otherwise(0).cast("double").alias("d")), "hosts")
    t, d, n = hosts.agg(F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum("d"), F.lit(0.0)), F.count("*")).first()
    seeds = hosts.select("host", (F.col("t") / (t or 1.0)).alias("trust"), (F.col("d") / (d or 1.0)).alias("distrust"))
    ranks = propagate(host_edges(pages, url, html), seeds)
    bad = (F.col("distrust") * n >= floor) & (F.col("distrust") >= ratio * F.col("trust"))
    ranks = ranks.select("host", "trust", "distrust", bad.alias("bad"))
    allow = F.coalesce("rule_allows", ~F.col("bad"), F.lit(True))
    return judged.join(ranks, "host", "left").select(id_col, "host", "path", "rule", F.when(allow, "allow").otherwise("block").alias("verdict"), "trust", "distrust")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
