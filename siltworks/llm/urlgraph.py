"""URL filter: host and path rules, and trust that spreads over the host graph for pages that no rule fits.

Hosts are joined by edges: links of a page to other hosts, and each host with the
parent domains it lies under. Personalised PageRank starts from hosts with
allowed pages and follows the edges; distrust starts from hosts with blocked pages
and follows them backwards. A seed counts by the share of its host's pages that rules allow or
block, not by their number. Both ranks are put in relation to what the host gets when the
walk restarts at any host alike (its lift): 1 is what a host without any leaning has, however
central it is. A host is blocked if its distrust has a lift of BLOCK_LIFT or more and
a larger one than its trust; any other is allowed. DataFrame functions only.

The graph has as many rows as there are distinct host pairs; page rows are
aggregated before the first shuffle, so a host with a third of all pages is one row
per task. Ranks are cut from their lineage by a written table every few rounds, and final
when less than TOLERANCE of all mass is in motion. A round takes as many tasks as its rows need: a graph of few hosts one.

Defined results: a null url or one without ``://`` has empty host and path, no
rule and the verdict allow; empty tables give no rows; repeated rows are judged
each; further columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]
#: Ranks are final when less than TOLERANCE of their mass is in motion. That shrinks by the damping each round, so ROUNDS is never reached before.
ROUNDS, DAMPING, CUT_EVERY, TOLERANCE = 200, 0.85, 8, 1e-6
#: Rows of hosts or edges for each task of a round.
ROWS_A_TASK = 200_000
#: Distrust, as a multiple of what a host gets from a walk without leaning, from which on it is blocked.
BLOCK_LIFT = 2.0
#: The host of an absolute link, or of one that leaves out the scheme.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, null where none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        out = F.when(fits & F.startswith(path, F.lit(r.path)), F.lit(r.text)).otherwise(out)
    return out


def parents(host: Column) -> Column:
    """The domains that a host lies under, down to two labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.when(F.size(labels) > 2, F.sequence(F.lit(2), F.size(labels) - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): pages that link from host to host, and one edge each way between a host and its parents."""
    p = pages.select(host_of(F.col("url")).alias("src"), F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), _lower)).alias("to")).where("src <> ''")
    linked = p.select("src", F.explode("to").alias("dst")).where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hosts = p.select("src").distinct()
    up = hosts.select("src", F.explode(parents(F.col("src"))).alias("dst"))
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1.0))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def personalised_rank(spark: SparkSession, edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tasks: int = 1 << 30) -> DataFrame:
    """(host, rank, base): power iteration of two PageRanks at once, that restart at ``seeds`` (host, s, u: one row a host; s and u each sum to a constant): rank by s, base by u. Mass of hosts without edges is not handed on. A round leaves at most ``damping`` of the mass in motion, so the number of rounds follows from TOLERANCE. A round has at most ``tasks`` tasks; one of a single task moves nothing between tasks but the ranks, at most ROWS_A_TASK rows, as a broadcast."""
    one = tasks == 1
    out_w = edges.groupBy("src").agg(F.sum("w").alias("out"))
    shares = staged(spark, edges.join(out_w, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")).coalesce(tasks), "shares")
    restart = seeds.select("host", ((1 - damping) * F.col("s")).alias("rank"), ((1 - damping) * F.col("u")).alias("base"))
    rank, old = seeds.select("host", F.col("s").alias("rank"), F.col("u").alias("base")), None
    last = min(rounds, math.ceil(math.log(TOLERANCE) / math.log(damping)))
    for k in range(1, last + 1):
        by = F.broadcast(rank) if one else rank
        moved = shares.join(by, shares["src"] == by["host"]).select(shares["dst"].alias("host"), (damping * F.col("p") * F.col("rank")).alias("rank"), (damping * F.col("p") * F.col("base")).alias("base"))
        rank = moved.unionByName(restart).coalesce(tasks).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("base").alias("base"))
        if k % CUT_EVERY == 0 or k == last:
            rank, done = staged(spark, rank.coalesce(tasks), "rank"), old
            if done is not None:
                discard(spark, done)
            old = rank
    discard(spark, shares)
    return rank


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule] | None = None, block_lift: float = BLOCK_LIFT) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust, trust_lift, distrust_lift)."""
    rules = RULES if rules is None else rules
    allow = [r.text for r in rules if r.verdict == "allow"]
    seen = ruled(pages, rules)
    seen = seen.withColumn("by_rule", F.when(F.col("rule").isin(allow), F.lit("allow")).when(F.col("rule").isNotNull(), F.lit("block")))
    share = lambda v: (F.count_if(F.coalesce(F.col("by_rule") == v, F.lit(False))) / F.count(F.lit(1))).alias(v)
    hosts = staged(spark, seen.where("host <> ''").groupBy("host").agg(share("allow"), share("block")), "hosts")
    edges = staged(spark, host_edges(pages), "edges")
    nodes = hosts.unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("allow"), F.lit(0.0).alias("block"))).groupBy("host").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    tasks = -(-2 * (edges.count() + hosts.count()) // ROWS_A_TASK) or 1
    nodes = staged(spark, nodes.coalesce(tasks), "nodes")
    sums = nodes.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    # both ranks are found at once: hosts of the trust graph are marked "+", those of the distrust graph, with its edges turned round, "-"
    mark = lambda m, c: F.concat(F.lit(m), F.col(c))
    graph = edges.select(mark("+", "src").alias("src"), mark("+", "dst").alias("dst"), "w").unionByName(edges.select(mark("-", "dst").alias("src"), mark("-", "src").alias("dst"), "w"))
    seeds = lambda m, c: nodes.select(mark(m, "host").alias("host"), (F.col(c) / F.lit(sums[c] or 1.0)).alias("s"), F.lit(1 / (sums["n"] or 1.0)).alias("u"))
    ranks = personalised_rank(spark, graph, seeds("+", "allow").unionByName(seeds("-", "block")), tasks=tasks)
    of = lambda m: ranks.where(F.startswith("host", F.lit(m))).select(F.substring("host", 2, 1 << 30).alias("h"), F.round("rank", 12).alias("rank"), F.round(F.col("rank") / F.col("base"), 6).alias("lift"))
    by_host = of("+").select("h", F.col("rank").alias("trust"), F.col("lift").alias("trust_lift")).join(of("-").select("h", F.col("rank").alias("distrust"), F.col("lift").alias("distrust_lift")), "h")
    out = seen.join(by_host, seen["host"] == by_host["h"], "left")
    blocked = (F.col("distrust_lift") >= block_lift) & (F.col("distrust_lift") > F.col("trust_lift"))
    verdict = F.coalesce("by_rule", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust", "trust_lift", "distrust_lift")])


def ruled(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(page_id, host, path, rule): the longest rule that fits each url, or null."""
    seen = pages.select(pages["page_id"].alias("page_id"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    seen = seen.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    return seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))


#: What the rules say, by themselves.
ORACLE_RULES = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('com', '/en/'), ('example.com', '/en/7'), ('net', '/de/'), ('example.net', '/de/8'), ('org', '/es/')) AS t(rh, rp)),
f AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule FROM h LEFT JOIN f ON h.page_id = f.page_id"""
