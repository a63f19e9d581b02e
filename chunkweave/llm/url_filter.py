"""URL filters: host and path rules, and trust spread over the link graph for urls that no rule fits.

A rule names a host (it fits all subdomains) and the beginning of a path; the longest that fits wins.
Other urls are judged by their host.  Links of the pages give edges between hosts, each weighted by the
page links behind it.  Trust is a personalised PageRank from the hosts of urls that rules allow, each
seed weighted by the share of its urls that they allow; distrust is one from the hosts of urls that rules
block, likewise, along reversed edges, so that whoever links to blocked hosts is distrusted.  A host is
blocked when its distrust is over ``THRESHOLD`` times its trust, else allowed: a tie of both is allowed.

A PageRank is a sum over walks from the seeds; what goes back to the seeds only scales all of it.  So each round moves what the
last one brought to the hosts that it links to, damped, and both ranks move at once, as rows of two kinds.
Hosts that no seed reaches take part in no round, and without links there is one round.  Rounds go on until
none adds more than ``TOLERANCE`` of its rank to any host, a host reached for the first time counting as
changed, however far it lies from the seeds; every ``CUT`` rounds the sums are written to the shared folder.

DataFrame expressions alone are used.  Edges are summed by host before they are shuffled; ranks travel by
equi-joins, and each round's are summed before their shuffle.  A hot host's edges can be split by the
engine, as both sides of the joins are ordinary shuffles.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed (the
empty host has neither trust nor distrust); null html has no links; repeated rows are judged alike, and their links count again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: (host, beginning of the path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, CUT, THRESHOLD = 0.85, 4, 1.0
#: Largest change of a rank, as a share of it, at which ranks are settled; rounds after which they count as never settling.
TOLERANCE, MOST_ROUNDS = 1e-10, 10_000


def _lower(c: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: tuple[str, str, str]) -> Column:
    host, path, _ = rule
    return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))


def _longest_first(rules) -> list:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))


def rule_column(rules=RULES) -> Column:
    """Name of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("string")
    for r in reversed(_longest_first(rules)):
        out = F.when(_fits(r), F.lit(r[0] + r[1])).otherwise(out)
    return out


def verdict_column(rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in reversed(_longest_first(rules)):
        out = F.when(_fits(r), F.lit(r[2])).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from pages of one host to another host; relative links stay on their host."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    page = pages.select(host_of(F.col("url")).alias("src"), F.coalesce(links, F.array().cast("array<string>")).alias("links"))
    # links of a page are reduced to hosts and counted as they are read: relative ones never leave the row
    away = F.filter(F.col("links"), lambda x: x.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    return page.select("src", F.explode(away).alias("link")).select("src", host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _weights(edges: DataFrame) -> DataFrame:
    """kind, src, dst, w: the share of each edge in its source's links, forwards for trust and backwards for distrust."""
    both = edges.select(F.lit("good").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("bad").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    return both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w"))


def ranks(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> DataFrame:
    """kind, host, rank from edges (src, dst, n) and seeds (kind, host, start), for the hosts that seeds of a kind reach; a kind's ranks add up to 1.

    Kind ``good`` runs along the edges, ``bad`` against them.
    """
    whole = seeds.where("start > 0").groupBy("kind").agg(F.sum("start").alias("whole"))  # two rows
    start = seeds.where("start > 0").join(F.broadcast(whole), "kind").select("kind", "host", (F.col("start") / F.col("whole")).alias("rank"))
    weights = base.stored(_weights(edges), "edges")
    # every host with the sum so far and what the last round brought
    now = base.stored(start.withColumn("new", F.col("rank")), "ranks")
    total, new = now.select("kind", "host", "rank"), now.select("kind", "host", "new")
    for k in range(1, most + 1):
        moved = new.join(weights.withColumnRenamed("src", "host"), ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg((DAMPING * F.sum(F.col("w") * F.col("new"))).alias("new"))
        total, new = total.unionByName(moved.withColumnRenamed("new", "rank")), moved
        if k % CUT and k > 1:  # the first round is looked at, as it may be the last
            continue
        summed = total.withColumn("new", F.lit(0.0)).unionByName(new.select("kind", "host", F.lit(0.0).alias("rank"), "new"))
        later = base.stored(summed.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("new").alias("new")), "ranks")
        base.dropped(now)
        now = later
        total, new = now.select("kind", "host", "rank"), now.where("new > 0").select("kind", "host", "new")
        if not (new.agg(F.count("*").alias("n")).first()["n"] and now.agg(F.max(F.col("new") / F.col("rank")).alias("c")).first()["c"] > tolerance):
            whole = total.groupBy("kind").agg(F.sum("rank").alias("whole"))
            return total.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("rank") / F.col("whole")).alias("rank"))  # two rows on the right
    raise RuntimeError(f"ranks aren't settled after {most} rounds")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = url.withColumns({"rule": rule_column(rules), "by_rule": verdict_column(rules)})
    # both sides of the last join are plain shuffles, so that a hot host's pages can be split
    verdicts = base.settled(lambda: _host_verdicts(pages, ruled, rules, threshold), "verdicts")
    # urls without a host meet no other: they stay out of the join
    named = ruled.withColumn("host_key", F.when(F.col("host") != "", F.col("host")))
    return named.join(verdicts.withColumnRenamed("host", "host_key"), "host_key", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_graph", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def _host_verdicts(pages: DataFrame, ruled: DataFrame, rules, threshold: float) -> DataFrame:
    """host, trust, distrust and by_graph of the hosts that have either."""
    edges = base.stored(host_edges(pages), "links")
    share = lambda kind: F.avg(F.when(F.col("by_rule") == kind, 1.0).otherwise(0.0))
    own = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    # a host that is only linked to counts as if it were called by its root
    linked = edges.select(F.col("dst").alias("host")).distinct().withColumn("path", F.lit("/")).withColumn("by_rule", verdict_column(rules)).groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    hosts = own.unionByName(linked).groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    seeds = base.stored(hosts.select("host", F.explode(F.create_map(F.lit("good"), "good", F.lit("bad"), "bad")).alias("kind", "start")).where("start > 0"), "seeds")
    found = ranks(edges, seeds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    both = found.groupBy("host").agg(of("good").alias("trust"), of("bad").alias("distrust"))
    return both.select("host", "trust", "distrust", F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow").alias("by_graph"))
