"""URL filter: host and path rules, then trust and distrust over the link graph.

Rules judge the urls they fit.  All others get their host's verdict: the hosts
whose pages the rules mostly allow are trusted seeds, those whose pages they
mostly block are blocked seeds; trust runs along the links from host to host
(personalised PageRank), distrust runs against them, and a host is blocked when
distrust exceeds trust by ``THRESHOLD``.  A seed starts with 1, so the
threshold means the same for any number of hosts.

The mass of ``FOLD`` rounds at most lies in the shared folder, beside the links and the
sum of the rounds before; what no round reads any more is deleted.

Defined results: a null url, or one without ``://``, has an empty host and
path, no rule, and is allowed; a null html has no links; with equal lengths the
rule listed first wins; repeated rows get equal verdicts and count as pages of
their own; other columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import discard, materialise

DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.1
#: Mass under way, over all hosts, at which propagation ends: no host's can change by more than six times that.
TOLERANCE = 1e-9
#: Rounds whose mass is kept apart before it is summed up, so that a round writes what moves and not all hosts.
FOLD = 8
#: (verdict, host, path) of the driver's contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'>\s]+)"""


def host_of(url: Column) -> Column:
    """Host with A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Path up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def apply_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add rule and ruled (its verdict) to rows with host and path; both null where no rule fits."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    longest_last = sorted(rules, key=lambda r: len(r[1] + r[2]))
    for verdict, host, path in sorted(longest_last, key=lambda r: (len(r[1] + r[2]), -rules.index(r))):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return urls.withColumns({"rule": rule, "ruled": ruled})


def site_of(host: Column) -> Column:
    """The host without user and port: what links lead to."""
    return F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", "")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different sites, counted."""
    target = F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))
    found = pages.select(site_of(host_of(F.col("url"))).alias("src"), target.alias("href"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    dst = site_of(host_of(full))
    return found.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, mass): PageRank mass from the seeds (host) along edges (src, dst, n), a host's mass split by n; ``rounds`` None goes on until it has converged."""
    start = materialise(seeds.select("host", F.lit(1.0).alias("mass")), "seeds", narrow=True)
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    flow = materialise(edges.join(total, "src").select("src", "dst", (damping * F.col("n") / F.col("total")).alias("share")), "flow", narrow=True)
    if not flow.limit(1).count():
        discard(flow)
        return start
    # what each round brought, and the sum of the rounds before; the sum is written anew every FOLD rounds
    brought, used, moving, done = [start], [], start, 0
    while rounds is None or done < rounds:
        done += 1
        # each round moves on what the last one brought
        sent = moving.join(flow, moving["host"] == flow["src"]).select(F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("mass"))
        moving = materialise(sent.groupBy("host").agg(F.sum("mass").alias("mass")), "moving", narrow=True)
        # the whole mass that still moves bounds what any host can get from it
        ended = (moving.agg(F.sum("mass")).first()[0] or 0.0) <= tolerance
        brought.append(moving)
        if len(brought) > FOLD or ended or done == rounds:
            summed = materialise(reduce(DataFrame.unionByName, brought).groupBy("host").agg(F.sum("mass").alias("mass")), "mass", narrow=True)
            discard(*[b for b in brought if b is not moving], *used)
            used, brought = [moving], [summed]  # the next round still reads what this one brought
        if ended:
            break
    discard(flow, *used)
    return brought[0]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page; trust and distrust are its host's."""
    urls = apply_rules(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules).withColumn("site", site_of(F.col("host")))
    counts = urls.where("site <> ''").groupBy(F.col("site").alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    counts = materialise(counts, "hosts")
    edges = materialise(host_links(pages), "edges")
    trust = propagate(edges, counts.where("2 * allowed > n"), None).withColumnRenamed("mass", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, counts.where("2 * blocked > n"), None).withColumnRenamed("mass", "distrust")
    scores = trust.join(distrust, "host", "full_outer").select(F.col("host").alias("site"), *(F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("trust", "distrust")))
    scores = materialise(scores, "scores")
    unruled = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) >= threshold, "block").otherwise("allow")
    return urls.join(scores, "site", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", unruled).alias("verdict"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust"))
    )
