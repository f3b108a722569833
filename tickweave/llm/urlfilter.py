"""Verdicts on urls: written rules, and for the rest trust and distrust that spread over links between hosts.

A rule names a host with all its subdomains and a beginning of the path; the longest that fits decides. Hosts of pages that
a rule allows are trusted seeds, hosts of blocked pages are blocked seeds. Trust is personalised PageRank from the trusted
seeds along links; distrust is the same from the blocked seeds against the links' direction, as who links to bad hosts is suspect. A host whose
distrust exceeds its trust by more than ``THRESHOLD`` is blocked, any other is allowed.

Scores are whole numbers of 1e-12, so sums don't depend on their order and the rounds end where nothing changes.
Links are the ``href`` of anchors that name a host; links within a host don't count, and several from one host to another count as one.

Nulls: a null url, or one without ``://``, has an empty host and path; no rule fits it, it is no seed and it is allowed. Null html has no
links. Repeated rows are answered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_tools import written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UNIT, DAMPING_PERCENT, ROUNDS, THRESHOLD = 10**12, 85, 20, 0
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _A, _Z)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and the rule's verdict, null where none fits."""
    out = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):  # the longest is asked first, so comes last
        own, slash, rest = text.partition("/")
        fits = ((F.col("host") == own) | F.col("host").endswith("." + own)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return out.withColumns({"rule": rule, "verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different hosts; ``pages`` has host and html."""
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("dst"))
    return found.select("src", F.translate("dst", _A, _Z).alias("dst")).where("src <> dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, step: int = 5) -> DataFrame:
    """(kind, host, score) after as many rounds: kind allow runs along the edges, kind block against them.

    ``seeds`` is (kind, host). What a host without edges would pass on is lost, as its surfer jumps back to a seed.
    """
    both = edges.select(F.lit("allow").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")).union(edges.select(F.lit("block"), "dst", "src"))
    degree = both.groupBy("kind", "host").agg((F.count("*") * 100).alias("parts"))
    both = written(both.join(degree, ["kind", "host"]), "links")
    number = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    base = written(seeds.join(F.broadcast(number), "kind").select("kind", "host", F.expr(f"{UNIT} * {100 - DAMPING_PERCENT} div (100 * n)").alias("score")), "seeds")
    scores, done = base, 0
    while done < rounds:
        before, turns = scores, min(step, rounds - done)
        for _ in range(turns):
            passed = both.join(scores, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.expr(f"score * {DAMPING_PERCENT} div parts").alias("score"))
            scores = base.union(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        scores, done = written(scores, "scores"), done + turns
        if not scores.exceptAll(before).limit(1).count():
            break
    return scores


def judged(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, host, path, rule, verdict."""
    said = ruled(pages.select("page_id", "url", "html"), rules)
    seeds = written(said.where("verdict is not null and host <> ''").select(F.col("verdict").alias("kind"), "host").distinct(), "ruled")
    scores = spread(host_edges(said), seeds, rounds)
    net = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "block", F.col("score")).otherwise(-F.col("score"))).alias("net"))
    bad = net.where(F.col("net") > threshold).select("host", F.lit("block").alias("spread"))
    out = said.select("page_id", "host", "path", "rule", "verdict").join(bad, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))
