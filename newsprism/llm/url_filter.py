"""URL filters: rules, then an empirical-Bayes reputation of hosts.  Native: DataFrame functions only.

Labelled page outcomes (bad or not) are summed a host, a registered domain and a suffix.  From the
top down each level shrinks its share of bad outcomes to the level above, as the mean of a
beta-binomial posterior; the strength of each prior comes from the spread of shares between the
groups of that level (method of moments).  A host is blocked if the lower bound of its posterior
reaches the cut, so hosts without outcomes of their own inherit their domain's and suffix's share,
and weak evidence blocks nothing.

Shuffles: partial sums by host, the host table, and a join of pages to it, which adaptive
execution splits where a host is hot.

Defined cases: null or malformed urls have empty host and path, fit no rule and get the method's
verdict for the empty host; labels that repeat a page each count; null labels don't; a host of
one part is its own domain and suffix; repeated pages are judged alike; extra columns pass
through, and a result column replaces an input column of its name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.columns import Columns
from newsprism.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Suffixes of more than one part under which unrelated sites register; others are the last part.
SUFFIXES = ("example.com", "example.net", "example.org")
#: Standard deviations below the posterior mean, and the share of bad pages that blocks.
Z, CUT = 1.64, 0.3
#: Bad pages and pages that stand in for evidence at the top.
BASE = (0.5, 10.0)
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 200.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    parts = F.split(host, r"\.")
    long = F.lit(False)
    for s in suffixes:
        long = long | (host == s) | host.endswith("." + s)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - F.when(long, 1).otherwise(0)), F.lit(9)), ".")


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one part before it, where the host has one."""
    parts, n = F.split(host, r"\."), F.size(F.split(suffix, r"\."))
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n), n + 1), ".")


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # longer rules go outside
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _strength(n: str, bad: str, above: str) -> Column:
    """Aggregate: pages' worth of the prior, from the spread of the groups' shares.

    With shares x of n pages around mean m, E[sum n (x - m)^2] = sum m(1-m) (1 + (n-1) r), where
    r = 1 / (1 + strength) is the correlation within a group."""
    spread = F.sum(F.expr(f"{n} * power({bad} / {n} - {above}, 2)"))
    flat = F.sum(F.expr(f"{above} * (1 - {above})"))
    more = F.sum(F.expr(f"{above} * (1 - {above}) * ({n} - 1)"))
    r = (spread - flat) / F.nullif(more, F.lit(0.0))
    return F.when(r > 0, F.least(F.greatest(1 / r - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """A row a host of `pages` (page_id, host): n, bad, mean, lower.  outcomes: (page_id, n, bad)."""
    known = pages.join(outcomes, "page_id", "left")
    hosts = known.groupBy("host").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = stored(hosts, "hosts")  # each level reads them

    def level(df: DataFrame, key: str, parent: str | None) -> DataFrame:
        extra = [F.first(parent).alias(parent)] if parent else []
        return df.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), *extra)

    def shrink(df: DataFrame) -> DataFrame:
        """Adds the posterior mean, given each row's `above`, and the strength of the prior."""
        m = df.where("n > 0").agg(_strength("n", "bad", "above").alias("m"))
        return df.crossJoin(F.broadcast(m)).withColumn("mean", F.expr("(bad + m * above) / (n + m)"))  # one row

    domains = level(hosts, "domain", "suffix")
    tops = level(domains, "suffix", None)
    base = tops.agg(F.expr(f"(sum(bad) + {BASE[0]}) / (sum(n) + {BASE[1]})").alias("above"))
    tops = shrink(tops.crossJoin(F.broadcast(base)))  # one row
    domains = shrink(domains.join(tops.select("suffix", F.col("mean").alias("above")), "suffix"))
    hosts = shrink(hosts.drop("suffix").join(domains.select("domain", F.col("mean").alias("above")), "domain"))
    return hosts.withColumn("lower", F.expr(f"mean - {Z} * sqrt(mean * (1 - mean) / (n + m + 1))")).select("host", "n", "bad", "mean", "lower")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, cut: float = CUT) -> DataFrame:
    """The rows of `pages` (page_id, url) with host, path, rule, reputation, lower and verdict.
    labels: (doc_id, quality), where the page of that id is bad if quality is 0."""
    results = ["host", "path", "rule", "reputation", "lower", "verdict"]
    own_columns = Columns(pages, results)
    url = own_columns["url"].cast("string")
    rows = own_columns.rows(page_id=own_columns["page_id"], host=host_of(url), path=path_of(url))
    outcomes = labels.select("doc_id", "quality").where("quality in (0, 1)").groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"), F.sum(1 - F.col("quality")).alias("bad"))
    scores = host_reputation(rows.select("page_id", "host"), outcomes)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(scores.select("host", F.col("mean").alias("reputation"), "lower"), "host", "left")
    own = F.when(F.col("lower") >= cut, "block").otherwise("allow")
    return own_columns.back(judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)}), results)

