"""URL filter: list rules, then empirical-Bayes reputation of hosts. Spark expressions only."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import lookup, lower_ascii, stored

#: (host with path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Suffixes of more than one label; all others are the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "com.cn", "co.in", "co.nz", "co.za", "gov.uk", "org.uk")
#: A host is blocked if its share of bad pages is over BLOCK_SHARE even at the lower bound of Z standard deviations.
BLOCK_SHARE, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` (A-Z lower-cased) and path up to `?`, `#` or the end; both empty for null or no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule whose host is this one or above it and whose path starts this path; else null."""
    cases: Column | None = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0])):
        top, _, start = rule.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + start)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, hit) if cases is None else cases.when(fits, hit)
    return cases if cases is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def site_levels(host: Column) -> tuple[Column, Column, Column]:
    """Host without user and port, its registered domain, its public suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)), ".")
    two = last(2).isin(*SUFFIXES)
    return bare, F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))


def strength(groups: DataFrame) -> DataFrame:
    """One row: the beta prior's strength by moments of the groups' (n, bad), and the overall mean."""
    s = groups.agg(
        F.count("*").cast("double").alias("g"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("n2"),
        F.coalesce(F.sum(F.col("bad") * F.col("bad") / F.col("n")), F.lit(0.0)).alias("b2n"),
    )
    p = (F.col("bad") + 1) / (F.col("n") + 2)
    v = p * (1 - p)
    spread = F.col("b2n") - 2 * p * F.col("bad") + F.col("n") * p * p
    rho = (spread - v * (F.col("g") - 1)) / (v * (F.col("n") - F.col("n2") / F.greatest(F.col("n"), F.lit(1.0)) - (F.col("g") - 1)))
    clamped = F.when(F.col("n") - F.col("n2") / F.greatest(F.col("n"), F.lit(1.0)) - (F.col("g") - 1) <= 0, F.lit(STRONGEST)).when(rho <= 0, F.lit(STRONGEST))
    return s.select(p.alias("mean"), clamped.otherwise(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / rho - 1))).alias("k"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """From outcomes (site, domain, suffix, bad 0 or 1): site, n, posterior mean and lower bound. Each level's mean is the prior
    mean of the level below: all, suffix, domain, site. Counts are pre-aggregated by site, the lowest level."""
    sites = stored(outcomes.groupBy("suffix", "domain", "site").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad")), "sites")
    out, above = sites, None
    for level in ("suffix", "domain", "site"):
        groups = sites.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        prior = strength(groups).withColumnsRenamed({"mean": "mean0", "k": f"k_{level}"})  # one row, so broadcast
        sums = groups.withColumnsRenamed({"n": f"n_{level}", "bad": f"bad_{level}"})
        out = out.join(sums, level).join(F.broadcast(prior if above is None else prior.drop("mean0")))
        parent = F.col("mean0") if above is None else F.col(f"mean_{above}")
        out = out.withColumn(f"mean_{level}", (F.col(f"bad_{level}") + F.col(f"k_{level}") * parent) / (F.col(f"n_{level}") + F.col(f"k_{level}")))
        above = level
    m = F.col("mean_site")
    lower = m - Z * F.sqrt(m * (1 - m) / (F.col("n_site") + F.col("k_site") + 1))
    return out.select("site", F.col("n_site").alias("n_labelled"), m.alias("bad_mean"), lower.alias("bad_lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """A row a page: page_id, host, path, rule, verdict, n_labelled, bad_mean, bad_lower.

    outcomes: (url, bad), a labelled page a row, bad 0 or 1. A rule's verdict goes first. Else the host's reputation blocks
    if the posterior's lower bound is over BLOCK_SHARE; a host without any labelled page is allowed, and its reputation is null.
    Null url or no `://`: host and path are empty, no rule fits, allowed. Repeated rows: judged apart. Null bad: not counted.
    Empty tables: no rows, or no reputations.
    """
    host, path = host_path(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    own = own.withColumns({"m": match_rule(F.col("host"), F.col("path"), rules), "site": site_levels(F.col("host"))[0]})
    seen = outcomes.select(host_path(F.col("url"))[0].alias("host"), F.col("bad").cast("int").alias("bad")).filter("bad is not null and host <> ''")
    site, domain, suffix = site_levels(F.col("host"))
    known = stored(reputation(seen.select(site.alias("site"), domain.alias("domain"), suffix.alias("suffix"), "bad")), "reputation")
    judged = lookup(own, known, ["site"])
    method = F.when(F.col("bad_lower") > BLOCK_SHARE, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("page_id").alias(page_id), "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", method).alias("verdict"),
        "n_labelled", F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_lower", 6).alias("bad_lower"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page shows the document whose number is the last in its path; it is bad if that document's quality label is 0."""
    number = F.regexp_extract(host_path(F.col("url"))[1], r"^.*/(\d{1,18})\b", 1)
    own = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    known = labels.groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    return own.join(known, "doc_id").select("url", "bad")


