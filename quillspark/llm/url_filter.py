"""URL filtering by rules and by host reputation.

Reputation is the share of a host's labelled pages that are bad, by empirical Bayes: a host's share
is shrunk to that of its registered domain, the domain's to its suffix's, the suffix's to that of
all pages, each by a beta prior whose strength is fitted to the spread of the level's shares
(method of moments). A host is blocked where the lower bound of its posterior is over the share whose odds
are LIFT times those of all pages, so what counts as bad follows the labels: a host is blocked for being worse
than the rest, by its own pages, or with few of them by its domain's or its suffix's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LIFT = 2.0
BOUND_Z = 1.0
#: Public suffixes of two labels; a host's registered domain is one label more than its suffix. A longer list is a parameter.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "com.br", "org.br", "com.cn", "net.cn", "org.cn", "com.tw", "com.hk", "com.sg", "co.in", "co.za", "com.mx", "com.ar", "com.tr", "co.il")
#: Bounds of the fitted strength of a prior, in labelled pages.
STRENGTH = (1.0, 1000.0)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules is a list in the plan, a few hundred at most."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the public suffix of a host without user and port. An address is its own domain, of the empty suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | F.startswith(name, F.lit("["))
    label = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(label, F.greatest(F.size(label) - n + 1, F.lit(1)), n), ".")
    two = last(2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(address, name).when(two, last(3)).otherwise(last(2)), F.when(address, "").when(two, last(2)).otherwise(last(1))


def host_reputation(pages: DataFrame, bad: Column, known: Column, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, bound, base) of each host of pages (host), base being the share of all labelled pages. bad, known: of a row, whether it counts as bad, and whether it is labelled.

    Hosts without labels take their domain's mean, with the prior's own width. For domains and suffixes see ``domain_and_suffix``.
    """
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    counts = pages.groupBy("host").agg(F.sum(known.cast("long")).alias("n"), F.sum((known & bad).cast("long")).alias("bad"))
    hosts = staged(counts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = staged(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = staged(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    n, b = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = (b or 0) / n if n else 0.0

    def shrunk(level: DataFrame, prior: Column) -> DataFrame:
        """Adds strength and mean. Spread beyond what sampling explains gives the strength of the prior."""
        with_prior = level.withColumn("prior", prior)
        share = F.col("bad") / F.col("n")
        fit = with_prior.where("n > 0").agg(
            F.sum(F.round(F.col("n") * (share - F.col("prior")) ** 2, 9).cast("decimal(38,9)")).alias("seen"),
            F.sum(F.round(F.col("prior") * (1 - F.col("prior")), 9).cast("decimal(38,9)")).alias("sampling"),
            F.sum(F.round(F.col("n") * F.col("prior") * (1 - F.col("prior")), 9).cast("decimal(38,9)")).alias("whole"),
        ).first()
        seen, sampling, whole = (float(x or 0) for x in fit)
        # E[n (share - prior)^2] = prior (1 - prior) (1 + (n - 1) rho), rho = 1 / (1 + strength).
        rho = (seen - sampling) / (whole - sampling) if whole > sampling else 0.0
        strength = STRENGTH[1] if rho <= 0 else min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1])
        return with_prior.withColumn("strength", F.lit(strength)).withColumn("mean", (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))

    by_suffix = shrunk(suffixes, F.lit(overall)).select("suffix", F.col("mean").alias("above"))
    by_domain = shrunk(domains.join(by_suffix, "suffix"), F.col("above")).select("domain", F.col("mean").alias("above"))
    found = shrunk(hosts.join(by_domain, "domain"), F.col("above"))
    width = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return found.select("host", "n", "bad", "mean", (F.col("mean") - BOUND_Z * width).alias("bound"), F.lit(overall).alias("base"))


def filter_urls(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, lift: float = LIFT, threshold: float | None = None) -> DataFrame:
    """One row for each row of pages: key, host, path, rule, verdict, bound.

    labels: (doc_id, toxic) of pages, joined on the key (the given tables have labels of documents alone, whose ids say nothing of pages); a page is bad if any of its labels is toxic, and
    unlabelled without a label or where all are null. Null urls have the empty host, which is judged like any
    other. ``threshold``, where given, replaces that of the base share and LIFT; a bound that equals it is allowed. Rows with null or repeated keys are judged each on its own; null keys have no label.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max("toxic").alias("toxic"))
    parts = pages.select(F.col(key).cast("long").alias("key"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rows = staged(parts.join(staged(marks, "page-labels"), "key", "left"), "urls")
    known = F.col("toxic").isNotNull()
    reputation = staged(host_reputation(rows, F.coalesce(F.col("toxic") > 0, F.lit(False)), known).select("host", "bound", "base"), "reputation")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(reputation, "host", "left")
    most = F.lit(threshold) if threshold is not None else lift * F.col("base") / (1 - F.col("base") + lift * F.col("base"))
    own = F.when(F.col("bound") > most, "block").otherwise("allow")
    return judged.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")
