"""URL filter: rules first, then an empirical-Bayes reputation of the host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import cut_lineage, subset

BLOCK, ALLOW = "block", "allow"

#: (rule, verdict); a rule is a host, a slash and the start of a path.
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))

#: Weight of the prior, in pages, that each level lends to the one below it, lies between these and is estimated.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1000.0
#: Labels under which a two-letter country suffix registers domains, as in co.uk.
SHARED_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A host is blocked where its share of bad pages lies above BAD_SHARE by BOUND_DEVIATIONS of the posterior.
BAD_SHARE = 0.5
BOUND_DEVIATIONS = 1.645

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next / ? or #, in lower case; empty for a null or other text."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last label; the last two where a label of SHARED_LABELS stands between a name and a country's two letters."""
    shared = host.rlike(rf"[^.]\.({'|'.join(SHARED_LABELS)})\.[a-z]{{2}}$")
    return F.when(shared, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    """The suffix and the label before it."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(suffix_of(host) == two, three).otherwise(two)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does.

    A rule's host fits itself and its subdomains; its path fits paths that start with it.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = text.partition("/")
        fits = (F.concat(F.lit("."), host).endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _prior_pages(groups: DataFrame, bad: str, n: str, mean: Column) -> Column:
    """Weight of the beta prior round `mean` that groups' counts speak for, as a scalar.

    By moments of the beta-binomial law: the squared deviations of the counts exceed those of a binomial law by
    the share 1 / (weight + 1) of n (n - 1) m (1 - m). Rounded, so that it does not depend on the order of summing; the
    greatest weight where the groups do not differ by more than chance or too few pages are labelled to tell.
    """
    m, x = mean, F.col(n)
    over = F.sum((F.col(bad) - x * m) ** 2 - x * m * (1 - m))
    room = F.sum(x * (x - 1) * m * (1 - m))
    found = groups.agg(over.alias("over"), room.alias("room")).select(
        F.when((F.col("over") > 0) & (F.col("room") > 0), F.col("room") / F.col("over") - 1.0).otherwise(MOST_PRIOR).alias("weight")
    )
    return found.select(F.round(F.least(F.greatest("weight", F.lit(LEAST_PRIOR)), F.lit(MOST_PRIOR)), 6)).scalar()


def reputations(outcomes: DataFrame) -> DataFrame:
    """Posterior share of bad pages of each host, with its standard deviation.

    outcomes: host and bad (1, 0, or null where the page has no label). Counts are summed by host,
    then by registered domain, then by suffix; each level's share, shrunk towards the level above, is
    the mean of the beta prior of the level below. The weight of each level's prior is estimated from how much the
    level's groups differ. A host without labelled pages stands at its domain's share. Sums are partial, so a host with
    a third of all pages leaves each task as one row; only one row for each host moves on.
    """
    hosts = outcomes.groupBy("host").agg(
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"), F.count("bad").alias("n")
    )
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    hosts = cut_lineage(hosts)  # read at every level, and once more for each level's weight
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("d_bad"), F.sum("n").alias("d_n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_bad").alias("s_bad"), F.sum("d_n").alias("s_n"))
    whole = suffixes.agg(F.sum("s_bad").alias("w_bad"), F.sum("s_n").alias("w_n"))

    def shrunk(groups: DataFrame, bad: str, n: str, towards: str) -> DataFrame:
        weight = _prior_pages(groups, bad, n, F.col(towards))
        mean = (F.col(bad) + F.col("weight") * F.col(towards)) / (F.col(n) + F.col("weight"))
        return groups.withColumn("weight", weight).withColumn("mean", mean)

    # The share over all labelled pages, as if one more were bad and one more good.
    base = whole.select((F.coalesce("w_bad", F.lit(0)) + 1.0) / (F.coalesce("w_n", F.lit(0)) + 2.0)).scalar()
    suffixes = shrunk(suffixes.withColumn("base", base), "s_bad", "s_n", "base").select("suffix", F.col("mean").alias("s_mean"))
    domains = shrunk(domains.join(suffixes, "suffix"), "d_bad", "d_n", "s_mean").select("domain", F.col("mean").alias("d_mean"))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1.0))
    return shrunk(hosts.join(domains, "domain"), "bad", "n", "d_mean").select("host", "n", "mean", spread.alias("deviation"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    bad_share: float = BAD_SHARE,
    deviations: float = BOUND_DEVIATIONS,
) -> DataFrame:
    """Host, path, rule and verdict of every page's url.

    outcomes: page_id and bad (1 or 0), the labelled pages; a page with more than one outcome counts as
    bad if any says so. Where a rule fits, its verdict holds; elsewhere the host is blocked if the lower
    bound of its posterior share of bad pages lies above bad_share. The bound is the mean less
    `deviations` standard deviations of the beta posterior.

    A null url, or one without ://, has an empty host and path and is judged as the host "". Null page
    ids take no outcome but are judged; repeated rows are each judged. Empty tables give no rows, and
    without any outcome nothing is blocked but by rule. Other columns play no part.
    """
    urls = subset(pages, "page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    labelled = subset(outcomes, "page_id", "bad").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = reputations(urls.join(labelled, "page_id", "left"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    low = F.col("mean") - F.lit(deviations) * F.col("deviation")
    by_method = F.when(low > bad_share, BLOCK).otherwise(ALLOW)
    return urls.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_method).alias("verdict")
    )
