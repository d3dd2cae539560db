"""URL filters: rules first, then an empirical-Bayes reputation of the host.

A url's host and path are matched against rules (``example.org/es/``); the longest
rule that fits gives the verdict.  All other pages are judged by their host.  Labelled
outcomes (allowed or blocked) are counted per host, and the host's share of blocked
pages is shrunk towards its registered domain's, that towards its public suffix's, and
that towards the share of all pages, through beta-binomial priors::

    host ~ Beta(m_host * domain, m_host * (1 - domain)),  domain ~ Beta(m_domain * suffix, ...)

The prior of a host is taken from what *others* say: its own pages are left out of the
domain's, the suffix's and the whole counts, so that no outcome counts twice.  Each
level's concentration ``m`` is fitted to the data: the moment estimate of the intraclass
correlation ``rho`` of the level's groups around their priors, ``m = 1 / rho - 1``.  A
host is blocked where the lower bound of its posterior (one-sided, ``z`` standard
deviations on the arc-sine scale) is above ``max_bad``: hosts with little evidence stay.

Shape: pages are reduced to one row per host by one partial aggregate, which is written;
all fits run on that table.  Hosts with at least a ``1 / HOT`` share of all pages, of
which there can be no more than ``HOT``, come back to their pages by broadcast; the other
hosts by a shuffle join, in which the hot hosts' pages carry keys of their own.

Defined results: a NULL url or one without ``://`` has an empty host and path, and the
empty host is a host like any other; outcomes that are NULL count as none; repeated rows
count each; with no outcome at all every page is allowed; an empty table gives an empty
result; columns of the names this module adds are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import stage

#: rules of the registered query: (rule, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block"))
#: second-level labels under which two-letter suffixes register names
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
MAX_BAD = 0.5
Z = 1.2816
HOT = 1000
#: bounds of the intraclass correlation: m between 1 and 999,999
RHO = (1e-6, 0.5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (NULL where none fits; ties: the smaller string)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        rule_host, slash, rule_path = rule.partition("/")
        if not rule_host or says not in ("allow", "block"):
            raise ValueError(f"not a rule: {rule!r} {says!r}")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix; a bare name or an address is its own."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "\\.$", "")
    labels = F.split(bare, "\\.")
    n = F.size(labels)
    two = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    whole = (n < 2) | bare.rlike("^[0-9.]*$")
    suffix = F.when(whole, bare).when(two, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(whole, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return domain, suffix


def _concentration(groups: DataFrame, prior: Column) -> float:
    """``m`` of the groups ``(n, bad)`` around their prior means, by moments."""
    n, p = F.col("n"), prior
    over = F.sum((F.col("bad") - n * p) * (F.col("bad") - n * p) - n * p * (1 - p))
    pairs = F.sum(n * (n - 1) * p * (1 - p))
    rho = groups.agg(F.coalesce(F.try_divide(over, pairs), F.lit(RHO[1]))).first()[0]
    rho = min(max(rho, RHO[0]), RHO[1])
    return (1 - rho) / rho


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """Hosts ``(host, n, bad, ...)`` with their posterior ``bad_mean`` and ``bad_bound``.

    ``n`` labelled pages, ``bad`` of them blocked.  ``hosts`` is read several times: give
    a written table.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    d = hosts.withColumns({"__domain": domain, "__suffix": suffix})
    total = d.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    domains = d.groupBy("__domain", "__suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("__suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    # the mean of everything but the group itself, level by level
    root = lambda: (F.lit(total[1]) - F.col("bad") + 0.5) / (F.lit(total[0]) - F.col("n") + 1.0)
    above = lambda m, p, k: (m * p + F.col(f"__{k}bad") - F.col("bad")) / (m + F.col(f"__{k}n") - F.col("n"))
    m_suffix = _concentration(suffixes, root())
    by_suffix = above(F.lit(m_suffix), root(), "s")
    s = suffixes.select("__suffix", F.col("n").alias("__sn"), F.col("bad").alias("__sbad"))
    m_domain = _concentration(domains.join(s, "__suffix"), by_suffix)
    by_domain = above(F.lit(m_domain), by_suffix, "d")
    known = (d.join(domains.select("__domain", F.col("n").alias("__dn"), F.col("bad").alias("__dbad")), "__domain")
             .join(s, "__suffix"))
    m_host = _concentration(known, by_domain)

    weight = F.lit(m_host) + F.col("n")
    mean = (F.lit(m_host) * by_domain + F.col("bad")) / weight
    angle = F.greatest(F.asin(F.sqrt(mean)) - z / (2 * F.sqrt(weight + 1)), F.lit(0.0))
    return known.select(*hosts.columns, mean.alias("bad_mean"), (F.sin(angle) * F.sin(angle)).alias("bad_bound"))


def judge_hosts(pages: DataFrame, outcome: Column, host: str = "host", z: float = Z) -> DataFrame:
    """One row per host of ``pages``: ``host, n_pages, n, bad, bad_mean, bad_bound``.

    ``outcome``: ``block`` or ``allow`` for labelled pages, else NULL.
    """
    hosts = stage(pages.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_pages"), F.count(outcome).alias("n"), F.count_if(outcome == "block").alias("bad")), "url-hosts")
    return stage(reputation(hosts, z), "url-reputation")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", max_bad: float = MAX_BAD,
                z: float = Z) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` and the host's ``host_labelled, host_blocked, bad_mean, bad_bound``.

    A page under a rule has the rule's verdict, and is a labelled outcome for its host;
    every other page is blocked if the host's posterior bound exceeds ``max_bad``.
    """
    host, path = host_and_path(F.col(url))
    d = pages.withColumns({"__url_host": host, "__url_path": path})
    rule, says = rule_for(F.col("__url_host"), F.col("__url_path"), rules)
    d = d.withColumns({"__url_rule": rule, "__url_says": says})
    hosts = judge_hosts(d, F.col("__url_says"), "__url_host", z)

    total = hosts.agg(F.sum("n_pages")).first()[0] or 0
    wide = F.col("n_pages") * HOT >= total
    found = lambda keep, key: hosts.filter(keep).select(F.col("host").alias(key), F.struct("n", "bad", "bad_mean", "bad_bound").alias(key + "_is"))
    d = d.join(F.broadcast(found(wide, "__hot")), F.col("__url_host") == F.col("__hot"), "left")
    # a hot page meets no other host, under a key that spreads
    d = d.withColumn("__url_key", F.when(F.col("__hot").isNull(), F.col("__url_host")).otherwise(
        F.concat(F.lit("/"), F.xxhash64(url, F.rand(7)).cast("string"))))
    d = d.join(found(~wide, "__cold"), F.col("__url_key") == F.col("__cold"), "left")
    known = F.coalesce("__hot_is", "__cold_is")
    verdict = F.coalesce(F.col("__url_says"), F.when(known["bad_bound"] > max_bad, "block").otherwise("allow"))
    added = {"host": F.col("__url_host"), "path": F.col("__url_path"), "rule": F.col("__url_rule"), "verdict": verdict,
             "host_labelled": known["n"], "host_blocked": known["bad"], "bad_mean": known["bad_mean"],
             "bad_bound": known["bad_bound"]}
    return d.select(*[c for c in pages.columns if c not in added], *[c.alias(k) for k, c in added.items()])
