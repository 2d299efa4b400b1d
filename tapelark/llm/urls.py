"""URL filters: fixed allow and block rules, then empirical-Bayes host reputation.

Labelled pages are counted by host. A host's share of bad pages is shrunk through beta-binomial priors
along host, registered domain and suffix: each level's posterior mean is the prior mean of the level
below, and each level's prior strength is fitted by moments over all its members. A page is blocked if
the lower posterior bound of its host's share is above ``MAX_BAD``; hosts without labels are judged by
the posterior of the nearest level that has some.

Rules are a table, joined to hosts by the suffixes of each host; a page then takes the longest of its host's
rules whose path it begins with. Any number of rules goes this way.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged
by the overall share; labels that are null do not count; repeated rows count as often as they come.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelark.llm import priors
from tapelark.llm.common import LOWER, UPPER, materialize, sized


@dataclass(frozen=True)
class Rule:
    """``host/path`` prefix with its verdict; fits the host, its subdomains and paths that begin with the path."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)
#: Labels that, before a country's two letters, are a suffix of two labels under which domains are registered.
SECOND_LEVEL = ("ac", "biz", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "id", "info", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
MAX_BAD, BOUND = 0.3, 1.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered, and path; both empty where there is no ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(known, path).otherwise("")


def rules_of(hosts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(host, rules): for hosts that have some, the rules of the host and of what it is a subdomain of, longest first, of equal length by text."""
    kind = "rule_host string, path string, rule string, verdict string"
    listed = materialize(hosts.sparkSession.createDataFrame([(r.host, r.path, r.pattern, r.verdict) for r in rules], kind), "rules")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(sized(listed), "rule_host")
    one = F.struct((-F.length("rule")).alias("size"), "rule", "path", "verdict")
    return fits.groupBy("host").agg(F.sort_array(F.collect_set(one)).alias("rules"))


def _long(host: Column, extra: tuple[str, ...]) -> Column:
    """Whether the suffix under which a host's domain is registered has two labels."""
    last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    national = last.rlike("^[a-z]{2}$") & F.substring_index(two, ".", 1).isin(*SECOND_LEVEL) & (two != last)
    return national | two.isin(*extra) if extra else national


def suffix_of(host: Column, extra: tuple[str, ...] = ()) -> Column:
    """The last label, or the last two: of a country's second level, or one of ``extra``."""
    return F.when(_long(host, extra), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, extra: tuple[str, ...] = ()) -> Column:
    """The suffix with the label before it."""
    return F.when(_long(host, extra), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _shrunk(counts: DataFrame, mean: str) -> DataFrame:
    """``counts`` (bad, n, prior mean) with ``mean`` and ``sd`` of the posterior under a strength fitted to all rows."""
    fit = counts.agg(priors.correlation(F.col("bad"), F.col("n"), F.col("prior")).alias("rho"))
    at = (F.col("bad"), F.col("n"), F.col("prior"), priors.strength(F.col("rho")))
    out = counts.crossJoin(F.broadcast(fit))  # one row
    return out.withColumn(mean, priors.mean(*at)).withColumn("sd", priors.spread(*at))


def reputation(outcomes: DataFrame, all_hosts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(host, n, share, low) for each host: labelled pages, posterior mean and lower bound of the bad share.

    ``outcomes`` has (host, bad) with bad 0, 1 or null; ``all_hosts`` has distinct ``host``.
    """
    tally = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.sum("bad").cast("long").alias("bad"), F.count(F.lit(1)).alias("n"))
    tally = materialize(tally.withColumn("domain", domain_of(F.col("host"), extra)).withColumn("suffix", suffix_of(F.col("host"), extra)), "tally")
    whole = tally.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("prior"))
    whole = materialize(whole, "overall")
    sums = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    suffixes = _shrunk(tally.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(whole)), "m_suffix").select("suffix", "m_suffix")
    suffixes = materialize(suffixes, "suffixes")
    domains = tally.groupBy("domain", "suffix").agg(*sums).join(sized(suffixes), "suffix").withColumnRenamed("m_suffix", "prior")
    domains = materialize(_shrunk(domains, "m_domain").select("domain", "m_domain"), "domains")
    hosts = tally.join(sized(domains), "domain").withColumnRenamed("m_domain", "prior")
    fit = materialize(hosts.agg(priors.correlation(F.col("bad"), F.col("n"), F.col("prior")).alias("rho")), "fit")
    named = all_hosts.withColumn("domain", domain_of(F.col("host"), extra)).withColumn("suffix", suffix_of(F.col("host"), extra))
    every = (
        named.join(tally.select("host", "bad", "n"), "host", "left")
        .join(sized(domains), "domain", "left").join(sized(suffixes), "suffix", "left").crossJoin(F.broadcast(whole))
        .crossJoin(F.broadcast(fit))
        .select("host", F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("n", F.lit(0)).alias("n"),
                F.coalesce("m_domain", "m_suffix", "prior").alias("prior"), F.coalesce("rho", F.lit(priors.RHO_HIGH)).alias("rho"))
    )
    at = (F.col("bad"), F.col("n"), F.col("prior"), priors.strength(F.col("rho")))
    share = priors.mean(*at)
    return every.select("host", "n", share.alias("share"), (share - BOUND * priors.spread(*at)).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, extra: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with host, path, rule, share, low, verdict, in place of columns of those names; ``outcomes`` has (url, bad) for labelled pages.

    ``extra`` are further suffixes of two labels under which domains are registered.
    """
    host, path = split_url(F.col(url_col))
    held = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    labelled = outcomes.select(split_url(F.col("url"))[0].alias("host"), "bad")
    hosts = materialize(held.select("host").distinct(), "hosts")
    known = reputation(labelled, hosts, extra).join(rules_of(hosts, rules), "host", "left")
    known = materialize(known.withColumnRenamed("host", "_host"), "reputation")
    out = held.join(sized(known), F.col("host") == F.col("_host"), "left")
    fit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    by_share = F.when(F.col("low") > MAX_BAD, "block").otherwise("allow")
    made = {
        "host": F.col("host"), "path": F.col("path"), "rule": fit["rule"], "share": F.col("share"), "low": F.col("low"),
        "verdict": F.coalesce(fit["verdict"], by_share),
    }
    return out.select(*[F.col("row")[c].alias(c) for c in pages.columns if c not in made], *[c.alias(k) for k, c in made.items()])
