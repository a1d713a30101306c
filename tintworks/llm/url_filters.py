"""URL filters: explicit host and path rules, then an empirical-Bayes reputation of the host.

Everything is DataFrame functions.  A rule fits its host and all subdomains of it
where the url's path starts with the rule's path; the longest rule that fits
decides.  Where none fits, the verdict comes from labelled page outcomes: the
share of bad pages of a host is shrunk through beta-binomial priors from host to
registered domain to public suffix to the whole table.  The strength of each
level's prior is estimated from the data by moments.  A page is blocked where the
lower bound of its host's posterior share of bad pages exceeds the limit.

Edge cases: a null url, or one without "://", has an empty host and path and is
judged as the host ""; labels that are null, other than 0 and 1 or contradictory
for an id are left out; without any label nothing is blocked by reputation;
repeated pages are each labelled and each returned; empty tables give empty
results.  Other columns pass through, unless they have a result's name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, given

# Public suffixes of more than one label that registered domains stand under.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")

_SUFFIX = "(" + "|".join(s.replace(".", r"\.") for s in LONG_SUFFIXES) + r"|[^.]*)\z"
SUFFIX_PATTERN = r"(^|\.)" + _SUFFIX
DOMAIN_PATTERN = r"([^.]*\.)?" + _SUFFIX


@dataclass(frozen=True)
class Rule:
    """`host/path`, e.g. `example.com/en/`; verdict is allow or block."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


@dataclass(frozen=True)
class ReputationConfig:
    limit: float = 0.5
    z: float = 1.645
    least_strength: float = 2.0
    most_strength: float = 1000.0


def url_host(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*", 0)).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The pattern of the longest rule that fits, else null."""
    ranked = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    return F.coalesce(*[F.when(_fits(r, host, path), F.lit(r.pattern)) for r in ranked], F.lit(None).cast("string"))


def _strength(units: DataFrame, config: ReputationConfig) -> DataFrame:
    """One row: the prior strength of a level, from the spread of its units' bad shares."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    sums = units.where("n > 0").agg(
        *[F.coalesce(F.sum(x).cast("double"), F.lit(0.0)).alias(a) for a, x in (("n1", F.col("n")), ("k1", F.col("k")), ("n2", wide("n") * wide("n")), ("nk", wide("n") * wide("k")), ("k2", wide("k") * wide("k")))]
    )
    p = F.when(F.col("n1") > 0, F.col("k1") / F.col("n1")).otherwise(0.0)
    within, spread = F.col("p") * (1 - F.col("p")), F.col("k2") - 2 * F.col("p") * F.col("nk") + F.col("p") * F.col("p") * F.col("n2")
    base = (F.col("n2") - F.col("n1")) * within
    rho = F.when(base > 0, (spread - F.col("n1") * within) / base).otherwise(0.0)
    bounded = F.greatest(F.least(rho, F.lit(1 / (1 + config.least_strength))), F.lit(1 / (1 + config.most_strength)))
    return sums.withColumn("p", p).select("p", (1 / bounded - 1).alias("s"))


def host_reputation(outcomes: DataFrame, config: ReputationConfig | None = None) -> DataFrame:
    """From (host, bad or null): each host's labelled counts, posterior mean and lower bound of its bad share."""
    config = config or ReputationConfig()
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("k"))
    hosts = hosts.withColumns({"domain": F.regexp_extract("host", DOMAIN_PATTERN, 0), "suffix": F.regexp_extract("host", SUFFIX_PATTERN, 2)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # each strength is one row, so these joins with it are of one row
    top = suffixes.join(F.broadcast(_strength(suffixes, config))).select("suffix", ((F.col("k") + F.col("s") * F.col("p")) / (F.col("n") + F.col("s"))).alias("mean"))
    middle = domains.join(top, "suffix").join(F.broadcast(_strength(domains, config))).select("domain", ((F.col("k") + F.col("s") * F.col("mean")) / (F.col("n") + F.col("s"))).alias("mean"))
    a, b = F.col("k") + F.col("s") * F.col("mean"), F.col("n") - F.col("k") + F.col("s") * (1 - F.col("mean"))
    low = hosts.join(middle, "domain").join(F.broadcast(_strength(hosts, config))).select("host", "n", "k", a.alias("a"), b.alias("b"))
    total = F.col("a") + F.col("b")
    mean = F.col("a") / total
    return low.select("host", "n", "k", mean.alias("bad_share"), (mean - config.z * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))).alias("bad_bound"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], config: ReputationConfig | None = None, *, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """`pages` with host, path, rule, verdict, n_labelled and bad_bound.

    A page's outcome is the label of its id: quality 0 is bad.  One aggregation by
    host with partial sums, so a hot host costs no more than any; the join back
    leaves a small side to Spark's size check and splits a hot host's pages
    otherwise (adaptive skew join).
    """
    config = config or ReputationConfig()
    added = ("host", "path", "rule", "verdict", "n_labelled", "bad_bound")
    known = labels.where(column(label).isin(0, 1)).groupBy(column(label_id).alias("i")).agg(F.min(column(label)).alias("y"), F.max(column(label)).alias("z")).where("y = z").select("i", (1 - F.col("y")).alias("bad"))
    outcomes = pages.select(column(page_id).alias("i"), url_host(column(url)).alias("host")).join(known, "i", "left").select("host", "bad")
    reputation = host_reputation(outcomes, config).select(F.col("host").alias("h"), F.col("n").alias("n_labelled"), "bad_bound")
    parsed = pages.select(given(pages, *added).alias("given"), url_host(column(url)).alias("host"), url_path(column(url)).alias("path")).withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r.pattern, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))
    by_host = F.when(F.col("bad_bound") > config.limit, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(reputation, F.col("host") == F.col("h"), "left").select("given.*", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), "n_labelled", "bad_bound")


def oracle_sql(rules: Sequence[Rule], config: ReputationConfig | None = None) -> str:
    """The same for `pages` and `labels`, in DuckDB SQL."""
    config = config or ReputationConfig()
    ranked = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    fit = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r.pattern}'" for r in ranked) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r.pattern}' THEN '{r.verdict}'" for r in rules) + f" WHEN bad_bound > {config.limit} THEN 'block' ELSE 'allow' END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def strength(units: str) -> str:
        return f"""(SELECT p, 1::DOUBLE / greatest(least(CASE WHEN (n2 - n1) * (p * (1 - p)) > 0
            THEN (k2 - 2 * p * nk + p * p * n2 - n1 * (p * (1 - p))) / ((n2 - n1) * (p * (1 - p))) ELSE 0 END,
            {1 / (1 + config.least_strength)!r}::DOUBLE), {1 / (1 + config.most_strength)!r}::DOUBLE) - 1 AS s
          FROM (SELECT *, CASE WHEN n1 > 0 THEN k1 / n1 ELSE 0::DOUBLE END AS p FROM (
            SELECT coalesce(sum(n), 0)::DOUBLE AS n1, coalesce(sum(k), 0)::DOUBLE AS k1, coalesce(sum(n * n), 0)::DOUBLE AS n2,
              coalesce(sum(n * k), 0)::DOUBLE AS nk, coalesce(sum(k * k), 0)::DOUBLE AS k2 FROM {units} WHERE n > 0)))"""

    return f"""
WITH known AS (SELECT doc_id, 1 - min(quality) AS bad FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
split AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
hosts AS (SELECT host, regexp_extract(host, '{DOMAIN_PATTERN}') AS domain, regexp_extract(host, '{SUFFIX_PATTERN}', 2) AS suffix,
  count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM parsed LEFT JOIN known ON doc_id = page_id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY suffix),
top AS (SELECT suffix, (k + s * p) / (n + s) AS mean FROM suffixes, {strength("suffixes")}),
middle AS (SELECT domain, (k + s * mean) / (n + s) AS mean FROM domains JOIN top USING (suffix), {strength("domains")}),
low AS (SELECT host, n, k + s * mean AS a, n - k + s * (1 - mean) AS b FROM hosts JOIN middle USING (domain), {strength("hosts")}),
reputation AS (SELECT host, n AS n_labelled, a / (a + b) - {config.z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bad_bound FROM low),
judged AS (SELECT page_id, host, path, {rule} AS rule, n_labelled, bad_bound FROM parsed LEFT JOIN reputation USING (host))
SELECT page_id, host, path, rule, {verdict} AS verdict, n_labelled::BIGINT AS n_labelled, round(bad_bound, 6) AS bad_bound FROM judged"""
