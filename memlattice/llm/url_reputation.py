"""URL filtering by empirical-Bayes host reputation, with explicit rules first.

Labelled page outcomes (bad or not) are counted per host, registered domain (the
suffix and one label more) and suffix (the last label, or the longest of the 8,331
longer ones in `public_suffixes.txt`, or of another list in its form: `Settings.suffixes`).  Each level's rate is shrunk towards its
parent's by a beta-binomial prior,

    suffix: (k + M0 m) / (n + M0)      domain: (k + M1 suffix) / (n + M1)
    host:   Beta(k + M2 domain, n - k + M2 (1 - domain))

whose strengths M come from the moments of the observed rates at that level.  A
host, domain or suffix without labels has n = k = 0, that is its parent's rate, so
every host of the pages has a posterior.  A host is blocked when the lower `z`
bound of it exceeds `threshold`: only hosts that are bad beyond doubt go.

All is DataFrame work; pages and outcomes meet once, counts combine before they are shuffled,
so a host with a third of all pages is one row per task, and the counts of hosts, a
small table, are written; strengths and posteriors work on it alone.  Nothing but
two sums per level reaches the driver.

Defined results: a null url, or one without ://, has empty host and path and is
judged by the overall rate; rows that repeat are judged each; without labels
every page that no rule fits is allowed; an empty table gives no rows; columns
other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.shared import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.5
    z: float = 1.645
    least_correlation: float = 0.001
    most_correlation: float = 0.5
    suffixes: str = str(Path(__file__).with_name("public_suffixes.txt"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where there is no ://."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # later, longer rules win
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


@cache
def _suffix_rules(path: str) -> tuple[dict[int, list[str]], dict[int, list[str]], list[str]]:
    """Suffixes of two labels or more and parents of wildcards, both by number of labels, and names that no wildcard takes."""
    names: dict[int, set[str]] = {}
    wild: dict[int, set[str]] = {}
    spared = set()
    for rule in Path(path).read_text(encoding="utf-8").splitlines():
        if rule.startswith("//"):
            continue
        n = rule.count(".") + 1
        if rule.startswith("*."):
            wild.setdefault(n, set()).add(rule[2:])
        elif rule.startswith("!"):
            spared.add(rule[1:])
            names.setdefault(n - 1, set()).add(rule.partition(".")[2])
        else:
            names.setdefault(n, set()).add(rule)
    return {n: sorted(v) for n, v in names.items()}, {n: sorted(v) for n, v in wild.items()}, sorted(spared)


def _one_of(name: str, values: Sequence[str]) -> str:
    quoted = ", ".join(f"'{v}'" for v in values)  # letters, digits, dots and hyphens only
    return f"{name} IN ({quoted})" if values else "false"


def with_domain(hosts: DataFrame, suffixes: str = Settings.suffixes) -> DataFrame:
    """`hosts` with the registered domain and public suffix of column host."""
    names, wild, spared = _suffix_rules(suffixes)
    cases = []
    for n in sorted(names.keys() | wild.keys(), reverse=True):
        if n > 1:
            last, parent = f"substring_index(host, '.', -{n})", f"substring_index(host, '.', -{n - 1})"
            taken = f"({_one_of(parent, wild.get(n, []))} AND NOT {_one_of(last, spared)})"
            cases.append(f"WHEN {_one_of(last, names.get(n, []))} OR {taken} THEN {n}")
    labelled = hosts.withColumn("_labels", F.expr(f"CASE {' '.join(cases)} ELSE 1 END"))
    domain, suffix = F.expr("substring_index(host, '.', -_labels - 1)"), F.expr("substring_index(host, '.', -_labels)")
    return labelled.withColumn("domain", domain).withColumn("suffix", suffix).drop("_labels")


def _strength(level: DataFrame, settings: Settings) -> float:
    """Prior strength from rows (n, k, parent): the moment estimate of the correlation within a unit."""
    spread = F.col("parent") * (1 - F.col("parent"))
    row = level.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("parent"), 2)),
        F.sum(spread),
        F.sum(spread * (F.col("n") - 1)),
    ).first()
    seen, expected, slope = (float(x or 0) for x in row)
    rho = (seen - expected) / slope if slope > 0 else settings.least_correlation
    rho = min(max(rho, settings.least_correlation), settings.most_correlation)
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, float]:
    """(host, n, bad_rate, bad_bound) of every host from rows (host, bad 0, 1 or null), and the overall rate."""
    settings = settings or Settings()
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = written(with_domain(hosts, settings.suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n"), F.sum("k")).first()
    overall = (float(total[1] or 0) + 0.5) / (float(total[0] or 0) + 1)
    m0 = _strength(suffixes.withColumn("parent", F.lit(overall)), settings)
    shrunk = lambda m: (F.col("k") + m * F.col("parent")) / (F.col("n") + m)
    suffix_rate = suffixes.withColumn("parent", F.lit(overall)).select("suffix", shrunk(m0).alias("parent"))
    domains = domains.join(suffix_rate, "suffix")
    m1 = _strength(domains, settings)
    domain_rate = domains.select("domain", "suffix", shrunk(m1).alias("parent"))
    hosts = hosts.join(domain_rate, ["domain", "suffix"])
    m2 = _strength(hosts, settings)
    a, b = F.col("k") + m2 * F.col("parent"), F.col("n") - F.col("k") + m2 * (1 - F.col("parent"))
    mean = a / (a + b)
    bound = mean - settings.z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", mean.alias("bad_rate"), bound.alias("bad_bound")), overall


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = (),
    settings: Settings | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, bad_rate of every page.

    `outcomes` has rows (page_id, bad 0/1) for some pages; of several rows for
    one page the worst counts.
    """
    settings = settings or Settings()
    url = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = url_parts(F.col("_url"))
    parts = url.select("page_id", host.alias("host"), path.alias("path"))
    worst = outcomes.select(F.col("page_id").cast("long"), F.col("bad").cast("int")).where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    reputation, overall = host_reputation(parts.select("page_id", "host").join(worst, "page_id", "left"), settings)
    name, verdict = rule_for(rules, F.col("host"), F.col("path"))
    judged = F.when(F.col("bad_bound") > settings.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(reputation, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, judged).alias("verdict"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_labelled"), F.coalesce("bad_rate", F.lit(overall)).alias("bad_rate"),
    )


def page_outcomes(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(page_id, bad) from labels quality and toxic: low quality or toxic is bad; both null is no outcome."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.coalesce("toxic", "quality").isNotNull(), 0)
    return labels.select(F.col(id_col).cast("long").alias("page_id"), bad.alias("bad"))
