"""URL filter: curated rules first, then an empirical-Bayes host reputation.

Every step is a DataFrame expression. Page outcomes (good or not) are counted per host, registered domain and public suffix; each
level is a beta-binomial whose prior is centred on the posterior mean of the level above, down from suffix to host, so that
a host with few outcomes borrows from its domain, and a domain from its suffix. How many outcomes the level above counts for is
estimated from the outcomes: pairs of outcomes of one group agree more often than pairs of its parent by the correlation
1 / (strength + 1). A host is blocked when the upper posterior bound of its share of good pages stays below a limit.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed unless the outcomes
of the empty host say otherwise; repeated rows are judged alike and all returned; an empty table gives an empty result.
Other columns of the input are not touched or returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import materialize, small


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host and a path prefix, as in ``example.com/en/``; ``verdict`` is allow or block."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


@dataclass(frozen=True)
class Reputation:
    """``strength``: what the level above counts for where outcomes don't tell; ``least`` and ``most``: its bounds; ``z``: width of
    the bound in standard deviations; ``limit``: a host whose upper bound lies below it is blocked."""

    strength: float = 8.0
    least: float = 1.0
    most: float = 200.0
    z: float = 2.0
    limit: float = 0.5


# Public suffixes of two labels in common use; any other suffix is the last label.
TWO_LABELS = (
    "co.uk org.uk me.uk ltd.uk plc.uk net.uk sch.uk ac.uk gov.uk com.au net.au org.au edu.au gov.au id.au co.nz net.nz org.nz ac.nz govt.nz "
    "co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr ac.kr go.kr com.br net.br org.br gov.br com.ar com.mx org.mx com.co com.pe com.cn net.cn org.cn gov.cn edu.cn "
    "com.tw org.tw com.hk org.hk com.sg edu.sg com.my co.id co.th co.in net.in org.in ac.in gov.in com.pk com.bd com.tr org.tr com.ua co.il org.il co.za org.za com.eg com.ng co.ke com.sa"
).split()


AUTHORITY = r"^(?s).*?://([^/?#]*)"
PATH = r"^(?s).*?://[^/?#]*([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there are none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, AUTHORITY, 1), upper, lower), F.regexp_extract(url, PATH, 1)


def match_rules(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of pattern and verdict; null if none fits."""

    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)

    ordered = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    chosen = reduce(lambda c, r: c.when(fits(r), F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))), ordered[1:], F.when(fits(ordered[0]), F.struct(F.lit(ordered[0].pattern).alias("rule"), F.lit(ordered[0].verdict).alias("verdict"))))
    return chosen


def suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    """The public suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(two)


def host_reputation(outcomes: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """From (host, good) rows: host, n, mean and upper bound of the posterior share of good pages.

    Hosts without outcomes don't appear; ``judge`` gives them their domain's or suffix's posterior.
    """
    return _levels(outcomes, p)[0]


def _strength(level: DataFrame, above: DataFrame, on: list[str], p: Reputation) -> float:
    """By moments: pairs of good outcomes in a group beyond those that its parent's share gives, over the most there could be."""
    share = F.col("_k") / F.col("_n")
    pairs = F.col("n") * (F.col("n") - 1)
    rows = level.join(above.select(*on, F.col("k").alias("_k"), F.col("n").alias("_n")), on) if on else level.crossJoin(F.broadcast(above.select(F.col("k").alias("_k"), F.col("n").alias("_n"))))
    more, most = rows.agg(F.sum(F.col("k") * (F.col("k") - 1) - pairs * share * share), F.sum(pairs * share * (1 - share))).first()
    if not most:
        return p.strength
    correlation = min(max(more / most, 1 / (p.most + 1)), 1 / (p.least + 1))
    return round(1 / correlation - 1, 3)


def _levels(outcomes: DataFrame, p: Reputation) -> tuple[DataFrame, DataFrame, DataFrame]:
    host = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    host = materialize(host.where("n > 0").withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))}))
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    # Totals and strengths are four numbers, whatever the data's size.
    n, k = whole.first()
    of_suffix, of_domain, of_host = _strength(tops, whole, [], p), _strength(domain, tops, ["suffix"], p), _strength(host, domain, ["domain", "suffix"], p)

    def posterior(level: DataFrame, strength: float) -> DataFrame:
        a, b = F.col("prior") * strength + F.col("k"), (1 - F.col("prior")) * strength + F.col("n") - F.col("k")
        level = level.withColumns({"a": a, "b": b})
        a, b = F.col("a"), F.col("b")
        mean = a / (a + b)
        spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        return level.withColumns({"mean": mean, "upper": mean + p.z * spread}).drop("prior", "a", "b")

    tops = posterior(tops.withColumn("prior", F.lit((k + 1) / (n + 2))), of_suffix)
    domain = posterior(domain.join(tops.select("suffix", F.col("mean").alias("prior")), "suffix"), of_domain)
    host = posterior(host.join(domain.select("domain", F.col("mean").alias("prior")), "domain"), of_host)
    return host.select("host", "n", "mean", "upper"), domain.select("domain", "mean", "upper"), tops.select("suffix", "mean", "upper")


def judge(pages: DataFrame, rules: list[Rule], outcomes: DataFrame | None = None, p: Reputation = Reputation()) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, reputation (upper bound of its host, or of what its host lies in).

    ``outcomes`` has (host, good) rows of labelled pages. Without it the pages that a rule decides are the labelled ones:
    allowed pages are good, blocked ones are not.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("fit", match_rules(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        outcomes = urls.where(F.col("fit").isNotNull()).select("host", (F.col("fit.verdict") == "allow").alias("good"))
    hosts, domains, tops = _levels(outcomes, p)
    # One reputation per host of the corpus, so that the wide join below has a single small-keyed side.
    every = urls.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    every = every.join(hosts.select("host", F.col("upper").alias("of_host")), "host", "left")
    every = every.join(domains.select("domain", F.col("upper").alias("of_domain")), "domain", "left")
    every = every.join(tops.select("suffix", F.col("upper").alias("of_suffix")), "suffix", "left")
    every = materialize(every.select("host", F.coalesce("of_host", "of_domain", "of_suffix", F.lit(1.0)).alias("reputation")))
    judged = urls.join(small(every), "host", "left")
    method = F.when(F.col("reputation") < p.limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "reputation")
