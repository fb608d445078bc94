"""URL filters: empirical-Bayes reputation of hosts, under allow and block rules.

Labelled page outcomes are counted per host, registered domain and suffix. The bad rate
of a suffix shrinks to that of all pages, a domain's to its suffix's, a host's to its
domain's, each through a beta prior whose strength is fitted by moments from how far
the groups of that level differ. A prior comes from the labels of a parent's other members,
so no label counts twice. A host is blocked if the lower bound of its posterior
bad rate is over a limit, so few labels alone never block a host.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.common import column
from clientele.operators.skew import BROADCAST_ROWS
from clientele.sources.staging import staged, staged_counted


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
# Public suffixes of two labels, used where no table of suffixes is given; all others have one.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
                      "com.cn", "com.mx", "com.tr", "com.tw", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")

# Limit of the bad rate, and how many posterior deviations below its mean the bound lies.
LIMIT = 0.5
DEVIATIONS = 1.645
# Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0

# At most so many keys are sent to all tasks.
FREQUENT = 20_000

ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_rules(spark: SparkSession, names: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``names`` as a table of suffix rules."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("rule"))


def with_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts(host, ...)``, one row each, with public suffix and registered domain.

    ``rules(rule)`` are public suffixes in the usual notation: ``co.uk``, ``*.ck`` for any label, ``!www.ck`` for an
    exception. The longest rule that fits decides, exceptions first; without one the last label is the suffix. The domain
    has one label more, if the host has. User, port and a final dot don't count. An address in numbers or brackets
    is its own domain, and all addresses share the suffix ``[]``. NULL and empty rules fit nothing, repeated ones count once.
    """
    rules = rules.select(F.translate(F.trim("rule"), UPPER, LOWER).alias("rule")).filter("rule <> ''").distinct()
    rules, known = staged_counted(rules)
    # Tails of more labels than any rule has can't fit, so a host has few, however long it is.
    longest = rules.agg(F.max(F.size(F.split("rule", r"\."))).alias("n")).first()["n"] or 1
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", "(?s)^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    hosts = hosts.withColumn("bare", bare)
    tails = (hosts.select("host", "bare", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.regexp_count("bare", F.lit(r"\.")) + 1))).alias("labels"))
             .withColumn("tail", F.expr("substring_index(bare, '.', -labels)")))
    any_label = F.when(F.col("labels") > 1, F.concat(F.lit("*."), F.expr("substring_index(tail, '.', 1 - labels)")))
    keyed = tails.select("host", "labels", F.explode(F.array("tail", any_label, F.concat(F.lit("!"), "tail"))).alias("rule"))
    fits = keyed.join(F.broadcast(rules) if known <= BROADCAST_ROWS else rules, "rule")
    excepted = F.startswith("rule", F.lit("!"))
    found = fits.groupBy("host").agg(F.coalesce(F.max(F.when(excepted, F.col("labels") - 1)), F.max("labels")).alias("labels"))
    address = F.col("bare").rlike(ADDRESS)
    return (hosts.join(found, "host", "left").withColumn("labels", F.greatest(F.lit(1), F.coalesce("labels", F.lit(1))))
            .withColumns({"suffix": F.when(address, "[]").otherwise(F.expr("substring_index(bare, '.', -labels)")),
                          "domain": F.when(address, F.col("bare")).otherwise(F.expr("substring_index(bare, '.', -labels - 1)"))})
            .drop("bare", "labels"))


def _with_parent(rows: DataFrame, table: DataFrame, key: str, members: str, *spread: str) -> DataFrame:
    """``rows`` left joined to ``table``, one row a key, whose column ``members`` says how many rows of ``rows`` have it.

    Keys with over 1/FREQUENT of all rows, so fewer than FREQUENT keys, are sent to all tasks, and their rows are spread
    by ``spread`` in the join of the others; so no key makes a large task.
    """
    total = table.agg(F.sum(members).alias("n")).first()["n"] or 0
    values = [c for c in table.columns if c not in (key, members)]
    frequent = table.filter(F.col(members) * FREQUENT > total).select(key, F.struct(*values).alias("near"))
    others = table.filter(F.col(members) * FREQUENT <= total).select(key, F.lit(0).alias("piece"), F.struct(*values).alias("far"))
    piece = F.when(F.col("near").isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(0).cast("int")
    joined = rows.join(F.broadcast(frequent), key, "left").withColumn("piece", piece).join(others, [key, "piece"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("near")[c], F.col("far")[c]).alias(c) for c in values])


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; the list is compiled, so keep it short."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, mean: str) -> float:
    """Strength of the beta prior of one level, by moments, from (n, bad, mean of the parent)."""
    variance = F.col(mean) * (1 - F.col(mean))
    sums = groups.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(mean), 2)).alias("spread"),
        F.sum(variance).alias("expected"), F.sum(F.col("n") * variance).alias("full"))
    row = sums.first()
    if row["full"] is None or row["full"] - row["expected"] <= 0:
        return STRONGEST
    # spread is expected + rho * (full - expected), rho being the correlation of pages of a group.
    rho = (row["spread"] - row["expected"]) / (row["full"] - row["expected"])
    return STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, (1 - rho) / rho))


def host_reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """From (host, bad), ``bad`` 0, 1 or NULL for a page without a label: the posterior per host.

    One row per host, hosts without labels too: pages, n, bad, mean and deviation of the bad rate. ``suffixes(rule)`` is
    a table of public suffixes as ``with_domains`` takes it.
    """
    by_host = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    by_host = staged(with_domains(staged(by_host), suffix_rules(outcomes.sparkSession) if suffixes is None else suffixes))
    total = by_host.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    sums = [F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"), F.sum("bad").alias("bad")]

    def prior(of_rest: str, strength: float):
        """The parent's rate shrunk to its own prior, from the labels of the parent's other members."""
        return ((F.col("all_bad") - F.col("bad") + strength * F.col(of_rest))
                / (F.col("all_n") - F.col("n") + strength))
    above = ["members", F.col("n").alias("all_n"), F.col("bad").alias("all_bad"), F.col("prior").alias("above")]
    domains = staged(by_host.groupBy("suffix", "domain").agg(*sums))
    suffixes = staged(domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
                      .withColumn("prior", F.lit(base)))
    strength = _strength(suffixes, "prior")
    domains = _with_parent(domains, suffixes.select("suffix", F.col("members").alias("in_suffix"), *above[1:]), "suffix", "in_suffix", "domain")
    domains = staged(domains.select("domain", "members", "n", "bad", prior("above", strength).alias("prior")))
    strength = _strength(domains, "prior")
    hosts = _with_parent(by_host, domains.select("domain", *above), "domain", "members", "host")
    hosts = staged(hosts.select("host", "pages", "n", "bad", prior("above", strength).alias("prior")))
    strength = _strength(hosts, "prior")
    a = F.col("bad") + strength * F.col("prior")
    b = F.col("n") - F.col("bad") + strength * (1 - F.col("prior"))
    return hosts.select("host", "pages", "n", "bad", (a / (a + b)).alias("mean"),
                        F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1))).alias("deviation"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, limit: float = LIMIT,
               deviations: float = DEVIATIONS, page_col: str = "page_id", url_col: str = "url",
               label_page_col: str = "page_id", bad_col: str = "bad", suffixes: DataFrame | None = None) -> DataFrame:
    """Per page: host, path, the rule that decides (NULL if none), bound and verdict.

    ``labels`` has pages and whether each was bad (0, 1); several labels of a page are all
    bad if one is. NULL urls and those without ``://`` have an empty host and path, and share the
    reputation of the empty host. Repeated pages are judged each; other columns are
    ignored; without labels nothing but rules blocks; no pages give no rows. Urls are read whole, however
    long. ``suffixes(rule)`` replaces the short list of public suffixes.
    """
    url = column(pages, url_col)
    urls = pages.select(column(pages, page_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = labels.groupBy(column(labels, label_page_col).alias("page_id")).agg(F.max(column(labels, bad_col)).cast("long").alias("bad"))
    hosts = host_reputation(urls.select("page_id", "host").join(known, "page_id", "left"), suffixes)
    bounds = staged(hosts.select("host", "pages", F.greatest(F.lit(0.0), F.col("mean") - deviations * F.col("deviation")).alias("bad_bound")))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return (_with_parent(urls, bounds, "host", "pages", "page_id", "path")
            .select("page_id", "host", "path", name.alias("rule"), "bad_bound",
                    F.coalesce(verdict, F.when(F.col("bad_bound") > limit, "block").otherwise("allow")).alias("verdict")))
