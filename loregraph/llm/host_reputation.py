"""URL filter: rules first, then the reputation of hosts by empirical Bayes.

Every page whose url fits a rule is a labelled outcome (blocked or not); other outcomes can be given.
Outcomes are counted per host, registered domain and suffix. Each level is a beta-binomial whose
prior mean is the posterior mean of the level above, so a host with few labelled pages is judged by
its domain, a domain with few by its suffix, and that by all pages:

    all -> suffix -> registered domain -> host

The strength of a prior (the number of outcomes it is worth) comes from two variances that add up:
the spread between the groups of a level, estimated from their overdispersion by the method of
moments, and the doubt about the level above. A level's spread is known no better than it has
groups, so that part is worth no more outcomes than there are groups with outcomes.

A page without a rule is blocked if its host is so with confidence: the lower bound of the
posterior share of blocked pages, ``Z`` standard deviations below its mean, reaches ``THRESHOLD``.

Only counts per host are shuffled, reduced map-side, so a host with a third of all pages is a row
per task. Of the levels above, one row per name meets the hosts; a table is broadcast only after a
check of its size. The driver sees one row of sums per level.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged as the
host '' of suffix '' without outcomes of its own; repeated rows count and come back each; a null
page_id stays; rules of equal length go in the order given; without any outcome all shares are one
half, with the widest bound, and nothing is blocked; further columns are left behind.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.operators.scale import hint_if_small
from loregraph.session import materialize

# The rules of the registered query, and second-level names under which
# countries register domains.
RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "or", "org"]

Z = 1.645
THRESHOLD = 0.5
LEAST_SPREAD, MOST_SPREAD = 1e-4, 0.95      # correlation of outcomes within a group
LEAST_STRENGTH = 0.05


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null; each rule is one comparison of a row."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """Last name of a host, or the last two where a country's second level is one of ``SECOND_LEVEL``;
    an address is its own suffix. User, port and a last dot don't count."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    second = F.regexp_extract(bare, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(bare.rlike(r"^[0-9.]+$"), bare).when(second != "", second).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one more name, where there is one."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    ahead = F.expr("''")
    ahead = F.when(F.length(bare) > F.length(suffix) + 1, F.substring_index(F.left(bare, F.length(bare) - F.length(suffix) - 1), ".", -1)).otherwise(ahead)
    return F.when(ahead == "", suffix).otherwise(F.concat(ahead, F.lit("."), suffix))


def strength_of(groups: DataFrame) -> float:
    """Strength of the prior of ``groups`` (``seen, blocked, prior``) from the spread between them: of a
    group of n outcomes with share p the squared error is n p (1 - p) (1 + (n - 1) r) on average, and
    the strength is 1 / r - 1."""
    expected = F.col("seen") * F.col("prior") * (1 - F.col("prior"))
    error = F.col("blocked") - F.col("seen") * F.col("prior")
    sums = groups.agg(F.sum(error * error - expected).alias("over"), F.sum(expected * (F.col("seen") - 1)).alias("pairs"),
                      F.count(F.when(F.col("seen") > 0, 1)).alias("groups")).first()
    spread = sums.over / sums.pairs if sums.pairs else MOST_SPREAD
    return min(1 / min(MOST_SPREAD, max(LEAST_SPREAD, spread)) - 1, max(1, sums.groups))


def posterior(groups: DataFrame) -> DataFrame:
    """Replace ``seen, blocked, prior, worth`` of a level by its posterior as ``prior, worth``: mean, and
    number of outcomes it is worth. In are those of the level above."""
    spread = strength_of(groups)
    strength = F.greatest(F.lit(LEAST_STRENGTH), 1 / (F.lit(1 / (spread + 1)) + 1 / (F.col("worth") + 1)) - 1)
    shrunk = (F.col("blocked") + strength * F.col("prior")) / (F.col("seen") + strength)
    names = [c for c in groups.columns if c not in ("seen", "blocked", "prior", "worth")]
    return groups.select(*names, shrunk.alias("prior"), (F.col("seen") + strength).alias("worth"))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``host, share, bound`` of each row of ``hosts`` (``host, seen, blocked``): posterior mean of the
    share of blocked pages, and its lower bound."""
    suffix = suffix_of(F.col("host"))
    own = materialize(hosts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    sums = [F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked")]
    every = own.agg(*sums).first()
    seen, blocked = every.seen or 0, every.blocked or 0
    above = own.groupBy("suffix").agg(*sums).withColumn("prior", F.lit((blocked + 0.5) / (seen + 1.0))).withColumn("worth", F.lit(seen + 1.0))
    above = posterior(materialize(above))
    above = posterior(materialize(own.groupBy("suffix", "domain").agg(*sums).join(hint_if_small(above), "suffix")))
    rows = posterior(materialize(own.join(hint_if_small(above), ["suffix", "domain"])))
    error = F.sqrt(F.col("prior") * (1 - F.col("prior")) / (F.col("worth") + 1))
    return rows.select("host", F.col("prior").alias("share"), F.greatest(F.lit(0.0), F.col("prior") - F.lit(Z) * error).alias("bound"))


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]] = RULES, outcomes: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, share, bound`` of every row of ``pages`` (``page_id, url``).

    ``outcomes`` (``host, blocked boolean``): more labelled outcomes, counted with those the rules give;
    its hosts are spelled as ``host_of`` does. Share and bound are rounded to four digits."""
    verdicts = {rule: verdict for verdict, rule in reversed(rules)}
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r for r, v in verdicts.items() if v == "block"])
    counts = rows.groupBy("host").agg(F.count("rule").alias("seen"), F.count(F.when(blocked, 1)).alias("blocked"))
    if outcomes is not None:
        more = outcomes.filter("host IS NOT NULL AND blocked IS NOT NULL").groupBy("host")
        more = more.agg(F.count("*").alias("seen"), F.count(F.when(F.col("blocked"), 1)).alias("blocked"))
        counts = counts.unionByName(more).groupBy("host").agg(F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked"))
    judged = materialize(host_reputation(counts))
    rows = rows.join(hint_if_small(judged), "host")
    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow"))
    verdict = verdict.when(F.col("bound") >= THRESHOLD, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                       F.round("share", 4).alias("share"), F.round("bound", 4).alias("bound"))
