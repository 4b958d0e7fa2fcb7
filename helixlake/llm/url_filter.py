"""URL filter by rules and, where no rule fits, by empirical-Bayes host reputation.

Outcomes of labelled pages (bad or not) are counted per host. Beta-binomial priors shrink them
level by level: the corpus rate is the prior mean of a suffix, a suffix's posterior mean that of
its registered domains, and a domain's that of its hosts. Each level's prior strength comes from how much
its groups' rates vary around their own parents' means beyond chance. A host is blocked if the lower
quantile of its beta posterior exceeds the allowed rate, so a few bad pages on an unknown host don't block it.

For reputation a host goes without user-info, port and final dot, and an address is a unit of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.durable import apart, durable
from helixlake.llm.words import lowered

#: Some suffixes of two labels under which names are registered; a fuller table is a parameter.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "co.nz", "co.za")
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_BAD_RATE, Z, WEAKEST = 0.3, 1.96, 1.0
ADDRESS, ADDRESSES = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$", "(addresses)"


def host_of(url: Column | str) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' without."""
    return lowered(F.regexp_extract(_rest(url), "^([^/?#]*)", 1))


def path_of(url: Column | str) -> Column:
    """What follows the host up to `?`, `#` or the end; '' without."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def unit_of(host: Column) -> Column:
    """The host that reputation is about: without user-info, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$|\.$|\.?:[0-9]*$", "")


def _labels(host: Column, suffixes) -> Column:
    """How many labels the longest suffix of a unit has that is in the table; 1 if none is."""
    out = F.lit(1)
    for k in sorted({s.count(".") + 1 for s in suffixes}):
        out = F.when(F.substring_index(host, ".", -k).isin(*[s for s in suffixes if s.count(".") + 1 == k]), k).otherwise(out)
    return out


def suffix_of(host: Column, suffixes=LONG_SUFFIXES) -> Column:
    """Suffix of a unit; addresses have one for all of them."""
    return F.when(host.rlike(ADDRESS), ADDRESSES).otherwise(F.array_join(F.slice(F.split(host, r"\."), -F.least(_labels(host, suffixes), F.size(F.split(host, r"\."))), F.lit(99)), "."))


def domain_of(host: Column, suffixes=LONG_SUFFIXES) -> Column:
    """Registered domain of a unit: one label more than the suffix; an address is its own."""
    parts = F.split(host, r"\.")
    return F.when(host.rlike(ADDRESS), host).otherwise(F.array_join(F.slice(parts, -F.least(_labels(host, suffixes) + 1, F.size(parts)), F.lit(99)), "."))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does. A rule fits its host
    and all subdomains, if the path starts with its path."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = (F if rule is None else rule).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(kind))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule.otherwise(F.lit(None)), verdict.otherwise(F.lit(None))


def _strength(groups: DataFrame, most: float) -> float:
    """Prior strength of a level whose groups have n, bad and mean (their parent's rate), by moments: of a rate's
    squared distance from its mean, chance explains mean * (1 - mean) / n, and the share of the rest is 1 / (1 + k).
    At most as strong as all labelled pages together."""
    mean, n = F.col("mean"), F.col("n")
    chance = mean * (1 - mean)
    r = groups.where("n > 1").agg(F.sum(n * F.pow(F.col("bad") / n - mean, F.lit(2)) - chance).alias("excess"), F.sum(chance * (n - 1)).alias("whole")).first()
    if not r["whole"] or r["excess"] <= 0:
        return most
    return min(most, max(WEAKEST, r["whole"] / r["excess"] - 1))


def beta_quantile(a: Column, b: Column, z: float = -Z) -> Column:
    """Quantile of a beta distribution at normal deviate z, by cube roots of its two gammas (Wilson and Hilferty).

    Within 0.011 of the true one for a >= 0.3 and b >= 1. Where b is so small that the form breaks down, mean
    + z standard deviations, not below 0."""
    u, v, va, vb = 1 - 1 / (9 * a), 1 - 1 / (9 * b), 1 / (9 * a), 1 / (9 * b)
    p, q, r = v * v - z * z * vb, u * v, u * u - z * z * va
    inner = q * q - p * r
    root = (q + (F.lit(1.0) if z > 0 else F.lit(-1.0)) * F.sqrt(F.greatest(inner, F.lit(0.0)))) / F.when(p > 0, p)
    f = F.pow(F.greatest(root, F.lit(0.0)), F.lit(3))
    mean = a / (a + b)
    return F.when((p > 0) & (inner >= 0), a * f / (a * f + b)).otherwise(F.greatest(F.lit(0.0), mean + z * F.sqrt(mean * (1 - mean) / (a + b + 1))))


def reputation(outcomes: DataFrame, suffixes=LONG_SUFFIXES) -> DataFrame:
    """unit, bad_rate (posterior mean) and bad_low (lower quantile) of every host in outcomes.

    outcomes has host and bad (0, 1 or null for an unlabelled page): a host without labels takes
    its domain's rate. Counts are pre-aggregated and written once; a few numbers per level reach the driver.
    """
    counts = outcomes.groupBy(unit_of(F.col("host")).alias("unit")).agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = durable(counts.withColumns({"domain": domain_of(F.col("unit"), suffixes), "suffix": suffix_of(F.col("unit"), suffixes)}), "hosts")
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = whole["n"] or 0, whole["bad"] or 0
    most = float(max(1, n))
    post = lambda k: (F.col("bad") + k * F.col("mean")) / (F.col("n") + k)
    suffix_rows = total(hosts, "suffix").withColumn("mean", F.lit((bad + 1) / (n + 2)))
    rates = suffix_rows.select("suffix", post(_strength(suffix_rows, most)).alias("mean"))
    domain_rows = durable(total(hosts, "domain", "suffix").join(apart(rates, "suffix"), "suffix"), "domains")
    rates = domain_rows.select("domain", post(_strength(domain_rows, most)).alias("mean"))
    host_rows = durable(hosts.select("unit", "domain", "n", "bad").join(apart(rates, "domain"), "domain"), "host-priors")
    k = _strength(host_rows, most)
    a, b = F.col("bad") + k * F.col("mean"), F.col("n") - F.col("bad") + k * (1 - F.col("mean"))
    return host_rows.select("unit", post(k).alias("bad_rate"), beta_quantile(a, b).alias("bad_low"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, max_bad_rate: float = MAX_BAD_RATE, suffixes=LONG_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_low of each row of pages.

    outcomes as for `reputation`. Null urls and those without `://` have host and path '' and are
    judged like any host, as are very long ones. Hosts without an outcome row are allowed unless a rule blocks
    them; their bad_rate and bad_low are null. One host may hold most pages: its reputation is a single row, and
    the pages' side of the join is split by adaptive execution. Of rules that fit equally long, a block comes after an
    allow. Columns beyond id and url are ignored, whatever their names. Repeated rows are judged each; an empty
    table gives an empty one.
    """
    known = reputation(outcomes, suffixes)
    rows = pages.select(F.col(id_col).alias("__hl_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("unit", unit_of(F.col("host")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") > max_bad_rate, "block").otherwise("allow")
    return rows.join(known, "unit", "left").select(F.col("__hl_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "bad_low")


def numbered_outcomes(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """host and bad of each page whose path ends in a document's number: bad if that document is
    labelled toxic or of low quality, null if it isn't labelled."""
    number = F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.html|/)?$", 1)
    rows = pages.select(host_of(url).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    return rows.join(apart(bad, "doc_id"), "doc_id", "left").select("host", "bad")
