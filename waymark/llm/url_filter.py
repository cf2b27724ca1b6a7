"""Operator 4: URL filter by empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Each level's bad rate has a beta
prior around the rate of the level above: host around its domain's other hosts, domain around its suffix's other domains, suffix around all pages. A
prior's strength (its pseudo-count) is fitted for each level by the method of moments from how far the observed rates
spread beyond binomial noise. A host is blocked when the lower quantile of its beta posterior (by default 5 %, ``z`` = 1.645) is above
``limit``, that is when the posterior probability of a rate up to ``limit`` is below 5 %; so a host with few outcomes leans on its
domain. That probability is Paulson's form of the Wilson-Hilferty approximation, which is within 0.02 of the incomplete beta
function for the parameters that are tested. Hosts without outcomes take their domain's posterior mean as their prior, and so on up.

The suffix of a host is its last label, or its last two where they are in ``suffixes``, a table given by the caller (by default
``SUFFIXES``, usual public suffixes of two labels); the registered domain has one label more. An IPv4 or IPv6 address is a domain of its own, below a suffix that all addresses share.

Rules ``(host, path, verdict)`` outrank the reputation: a rule fits its host and all subdomains if the path starts with its path;
the longest wins. The rules are an argument, so their number is bounded by the caller.

Scale. Outcomes are pre-aggregated by host before any shuffle, so a host that holds a third of all pages is one row per task.
Reputations join to pages by host, broadcast while they are few, else by a shuffle that AQE may split.

Cases. A null url, or one without ``://``, has an empty host and path and takes the reputation of all such pages.
Null outcomes are ignored. Without any outcome every prior mean is 0.5, and the bound is below the limit:
all are allowed. Repeated rows are all judged and all counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import small, stored

#: Bounds of a prior's strength.
LEAST, MOST = 1.0, 200.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


# Public suffixes of two labels that are in wide use.
SUFFIXES = tuple(
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk asn.au com.au edu.au gov.au id.au net.au org.au ac.nz co.nz geek.nz govt.nz net.nz org.nz school.nz "
    "ac.jp ad.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp ac.kr co.kr go.kr ne.kr or.kr re.kr com.cn edu.cn gov.cn net.cn org.cn com.hk edu.hk gov.hk net.hk org.hk "
    "com.tw edu.tw gov.tw net.tw org.tw com.sg edu.sg gov.sg net.sg org.sg com.my edu.my gov.my net.my org.my ac.id co.id go.id or.id web.id ac.th co.th go.th in.th or.th "
    "ac.in co.in edu.in gov.in net.in org.in com.pk edu.pk gov.pk net.pk org.pk com.bd edu.bd gov.bd com.ph edu.ph gov.ph com.vn edu.vn gov.vn "
    "com.br edu.br gov.br net.br org.br com.ar edu.ar gob.ar gov.ar org.ar com.mx edu.mx gob.mx org.mx com.co edu.co gov.co com.pe edu.pe gob.pe com.ve com.ec com.uy "
    "com.tr edu.tr gov.tr org.tr ac.il co.il gov.il org.il com.sa edu.sa gov.sa com.eg edu.eg gov.eg ac.za co.za gov.za org.za web.za ac.ke co.ke go.ke or.ke com.ng edu.ng gov.ng "
    "com.ua edu.ua gov.ua net.ua org.ua com.pl edu.pl gov.pl net.pl org.pl ac.at co.at gv.at or.at com.gr edu.gr gov.gr com.pt edu.pt gov.pt com.es org.es gob.es".split()
)
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix, without user and port; an address as a whole."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last label, or the last two where the table has them; ``[address]`` for addresses."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), F.lit("[address]")).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def bare(host: Column) -> Column:
    return F.regexp_replace(F.substring_index(host, "@", -1), r":\d*$", "")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits; null if none does."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def strength(counts: DataFrame, prior: str) -> DataFrame:
    """One row ``k``: the pseudo-count of the prior of units ``(n, bad, <prior>)``, by the method of moments.

    With rate m and unit rates p, sum n (p - m)^2 is about sum m(1 - m)(1 + (n - 1) rho) for a beta of strength k = 1/rho - 1.
    """
    noise = F.sum(F.col(prior) * (1 - F.col(prior)))
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(prior), 2))
    weight = F.sum((F.col("n") - 1) * F.col(prior) * (1 - F.col(prior)))
    rho = (spread - noise) / F.nullif(weight, F.lit(0.0))
    return counts.where("n > 0").agg(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(1 / F.when(rho > 0, rho) - 1, F.lit(MOST)))).alias("k"))


def surely_above(a: Column, b: Column, limit: float) -> Column:
    """By how many standard normal deviates a beta(a, b) rate is above ``limit``: the normal quantile of the probability that it is."""
    ratio = F.cbrt(b * limit / (a * (1 - limit)))
    return (1 - 1 / (9 * a) - ratio * (1 - 1 / (9 * b))) / F.sqrt(1 / (9 * a) + ratio * ratio / (9 * b))


def reputations(outcomes: DataFrame, hosts: DataFrame, limit: float = 0.5, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``(host, mean, above)`` for every host of ``hosts(host)`` from ``outcomes(host, bad)``: the posterior mean of its bad
    rate and how surely that is above ``limit``."""
    seen = outcomes.where("bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    units = hosts.select("host").distinct().join(seen, "host", "full").na.fill(0.0, ["n", "bad"])
    units = stored(units.select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "bad"), "hosts")
    rate = ((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("up")
    one_row = F.broadcast
    suffixes = units.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(one_row(units.agg(rate)))
    suffixes = suffixes.join(one_row(strength(suffixes, "up")))
    suffixes = stored(suffixes.select("suffix", F.col("n").alias("sn"), F.col("bad").alias("sb"), F.col("up").alias("su"), F.col("k").alias("sk")), "suffixes")
    # a unit's prior is its parent's posterior from the parent's other units, so that no outcome counts twice
    domains = units.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(small(suffixes), "suffix")
    domains = domains.withColumn("up", (F.col("sb") - F.col("bad") + F.col("sk") * F.col("su")) / (F.col("sn") - F.col("n") + F.col("sk")))
    domains = domains.join(one_row(strength(domains, "up")))
    domains = stored(domains.select("domain", F.col("n").alias("dn"), F.col("bad").alias("db"), F.col("up").alias("du"), F.col("k").alias("dk")), "domains")
    known = units.join(small(domains), "domain")
    known = known.withColumn("up", (F.col("db") - F.col("bad") + F.col("dk") * F.col("du")) / (F.col("dn") - F.col("n") + F.col("dk")))
    known = known.join(one_row(strength(known, "up")))
    bad = F.col("bad") + F.col("k") * F.col("up")
    return known.select("host", (bad / (F.col("n") + F.col("k"))).alias("mean"), surely_above(bad, F.col("n") + F.col("k") - bad, limit).alias("above"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], limit: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url)``, from ``outcomes(url, bad)``."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = small(stored(reputations(outcomes.select(host_of(F.col("url")).alias("host"), "bad"), urls, limit, suffixes), "reputations"))
    own = F.when(F.col("above") > z, F.lit("block")).otherwise(F.lit("allow"))
    ruled = urls.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).join(known, "host", "left")
    return ruled.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), own).alias("verdict"))
