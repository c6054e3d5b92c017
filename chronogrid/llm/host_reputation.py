"""Empirical-Bayes host reputation: beta-binomial shrinkage from host to registered domain to suffix.

DataFrame operations only.  Labelled page outcomes (bad: quality 0 or toxic 1) are counted per host.  At
each level the strength m of the prior is the moment estimate of a beta-binomial over that level's groups,
held within STRENGTH (below 2 a prior says nothing, and groups without spread would give an infinite one; fewer
than two labelled groups tell nothing and give 2).  Its mean is the posterior mean one level up.  Outcomes of
one group are alike, so n of them count one level up as the n (m + 1) / (n + m) independent ones that hold as
much: one bad domain does not make a bad suffix.  A posterior's variance is its own plus the prior's, times the
squared weight of the prior.  A host is blocked where the lower posterior bound of its bad rate exceeds
`max_bad`; hosts without labels get their domain's prior.  Explicit rules go first.

For grouping only, user info, port and final dots are taken off a host.  Its suffix is its last two labels
where `suffixes` has them, else its last label, and its registered domain has one label more; an IP address is
its own domain, under the suffix `ip`.

Defined results: a null url or one without `://` has an empty host and path, takes part in no reputation and
is allowed; null labels count as no outcome; repeated labels are separate outcomes; with no labels at all
every page outside the rules is allowed; repeated pages are judged alike; of equally long rules that fit, the
one that sorts last holds; a bound equal to `max_bad` allows; a url of any length is one row; an empty table
gives no rows; other columns of `pages` and `labels`, clashing names included, are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: (host, path, verdict): the fixed rules of the query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MAX_BAD, Z = 0.25, 1.645
STRENGTH = (2.0, 200.0)
#: Public suffixes of two labels under which names are registered.
SUFFIXES = tuple("""
co.uk org.uk me.uk net.uk ac.uk gov.uk ltd.uk plc.uk sch.uk nhs.uk police.uk com.au net.au org.au edu.au gov.au id.au
co.nz net.nz org.nz ac.nz govt.nz co.za org.za ac.za gov.za co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr ac.kr go.kr
com.cn net.cn org.cn edu.cn gov.cn com.tw org.tw edu.tw gov.tw com.hk org.hk edu.hk gov.hk com.sg org.sg edu.sg gov.sg
com.my org.my edu.my gov.my co.in net.in org.in ac.in gov.in co.id or.id ac.id go.id co.th or.th ac.th go.th
com.vn edu.vn gov.vn com.ph edu.ph gov.ph com.pk edu.pk gov.pk com.br net.br org.br edu.br gov.br com.mx org.mx edu.mx
gob.mx com.ar org.ar edu.ar gob.ar com.co edu.co gov.co com.pe edu.pe gob.pe com.ve com.ec com.uy com.tr org.tr edu.tr
gov.tr co.il org.il ac.il gov.il com.ua org.ua edu.ua gov.ua com.pl net.pl org.pl edu.pl gov.pl com.eg com.sa com.ng
co.ke com.gh
""".split())


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits with the longest host and path, as text, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grouped(host: Column) -> Column:
    """The host without user info, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def domain_and_suffix(name: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host as grouped() returns it."""
    address = name.rlike(r"^([0-9.]+|\[.*\])$")
    two = F.substring_index(name, ".", -2).isin(*suffixes) if suffixes else F.lit(False)
    suffix = F.when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(address, name).otherwise(domain), F.when(address, "ip").otherwise(suffix)


def prior_strength(groups: DataFrame) -> float:
    """Moment estimate of alpha + beta over groups with n trials and y successes."""
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    row = groups.where("n > 0").agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(y).alias("y"), F.sum(n * n).alias("nn"), F.sum(y * y / n).alias("yy")).first()
    low, high = STRENGTH
    if row.k < 2:
        return low
    p = row.y / row.n
    within, spread = p * (1 - p), row.n - row.nn / row.n
    between = (row.yy - row.y * row.y / row.n - (row.k - 1) * within) / spread if spread > 0 else 0.0
    return min(high, max(low, within / between - 1)) if between > 0 else high


def host_reputation(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    max_bad: float = MAX_BAD,
    z: float = Z,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_lower for every row of `pages`.

    `labels` has doc_id (a page_id), quality and toxic.  The shuffles carry urls or counts, never html; the
    page counts of a hot host are summed before they are shuffled.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("name", grouped(F.col("host")))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null")
    counted = urls.select("page_id", "name").where("name <> ''").join(outcomes, "page_id", "left").groupBy("name").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    domain, suffix = domain_and_suffix(F.col("name"), suffixes)
    hosts = materialize(counted.select("name", domain.alias("domain"), suffix.alias("suffix"), "n", "y"), "hosts")
    n, y = F.sum("n").alias("n"), F.sum("y").alias("y")
    m_suffix, m_domain, m_host = (prior_strength(x) for x in (hosts.groupBy("suffix").agg(n, y), hosts.groupBy("domain", "suffix").agg(n, y), hosts))
    ratio = lambda m: (m + 1) / (F.col("n") + m)
    independent = lambda groups, m, *keys: groups.select(*keys, (F.col("n") * ratio(m)).alias("n"), (F.col("y") * ratio(m)).alias("y"))
    domains = independent(hosts, m_host, "domain", "suffix").groupBy("domain", "suffix").agg(n, y)
    suffixes = independent(domains, m_domain, "suffix").groupBy("suffix").agg(n, y)
    total = independent(suffixes, m_suffix).agg(n, y).first()
    mean = ((total.y or 0) + 0.5) / ((total.n or 0) + 1)
    var = mean * (1 - mean) / ((total.n or 0) + 2)

    def posterior(groups: DataFrame, m: float, *keys: str) -> DataFrame:
        """keys, p and var of groups with n, y and their prior's p and var."""
        p = (F.col("y") + F.col("p") * m) / (F.col("n") + m)
        own = groups.withColumn("q", p)
        return own.select(*keys, F.col("q").alias("p"), (F.col("q") * (1 - F.col("q")) / (F.col("n") + m + 1) + F.col("var") * F.pow(m / (F.col("n") + m), F.lit(2.0))).alias("var"))

    by_suffix = posterior(suffixes.withColumns({"p": F.lit(mean), "var": F.lit(var)}), m_suffix, "suffix")
    by_domain = posterior(domains.join(by_suffix, "suffix"), m_domain, "domain", "suffix")
    rated = posterior(hosts.join(by_domain, ["domain", "suffix"]), m_host, "name")
    rated = broadcast_if_small(materialize(rated.select("name", F.col("p").alias("bad_mean"), (F.col("p") - z * F.sqrt("var")).alias("bad_lower")), "rated"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("bad_lower") > max_bad) & F.lit((total.n or 0) > 0), "block").otherwise("allow")
    return urls.join(rated, "name", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "bad_mean", "bad_lower")


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> str:
    """The same in DuckDB SQL: page_id, host, path, rule, verdict."""
    low, high = STRENGTH

    def strength(groups: str) -> str:
        return f"""(select case when k < 2 then {low} when b is null or b <= 0 then {high} else least({high}, greatest({low}, w / b - 1)) end from (
            select k, w, case when n - nn / n > 0 then (yy - y * y / n - (k - 1) * w) / (n - nn / n) end as b from (
              select count(*) k, sum(n)::double n, sum(y)::double y, sum(n::double * n) nn, sum(y::double * y / n) yy, (sum(y)::double / sum(n)) * (1 - sum(y)::double / sum(n)) w from {groups} where n > 0)))"""

    cases = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    case = lambda i: "case " + " ".join(f"when {fits(r[0], r[1])} then '{r[2] if i else r[0] + r[1]}'" for r in cases) + " end"
    return f"""
    with r as (select page_id, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages),
    u as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
    o as (select doc_id as page_id, case when quality = 0 or toxic = 1 then 1 when quality is not null or toxic is not null then 0 end as bad from labels),
    g as (select *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\\.+$', '') as name from u),
    c as (select name, count(bad) as n, coalesce(sum(bad), 0) as y from g left join o using (page_id) where name <> '' group by 1),
    l as (select *, regexp_matches(name, '^([0-9.]+|\\[.*\\])$') as ip, string_split(name, '.') as p from c),
    x as (select *, array_to_string(p[-2:], '.') in ({", ".join(f"'{x}'" for x in suffixes)}) as two from l),
    h as (select name, n, y, case when ip then name else array_to_string(case when two then p[-3:] else p[-2:] end, '.') end as domain,
          case when ip then 'ip' when two then array_to_string(p[-2:], '.') else p[-1] end as suffix from x),
    d as (select domain, suffix, sum(n) n, sum(y) y from h group by 1, 2),
    s as (select suffix, sum(n) n, sum(y) y from h group by 1),
    m as (select {strength("s")} as ms, {strength("d")} as md, {strength("h")} as mh),
    di as (select domain, suffix, sum(n * (mh + 1) / (n + mh)) n, sum(y * (mh + 1) / (n + mh)) y from h, m group by 1, 2),
    si as (select suffix, sum(n * (md + 1) / (n + md)) n, sum(y * (md + 1) / (n + md)) y from di, m group by 1),
    ti as (select coalesce(sum(n * (ms + 1) / (n + ms)), 0) n, coalesce(sum(y * (ms + 1) / (n + ms)), 0) y from si, m),
    t as (select n, (y + 0.5::double) / (n + 1) as p, (y + 0.5::double) / (n + 1) * (1 - (y + 0.5::double) / (n + 1)) / (n + 2) as v from ti),
    sp as (select suffix, (si.y + t.p * ms) / (si.n + ms) as p, si.n + ms as w, ms, t.v from si, t, m),
    sm as (select suffix, p, p * (1 - p) / (w + 1) + v * pow(ms / w, 2) as v from sp),
    dp as (select domain, suffix, (di.y + sm.p * md) / (di.n + md) as p, di.n + md as w, md, sm.v from di join sm using (suffix), m),
    dm as (select domain, suffix, p, p * (1 - p) / (w + 1) + v * pow(md / w, 2) as v from dp),
    hp as (select name, (h.y + dm.p * mh) / (h.n + mh) as p, h.n + mh as w, mh, dm.v from h join dm using (domain, suffix), m),
    hm as (select name, p, p * (1 - p) / (w + 1) + v * pow(mh / w, 2) as v from hp)
    select page_id, host, path, {case(0)} as rule, coalesce({case(1)}, case when t.n > 0 and hm.p - {z} * sqrt(hm.v) > {max_bad} then 'block' else 'allow' end) as verdict
    from g left join hm using (name), t"""
