"""URL filter by rules and by empirical-Bayes host reputation.

Rules (host and path prefix) decide first; the longest that fits wins. Elsewhere the host's reputation
does: labelled outcomes of its pages (bad or not) are shrunk towards its registered domain's rate, that
towards its suffix's, and that towards the rate of all, each by a beta-binomial prior whose strength is
fitted from the spread of rates on that level (method of moments). A host is blocked if the lower bound of
its posterior bad rate, z standard deviations below the mean, lies above the threshold. So few outcomes
don't block a host, and a host without any is judged as its domain is. The suffix is the last label, or
the last two of a country's second level (co.uk); the registered domain has one label more. An address in
numbers is its own domain and suffix.

DataFrame and SQL functions only. Outcomes are summed by host before they move; the pages meet the host
table in one join on the host, which a hot host leaves splittable.

Defined results: a null url, or one without ://, has empty host and path and no rule; pages without a
label add nothing; labels that repeat an id count each; without any labelled page all verdicts the rules
don't give are allow; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.urls import IP, SECOND_LEVEL, TWO_LABELS
from ..session import table

#: (verdict, rule): the rule's host, then its path prefix from the first slash on.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
THRESHOLD, Z = 0.5, 1.2816
#: Overdispersion where the outcomes can't tell it, and its bounds.
RHO, RHO_LEAST, RHO_MOST = 0.1, 0.001, 0.999


def parts_sql(url: str) -> tuple[str, str]:
    """SQL for host and path of a url column."""
    pattern = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    host = f"translate(coalesce(regexp_extract({url}, {pattern}, 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return host, f"coalesce(regexp_extract({url}, {pattern}, 2), '')"


def levels_sql(host: str) -> tuple[str, str]:
    """SQL for the registered domain and the suffix of a host column."""
    address = f"CASE WHEN regexp_extract({host}, '{IP}', 0) <> '' THEN {host} ELSE "
    domain = f"{address}regexp_extract({host}, '([^.]*[.])?({TWO_LABELS}|[^.]*)$', 0) END"
    return domain, f"{address}regexp_extract({host}, '(^|[.])({TWO_LABELS}|[^.]*)$', 2) END"


def rule_sql(rules: tuple = RULES) -> tuple[str, str]:
    """SQL for the rule that fits columns host and path, and for its verdict: the longest rule first."""
    cases = ["", ""]
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        if "'" in rule or "\\" in rule or not slash:
            raise ValueError(f"not a rule: {rule}")
        prefix = slash + path
        fits = f"(host = '{host}' OR right(host, {len(host) + 1}) = '.{host}') AND left(path, {len(prefix)}) = '{prefix}'"
        cases[0] += f" WHEN {fits} THEN '{rule}'"
        cases[1] += f" WHEN {fits} THEN '{verdict}'"
    return f"CASE{cases[0]} ELSE NULL END", f"CASE{cases[1]} ELSE NULL END"


def strength_sql(level: str) -> str:
    """Scalar subquery: the prior strength k = 1/rho - 1 that the rates of a level's units (n, x) show."""
    return f"""(SELECT 1.0 / greatest({RHO_LEAST}, least({RHO_MOST}, coalesce(
        ((sum(x * x / n) - sum(x) * sum(x) / sum(n)) / nullif(sum(x) / sum(n) * (1 - sum(x) / sum(n)), 0) - (count(*) - 1))
        / nullif(sum(n) - sum(n * n) / sum(n) - (count(*) - 1), 0), {RHO}))) - 1 FROM {level})"""


def verdict_sql(pages: str, outcomes: str, rules: tuple = RULES, threshold: float = THRESHOLD, z: float = Z) -> str:
    """SQL over pages (page_id, url) and outcomes (page_id, bad 0 or 1)."""
    host, path = parts_sql("url")
    rule, verdict = rule_sql(rules)
    domain, suffix = levels_sql("h.host")
    return f"""
WITH parsed AS (SELECT page_id, {host} AS host, {path} AS path FROM {pages}),
labelled AS (
  SELECT host, cast(count(*) AS double) AS n, cast(sum(bad) AS double) AS x
  FROM parsed JOIN {outcomes} AS o ON parsed.page_id = o.outcome_id GROUP BY host),
hosts AS (
  SELECT h.host, coalesce(n, 0.0) AS n, coalesce(x, 0.0) AS x,
         {domain} AS domain, {suffix} AS suffix
  FROM (SELECT DISTINCT host FROM parsed) AS h LEFT JOIN labelled ON h.host = labelled.host),
seen AS (SELECT * FROM hosts WHERE n > 0),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM seen GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY suffix),
by_suffix AS (
  SELECT suffix, (x + k * p) / (n + k) AS mean
  FROM (SELECT suffix, n, x, {strength_sql("suffixes")} AS k, (SELECT sum(x) / sum(n) FROM suffixes) AS p FROM suffixes) AS s),
by_domain AS (
  SELECT domain, (x + k * mean) / (n + k) AS mean
  FROM (SELECT d.domain, d.n, d.x, s.mean, {strength_sql("domains")} AS k FROM domains AS d JOIN by_suffix AS s ON d.suffix = s.suffix) AS d),
posterior AS (
  SELECT h.host, x + k * m AS a, n - x + k * (1 - m) AS b
  FROM (SELECT hosts.host, n, x, {strength_sql("seen")} AS k, coalesce(by_domain.mean, by_suffix.mean, (SELECT sum(x) / sum(n) FROM suffixes)) AS m
        FROM hosts LEFT JOIN by_domain ON hosts.domain = by_domain.domain LEFT JOIN by_suffix ON hosts.suffix = by_suffix.suffix) AS h),
judged AS (
  SELECT host AS judged_host, CASE WHEN a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {threshold} THEN 'block' ELSE 'allow' END AS reputation
  FROM posterior)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, reputation) AS verdict
FROM parsed LEFT JOIN judged ON host = judged_host
"""


def judge(spark: SparkSession, pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of `pages` (page_id, url), by `rules` and by the
    labelled `outcomes` (page_id, bad)."""
    return spark.sql(verdict_sql("{pages}", "{outcomes}", rules, threshold, z), pages=pages.select("page_id", "url"), outcomes=outcomes.selectExpr("page_id AS outcome_id", "bad"))


#: A label of the page's id is its outcome: bad if toxic or of low quality.
BAD = "CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END"


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", f"{BAD} AS bad")
    return judge(spark, table(spark, sf_dir, "pages"), outcomes)


def oracle_levels() -> str:
    """The same levels by lists of labels."""
    two = f"len(l) >= 2 AND list_contains([{', '.join(repr(x) for x in SECOND_LEVEL)}], l[-2]) AND length(l[-1]) = 2 AND l[-1] BETWEEN 'aa' AND 'zz'"
    return f"""SELECT host, n, x, CASE WHEN ip THEN host ELSE array_to_string(l[-(k + 1):], '.') END AS domain, CASE WHEN ip THEN host ELSE array_to_string(l[-k:], '.') END AS suffix
  FROM (SELECT *, CASE WHEN {two} THEN 2 ELSE 1 END AS k, len(l) = 4 AND len(list_filter(l, lambda y: length(y) BETWEEN 1 AND 3 AND try_cast(y AS INT) IS NOT NULL)) = 4 AS ip FROM (SELECT *, string_split(host, '.') AS l FROM hosts))"""


def oracle_rho(level: str) -> str:
    """Overdispersion of a level by its mean square between units: the estimate the strengths come from."""
    return f"""SELECT 1 / greatest({RHO_LEAST}, least({RHO_MOST}, coalesce(CASE WHEN p > 0 AND p < 1 AND c <> 0 THEN (between_ / (p * (1 - p)) - g) / c END, {RHO}))) - 1 AS k
  FROM (SELECT any_value(p) AS p, sum(n * (x / n - p) ** 2) AS between_, count(*) - 1 AS g, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS c FROM (SELECT *, sum(x) OVER () / sum(n) OVER () AS p FROM {level}))"""


#: DuckDB's way to the same rows: positions and lists in place of patterns, windows in place of joins.
OP7_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
ends AS (SELECT *, least(CASE WHEN contains(rest, '?') THEN strpos(rest, '?') ELSE length(rest) + 1 END, CASE WHEN contains(rest, '#') THEN strpos(rest, '#') ELSE length(rest) + 1 END) AS till FROM cut),
parsed AS (SELECT page_id, translate(split_part(left(rest, till - 1), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(left(rest, till - 1), length(split_part(left(rest, till - 1), '/', 1)) + 1) AS path FROM ends),
hosts AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS x FROM parsed LEFT JOIN (SELECT doc_id, ({BAD}) AS bad FROM labels) l ON doc_id = page_id GROUP BY host),
level AS ({oracle_levels()}),
h AS (SELECT * FROM level WHERE n > 0),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(x) AS x FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM d GROUP BY suffix),
base AS (SELECT sum(x) / sum(n) AS p FROM h), ks AS ({oracle_rho("s")}), kd AS ({oracle_rho("d")}), kh AS ({oracle_rho("h")}),
ms AS (SELECT suffix, (x + k * p) / (n + k) AS m FROM s, ks, base),
md AS (SELECT domain, (x + k * m) / (n + k) AS m FROM d JOIN ms USING (suffix), kd),
post AS (SELECT host, x + k * coalesce(md.m, ms.m, p) AS a, n - x + k * (1 - coalesce(md.m, ms.m, p)) AS b FROM level LEFT JOIN md USING (domain) LEFT JOIN ms USING (suffix), kh, base),
judged AS (SELECT host, coalesce(a / (a + b) - {Z} * sqrt(a * b / (a + b + 1)) / (a + b) > {THRESHOLD}, false) AS bad_host FROM post),
rules AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM (VALUES {", ".join(str(r) for r in RULES)}) t(verdict, rule)),
hit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rules.verdict, length(rule)) AS verdict FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad_host THEN 'block' ELSE 'allow' END) AS verdict FROM parsed LEFT JOIN hit USING (page_id) LEFT JOIN judged USING (host)
"""
