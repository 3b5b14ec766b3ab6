import re

import pytest

from millrace.functions.urls import SECOND_LEVEL
from millrace.llm import url_filter as U


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def strength(units):
    n, x = sum(a for a, _ in units), sum(b for _, b in units)
    p, g = x / n, len(units)
    spread, room = sum(b * b / a for a, b in units) - x * x / n, n - sum(a * a for a, _ in units) / n - (g - 1)
    rho = (spread / (p * (1 - p)) - (g - 1)) / room if p * (1 - p) and room else U.RHO
    return 1 / max(U.RHO_LEAST, min(U.RHO_MOST, rho)) - 1


def levels(host):
    labels = host.split(".")
    if len(labels) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 for x in labels):
        return host, host
    two = len(labels) > 1 and labels[-2] in SECOND_LEVEL and re.fullmatch("[a-z][a-z]", labels[-1])
    return ".".join(labels[-3:] if two else labels[-2:]), ".".join(labels[-2:] if two else labels[-1:])


def brute(pages, outcomes, rules, threshold, z):
    where = {i: parse(u) for i, u in pages}
    hosts, domains, suffixes = {}, {}, {}
    for i, bad in outcomes:
        if i in where:
            h = where[i][0]
            for level, key in zip((hosts, domains, suffixes), (h, *levels(h))):
                n, x = level.get(key, (0, 0))
                level[key] = (n + 1, x + bad)
    out = []
    if hosts:
        total = [sum(v[k] for v in hosts.values()) for k in (0, 1)]
        base = total[1] / total[0]
        ks, kd, kh = (strength(list(v.values())) for v in (suffixes, domains, hosts))
    for i, _ in pages:
        h, path = where[i]
        hit = rule_of(h, path, rules)
        verdict = "allow"
        if hosts:
            d, s = levels(h)
            m = (suffixes[s][1] + ks * base) / (suffixes[s][0] + ks) if s in suffixes else base
            m = (domains[d][1] + kd * m) / (domains[d][0] + kd) if d in domains else m
            n, x = hosts.get(h, (0, 0))
            a, b = x + kh * m, n - x + kh * (1 - m)
            if a / (a + b) - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 > threshold:
                verdict = "block"
        out.append((i, h, path, hit and hit[1], hit[0] if hit else verdict))
    return sorted(out, key=str)


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://net", "https://net/", "x://b.net?q/en/", "http://example.com/de/1", "http://Éa.org/fr", "http://é.org/fr/", "a://b://c.org/fr/", "http://xnet/en/", "http://u@h.net:80/p#f?g", "http://x.org/de/\n2", "http://co.uk/", "http://10.0.0.7/a", "http://10.0.0.7:8/a", "http://a..co.uk", "http://.uk/", "http://x.", "http://com.UK/"]


@pytest.mark.parametrize("case", ["mixed", "none", "all bad"])
def test_matches_brute_force(spark, case):
    pages = list(enumerate(URLS)) + [(100 + k, f"http://{'bad' if k % 3 == 0 else 'good'}{k % 9}.{'spam' if k % 3 == 0 else 'fine'}.{('com', 'info', 'co.uk', 'org.au')[k % 4]}/p{k}") for k in range(240)]
    outcomes = {"mixed": [(100 + k, int(k % 3 == 0 and k % 10 != 0)) for k in range(0, 240, 2)] + [(999, 1), (0, 1)], "none": [], "all bad": [(100, 1), (101, 1)]}[case]
    got = U.judge(spark, spark.createDataFrame([(i, u, "x") for i, u in pages], "page_id long, url string, host string"), spark.createDataFrame([(i, b, "x") for i, b in outcomes], "page_id long, bad int, host string"))
    rows = sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert rows == brute(pages, outcomes, U.RULES, U.THRESHOLD, U.Z)
    if case == "mixed":
        assert {r[4] for r in rows if r[0] >= 100} == {"allow", "block"}


def test_few_outcomes_do_not_block(spark):
    pages = [(k, f"http://h{k}.example/") for k in range(50)]
    outcomes = [(k, int(k == 7)) for k in range(50)]
    got = U.judge(spark, spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"))
    assert {r.verdict for r in got.collect()} == {"allow"}


def test_empty_tables(spark):
    assert U.judge(spark, spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_levels(spark):
    known = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.uk": ("b.uk", "uk"), "x.y.com": ("y.com", "com"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "": ("", ""), "bare": ("bare", "bare"), "x.com.museum": ("com.museum", "museum")}
    domain, suffix = U.levels_sql("host")
    got = spark.createDataFrame([(h,) for h in known], "host string").selectExpr("host", f"{domain} AS domain", f"{suffix} AS suffix")
    assert {r.host: (r.domain, r.suffix) for r in got.collect()} == known


def test_oracle_agrees_on_odd_urls(spark, tmp_path):
    import duckdb

    urls = URLS + [f"http://{'bad' if k % 3 == 0 else 'good'}{k % 9}.{'spam' if k % 3 == 0 else 'fine'}.{('com', 'co.uk')[k % 2]}/p{k}" for k in range(240)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, int(k % 5 != 0), int(k % 3 == 0)) for k in range(0, len(urls), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({U.OP7_SQL})").fetchall()
    got = [tuple(r) for r in U.op7_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[4] for r in got if r[0] >= len(URLS)} == {"allow", "block"}
