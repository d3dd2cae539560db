import math
import os
import re

import pytest
from pyspark.sql import functions as F

from cohortlab.llm import queries, url_filters as u
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(str.maketrans(u.UPPER, u.LOWER)), re.match(r"[^?#]*", rest[len(host):]).group()


def judge(url, rules):
    host, path = parse(url)
    best = None
    for rule, says in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            if best is None or (-len(rule), rule) < (-len(best[0]), best[0]):
                best = rule, says
    return best or (None, None)


URLS = ["http://a.example.org/en/123", "http://a.example.org/en/23?x=http://b.com/de/", "HTTP://EXAMPLE.ORG/ES/", "x://example.org/es/",
        "http://notexample.org/es/1", "https://org/", "http://org", "http://m.com/fr/1#/de/", "http://m.com/de/?q", "http://m.com/dede",
        "http://commerce/de/", "//x.com/de/", "", None, "http://u:p@Ümlaut.com:80/fr/", "http://a://b/c", "http:///de/", "http://a.com?/de/",
        "http://x.com/de/\nline", "http://m.com/de/1", "http://m.com/de/1"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, x, "h", 1) for i, x in enumerate(URLS)], "page_id long, url string, host string, n int")
    rows = u.filter_urls(df).collect()
    assert len(rows) == len(URLS) and rows[0].asDict().keys() >= {"n", "host", "path"}
    for r in rows:
        rule, says = judge(URLS[r["page_id"]], u.RULES)
        assert (r["host"], r["path"], r["rule"]) == (*parse(URLS[r["page_id"]]), rule)
        assert r["verdict"] in ("allow", "block") and says in (None, r["verdict"])


@pytest.mark.parametrize("host,domain,suffix", [
    ("a.b.example.co.uk", "example.co.uk", "co.uk"), ("co.uk", "co.uk", "uk"), ("x.example.com", "example.com", "com"),
    ("u@x.example.com:8080", "example.com", "com"), ("10.0.0.7", "10.0.0.7", "10.0.0.7"), ("localhost", "localhost", "localhost"),
    ("", "", ""), ("a.example.org.", "example.org", "org"), ("x.ab.de", "ab.de", "de")])
def test_domains(spark, host, domain, suffix):
    d, s = u.domain_and_suffix(F.col("h"))
    assert tuple(spark.createDataFrame([(host,)], "h string").select(d, s).first()) == (domain, suffix)


def brute(hosts, z=u.Z):
    """The fit in plain Python: {host: (domain, suffix, n, bad)} -> {host: (mean, bound)}."""
    def concentration(groups):
        over = sum((b - n * p) ** 2 - n * p * (1 - p) for n, b, p in groups)
        pairs = sum(n * (n - 1) * p * (1 - p) for n, b, p in groups)
        rho = min(max(over / pairs if pairs else u.RHO[1], u.RHO[0]), u.RHO[1])
        return (1 - rho) / rho
    total = [sum(v[i] for v in hosts.values()) for i in (2, 3)]
    dom, suf, of = {}, {}, {}
    for d, s, n, b in hosts.values():
        of[d] = s
        dom[d] = (dom.get(d, (0, 0))[0] + n, dom.get(d, (0, 0))[1] + b)
        suf[s] = (suf.get(s, (0, 0))[0] + n, suf.get(s, (0, 0))[1] + b)
    r = lambda n, b: (total[1] - b + .5) / (total[0] - n + 1)
    ms = concentration([(n, b, r(n, b)) for n, b in suf.values()])
    s_ = lambda s, n, b: (ms * r(n, b) + suf[s][1] - b) / (ms + suf[s][0] - n)
    md = concentration([(n, b, s_(of[d], n, b)) for d, (n, b) in dom.items()])
    d_ = lambda d, s, n, b: (md * s_(s, n, b) + dom[d][1] - b) / (md + dom[d][0] - n)
    mh = concentration([(n, b, d_(d, s, n, b)) for d, s, n, b in hosts.values()])
    out = {}
    for h, (d, s, n, b) in hosts.items():
        mean = (mh * d_(d, s, n, b) + b) / (mh + n)
        out[h] = mean, math.sin(max(math.asin(math.sqrt(mean)) - z / (2 * math.sqrt(mh + n + 1)), 0)) ** 2
    return out


def test_reputation_equals_plain_python(spark):
    rows = [(f"h{i}.d{i % 7}.{'com' if i % 3 else 'co.uk'}", i % 11, min(i % 11, (i * i) % 5 + (i % 7 == 2) * 6)) for i in range(90)]
    hosts = {h: (".".join(h.split(".")[1:]), ".".join(h.split(".")[2:]), n, b) for h, n, b in rows}
    got = {r["host"]: (r["bad_mean"], r["bad_bound"]) for r in
           u.reputation(spark.createDataFrame(rows, "host string, n long, bad long")).collect()}
    want = brute(hosts)
    assert got.keys() == want.keys()
    for h in want:
        assert got[h] == pytest.approx(want[h], rel=1e-9)


def test_evidence_outweighs_the_prior_and_little_evidence_does_not(spark):
    """A bad host is blocked, a host of one bad page among good ones is not, and a silent host follows its neighbours."""
    urls = ([f"http://bad.x.net/b/{i}" for i in range(60)] + ["http://bad.x.net/other"] + ["http://one.y.net/b/1", "http://one.y.net/other"]
            + [f"http://s{j}.y.net/a/{i}" for j in range(8) for i in range(9)] + ["http://silent.y.net/other"]
            + [f"http://v{j}.z.org/b/{i}" for j in range(30) for i in range(9)] + ["http://silent.z.org/other"])
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["url"]: r for r in u.filter_urls(df, rules=[("net/b/", "block"), ("net/a/", "allow"), ("org/b/", "block")]).collect()}
    assert out["http://bad.x.net/other"]["verdict"] == "block"
    assert out["http://one.y.net/other"]["verdict"] == "allow"
    assert out["http://silent.y.net/other"]["verdict"] == "allow"
    assert out["http://silent.z.org/other"]["verdict"] == "block"


def test_hot_and_cold_hosts_both_come_back(spark, monkeypatch):
    monkeypatch.setattr(u, "HOT", 4)
    urls = ["http://hot.com/de/1"] * 50 + [f"http://c{i % 20}.com/{'de' if i % 2 else 'en'}/{i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = u.filter_urls(df)
    rows = out.collect()
    assert len(rows) == 110 and all(r["bad_bound"] is not None for r in rows)
    assert {r["host_labelled"] for r in rows if r["host"] == "hot.com"} == {50}


def test_no_outcomes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None), (None, None)], "page_id long, url string")
    assert [r["verdict"] for r in u.filter_urls(df).collect()] == ["allow"] * 3
    assert u.filter_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        u.filter_urls(df, rules=[("/x", "block")])


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op13_url_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_registered_query_equals_sql(spark):
    ok, msg = compare(queries.QUERIES["op13_url_filters"](spark, SF), duck(SF), queries.ORACLES["op13_url_filters"])
    assert ok, msg
