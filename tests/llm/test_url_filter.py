"""URL filter against plain Python and SQL."""

import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from harborline.llm import url_filter as u


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fit = [r for r in u.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def suffix(host):
    labels = host.split(".")
    wide = len(labels) > 2 and labels[-3] and labels[-2] in u.SHARED_LABELS and re.fullmatch("[a-z]{2}", labels[-1])
    return ".".join(labels[-2:] if wide else labels[-1:])


def domain(host):
    return ".".join(host.split(".")[-2 - suffix(host).count(".") :])


def brute(pages, outcomes):
    bad = {}
    for key, value in outcomes:
        if key is not None:
            bad[key] = max(bad.get(key, 0), value)
    count = defaultdict(lambda: [0, 0])
    hosts = {parts(url)[0] for _, url in pages}
    for key, url in pages:
        host = parts(url)[0]
        for level in (("h", host), ("d", domain(host)), ("s", suffix(host)), ("w",)):
            count[level][0] += bad.get(key, 0)
            count[level][1] += key in bad
    base = (count[("w",)][0] + 1) / (count[("w",)][1] + 2)

    def level(name, above):
        """Weight and mean of each group, whose prior mean is above[group]."""
        over = sum((count[name, g][0] - count[name, g][1] * m) ** 2 - count[name, g][1] * m * (1 - m) for g, m in above.items())
        room = sum(count[name, g][1] * (count[name, g][1] - 1) * m * (1 - m) for g, m in above.items())
        weight = room / over - 1 if over > 0 and room > 0 else u.MOST_PRIOR
        weight = round(min(max(weight, u.LEAST_PRIOR), u.MOST_PRIOR), 6)
        return weight, {g: (count[name, g][0] + weight * m) / (count[name, g][1] + weight) for g, m in above.items()}

    _, suffixes = level("s", {suffix(h): base for h in hosts})
    _, domains = level("d", {domain(h): suffixes[suffix(h)] for h in hosts})
    weight, means = level("h", {h: domains[domain(h)] for h in hosts})
    low = {h: m - u.BOUND_DEVIATIONS * math.sqrt(m * (1 - m) / (count["h", h][1] + weight + 1)) for h, m in means.items()}
    out = []
    for key, url in pages:
        host, path = parts(url)
        name, verdict = rule(host, path)
        out.append((key, host, path, name, verdict or ("block" if low[host] > u.BAD_SHARE else "allow")))
    return sorted(out, key=str)


def test_judgements(spark):
    urls = [
        "http://A.Example.NET/en/1", "http://example.net/EN/1", "https://x.net", "https://xnet/", "ftp://net/#/en", "http://example.com/de/x?y=://z",
        "http://notexample.com/de/", "http://a.b.example.com/de/", "http://w.org/fr/", "http://org/fr/x", "http://w.org/fr", "nothing", None, "",
        "://h/p", "a://b://c/d", "http://bad.biz/1", "http://ok.biz/1", "http://É.biz/x", "http://q.biz?x/y#z", "http://\nhost/\np",
    ]
    pages = list(enumerate(urls)) + [(100 + i, f"http://bad.biz/{i}") for i in range(80)] + [(300 + i, f"http://ok.biz/{i}") for i in range(60)] + [(None, "http://bad.biz/n"), (100, "http://bad.biz/again")]
    outcomes = [(100 + i, 1) for i in range(80)] + [(300 + i, int(i % 9 == 0)) for i in range(60)] + [(301, 1), (None, 1), (9999, 1)]
    df = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, host string, n int")
    told = spark.createDataFrame(outcomes, "page_id long, bad int")
    rows = u.judge_urls(df, told).collect()
    want = brute(pages, outcomes)
    assert sorted((tuple(r) for r in rows), key=str) == want
    assert {w[4] for w in want if w[1] == "bad.biz"} == {"block"} and {w[4] for w in want if w[1] == "ok.biz"} == {"allow"}
    assert u.judge_urls(df.limit(0), told).collect() == []
    assert {r.verdict for r in u.judge_urls(df, told.limit(0)).where("rule is null").collect()} == {"allow"}


def test_suffixes_and_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.co.biz", "a.example.com", "com", "", "..co.uk", "a.com.au", "a.scom.au", "q.w.e"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    rows = df.select("host", u.suffix_of(F.col("host")).alias("s"), u.registered_domain(F.col("host")).alias("d")).collect()
    assert [(r.s, r.d) for r in rows] == [(suffix(h), domain(h)) for h in hosts]
    assert rows[0].d == "b.co.uk" and rows[2].d == "co.uk"


def test_weights_follow_how_much_hosts_differ(spark):
    rng = random.Random(6)

    def spread(shares):
        rows = [(f"h{i}.d.biz", int(rng.random() < share)) for i, share in enumerate(shares) for _ in range(60)]
        df = spark.createDataFrame(rows, "host string, bad int")
        table = {r.host: r for r in u.reputations(df).collect()}
        own = {h: sum(b for g, b in rows if g == h) / 60 for h in table}
        mean = sum(own.values()) / len(own)
        return sum(abs(table[h].mean - mean) for h in own) / sum(abs(own[h] - mean) for h in own)

    assert spread([0.5] * 40) < 0.4 < 0.9 < spread([0.05, 0.95] * 20)
