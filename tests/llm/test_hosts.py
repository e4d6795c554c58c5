import math
import random
import re

import pytest

from loregraph.llm import host_reputation as hosts

URLS = [
    None, "", "no scheme", "x://", "http://ORG/a", "http://a.org", "http://a.org/", "http://a.org?q=/x", "http://a.B.Example.org/es/1", "http://example.org/es",
    "http://example.org/en/10", "http://example.org/en/2", "http://notexample.org/es/1", "http://x.com/fr/1#z", "http://x.com/de/1?y", "http://com/de/",
    "http://xcom/de/", "http://x.com/en/1", "a://b://c.com/de/", "http://user@x.com:80/de/", "http://x.com./de/", "http://10.0.0.1/de/", "http://shop.co.uk/de/1",
    "http://a.shop.co.uk/1", "http://É.com/de/x", "http://x.com\n/de/", "http://x.com/DE/1",
]


def plain_parts(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]) if found else ""
    path = found[2] if found else ""
    fits = []
    for verdict, rule in hosts.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    rule, verdict = max(fits)[1:] if fits else (None, None)
    return host, path, rule, verdict


def plain_levels(host):
    bare = re.sub(r"\.?(:[0-9]*)?$", "", re.sub(r"(?s)^.*@", "", host), count=1)
    names = bare.split(".")
    if re.fullmatch("[0-9.]+", bare):
        return bare, bare
    size = 2 if len(names) > 1 and names[-2] in hosts.SECOND_LEVEL and re.fullmatch("[a-z]{2}", names[-1]) else 1
    return ".".join(names[-size:]), ".".join(names[-size - 1:])


def plain_judge(urls):
    """Each level by loops over all hosts."""
    parts = [plain_parts(u) for u in urls]
    seen, blocked = {}, {}
    for host, _, rule, verdict in parts:
        seen[host] = seen.get(host, 0) + (rule is not None)
        blocked[host] = blocked.get(host, 0) + (verdict == "block")
    prior = {h: (sum(blocked.values()) + 0.5) / (sum(seen.values()) + 1) for h in seen}
    worth = {h: sum(seen.values()) + 1 for h in seen}
    for key in (lambda h: plain_levels(h)[0], plain_levels, lambda h: h):
        n, s, p = {}, {}, {}
        for h in seen:
            n[key(h)] = n.get(key(h), 0) + seen[h]
            s[key(h)] = s.get(key(h), 0) + blocked[h]
            p[key(h)] = prior[h]
        over = sum((s[g] - n[g] * p[g]) ** 2 - n[g] * p[g] * (1 - p[g]) for g in n)
        pairs = sum(n[g] * p[g] * (1 - p[g]) * (n[g] - 1) for g in n)
        spread = min(1 / min(0.95, max(1e-4, over / pairs if pairs else 0.95)) - 1, max(1, sum(map(bool, n.values()))))
        k = {h: max(0.05, 1 / (1 / (spread + 1) + 1 / (worth[h] + 1)) - 1) for h in seen}
        prior = {h: (s[key(h)] + k[h] * p[key(h)]) / (n[key(h)] + k[h]) for h in seen}
        worth = {h: n[key(h)] + k[h] for h in seen}
    out = []
    for host, path, rule, verdict in parts:
        share = prior[host]
        bound = max(0.0, share - 1.645 * math.sqrt(share * (1 - share) / (worth[host] + 1)))
        out.append((host, path, rule, verdict or ("block" if bound >= 0.5 else "allow"), share, bound))
    return out


@pytest.mark.parametrize("spam", [False, True])
def test_against_loops(spark, spam):
    rng = random.Random(5)
    urls = list(URLS)
    for name in ("good.com", "m.good.com", "bad.com", "www.bad.com", "x.net", "small.bad.com"):
        for _ in range(rng.randint(5, 60)):
            path = rng.choice(["/de/", "/de/", "/en/", "/fr/"] if "bad" in name else ["/fr/", "/en/", "/fr/", "/de/"])
            urls.append(f"https://{name}{path}{rng.randint(1, 99)}")
    if spam:
        urls += [f"http://s{i}.spam.com/{p}/1" for i in range(40) for p in ("de", "de", "en")]
    rows = [(i, u, "x", 0.5) for i, u in enumerate(urls)]
    got = hosts.judge_pages(spark.createDataFrame(rows, "page_id long, url string, host string, share double").repartition(3)).collect()
    wanted = plain_judge(urls)
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict, share, bound = wanted[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), urls[r.page_id]
        assert abs(r.share - share) < 1e-4 and abs(r.bound - bound) < 1e-4
    if spam:   # pages of a host that never had a fair page go, others of the suffix stay
        assert {r.verdict for r in got if r.host.endswith("spam.com")} == {"block"}
        assert {r.verdict for r in got if r.host == "x.net"} == {"allow"}


def test_levels(spark):
    names = ["", "a", "a.b", "a.b.c", "x.co.uk", "co.uk", "u@a.b:80", "1.2.3.4", "a.b.", ".com", "a..com"]
    rows = spark.createDataFrame([(n,) for n in names], "host string")
    found = rows.select("host", hosts.suffix_of(rows.host).alias("suffix")).withColumn("domain", hosts.domain_of(rows.host, hosts.F.col("suffix")))
    got = {r.host: (r.suffix, r.domain) for r in found.collect()}
    assert got == {"": ("", ""), "a": ("a", "a"), "a.b": ("b", "a.b"), "a.b.c": ("c", "b.c"), "x.co.uk": ("co.uk", "x.co.uk"), "co.uk": ("co.uk", "co.uk"),
                   "u@a.b:80": ("b", "a.b"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "a.b.": ("b", "a.b"), ".com": ("com", "com"), "a..com": ("com", "com")}


def test_further_outcomes_and_odd_rows(spark):
    rows = [(None, "http://a.net/x"), (1, None), (1, None), (2, "http://b.net/x"), (2, "http://b.net/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert sorted(r.verdict for r in hosts.judge_pages(pages).collect()) == ["allow"] * 5
    outcomes = spark.createDataFrame([("a.net", True)] * 40 + [("b.net", False)] * 40 + [(None, True), ("b.net", None)], "host string, blocked boolean")
    got = sorted((str(r.page_id), r.verdict) for r in hosts.judge_pages(pages, outcomes=outcomes).collect())
    assert got == [("1", "allow"), ("1", "allow"), ("2", "allow"), ("2", "allow"), ("None", "block")]
    assert hosts.judge_pages(pages.limit(0)).collect() == []
