"""Operator 12 against direct matching and a walk over all links."""

import collections
import random
import re

import duckdb

from volspan.llm import queries, url_filter

RULES = queries.URL_RULES


def host_path(url):
    _, _, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path, rules):
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


def node(url):
    host, path = host_path(url)
    return host + path + (m[0] if (m := re.search(r"\?[^#]*", (url or "").partition("#")[0])) else "") if host else None


def plain(n):
    m = re.match(r"([^/?]*)([^?]*)\??(.*)", n, re.DOTALL)
    host = re.sub(r"^(www|m)\.", "", re.sub(":(80|443)$", "", m[1]))
    q = re.sub("&(utm_[a-z]+|gclid|fbclid|ref)=[^&]*", "", "&" + m[3])
    return host + re.sub("/$", "", m[2]) + ("?" + q[1:] if len(q) > 1 else "")


def brute(pages, links, rules):
    """``links``: (source URL, target URL)."""
    edges = [(node(a), node(b)) for a, b in links if node(a) and node(b)]
    named = {node(u) for _, u, _ in pages if node(u)} | {n for e in edges for n in e}
    near = collections.defaultdict(set)
    for a, b in [*edges, *((n, plain(n)) for n in named)]:
        near[a].add(b)
        near[b].add(a)
    own = {n: rule_of(*host_path("x://" + n), rules) for n in named}
    out = []
    for i, u, _ in pages:
        host, path = host_path(u)
        r = rule_of(host, path, rules)
        seen, todo = set(), [node(u)] if node(u) else []
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n]
        votes = {own[n][3] for n in seen if own.get(n)}
        alias = "allow" if "allow" in votes else "block" if votes else None
        out.append((i, host, path, r[2] if r else None, r[3] if r else alias or "allow", "rule" if r else "alias" if alias else "default"))
    return out


def tables(spark):
    r = random.Random(4)
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.ORG/es/1", "http://a.example.org:80/es/1", "http://a.example.org:80/es/1?utm_source=x#top", "x://org", "x://org/", "x://xorg/", "ftp://m.Example.org/en/1?x=/a", "a://b://c/d", "http://ü.com/de/ß?q#f", "http://net.net/" + "x" * 5000, "http://" + "a." * 3000 + "com/de/1", "http://x.com/fr", "http://www.x.com/fr/", "http://x.com/de/"]
    names = [f"s{k}.example.{t}" for k in range(4) for t in ("com", "org", "net")]
    urls += [f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'm.'])}{r.choice(names)}/{r.choice(['en', 'fr', 'de', 'es'])}/{r.randint(1, 6)}{r.choice(['', '/', '?ref=x', '#a', '?page=2&utm_source=f', ':80'])}" for _ in range(300)]
    pages, links = [], []
    for k, u in enumerate(urls):
        html, host = "<p>text</p>", host_path(u)[0]
        if r.random() < 0.4 and node(u):
            to = r.choice(urls[20:])
            kind = r.choice(["canonical", "refresh", "//", "/", "other", "upper"])
            shown = {"canonical": f'<link href="{to.replace("&", "&amp;")}" rel="canonical">', "refresh": f"<meta http-equiv=refresh content='0; url={to}'>", "//": f"<link rel='canonical' href='{to[to.index('//') :]}'/>", "/": '<link rel="canonical" href="/de/9">', "other": f'<link rel="stylesheet" href="{to}">', "upper": f'<LINK REL="CANONICAL" HREF="{to}">'}
            html += shown[kind] + "<p>canonical refresh</p>"
            if kind != "other":
                links.append((u, "http://" + host + "/de/9" if kind == "/" else to))
        pages.append((k, u, html))
    pages += [(5, *pages[5][1:])] * 3 + [(None, *pages[30][1:]), (None, None, None)]
    return pages, links


def test_verdicts_equal_brute_force(spark):
    pages, links = tables(spark)
    df = spark.createDataFrame([(*p, "h", "n", 1) for p in pages], "page_id long, url string, html string, host string, node string, id int").repartition(3)
    recorded = [(pages[40][1], "http://s0.example.com/de/1"), ("http://elsewhere.example.net/1", pages[41][1]), (None, pages[42][1]), ("http://elsewhere.example.net/1", "http://t.com/fr/2")]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(map(tuple, url_filter.judge_urls(df, RULES).collect()), key=key)
    assert got == sorted(brute(pages, links, RULES), key=key)
    assert {"rule", "alias", "default"} == {r[5] for r in got} and any(r[4] == "block" and r[5] == "alias" for r in got)
    got = url_filter.judge_urls(df, RULES, spark.createDataFrame(recorded, "source string, target string")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(pages, links + recorded, RULES), key=key)
    more = [*RULES, ("block", "S1.example.net", "/fr/3"), ("allow", "net", "/fr/3"), ("block", "s2.example.org", "")]
    table = spark.createDataFrame(more, "verdict string, host string, path string")
    assert sorted(map(tuple, url_filter.judge_urls(df, table).collect()), key=key) == sorted(brute(pages, links, [(v, h.lower(), p) for v, h, p in more]), key=key)
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0 and url_filter.judge_urls(df.limit(9), []).count() == 9


def test_sql_follows_the_same_links(spark, tmp_path):
    pages, links = tables(spark)
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = con.sql(f'SELECT page_id, host, path, rule, verdict, decided_by FROM ({queries.oracle_sql()["op12_url_filter"]})').fetchall()
    assert sorted(got, key=key) == sorted(brute(pages, links, RULES), key=key)
