"""Url verdicts against a plain reading of the pages with the standard parser and a union of sets."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from millrace.llm import redirects
from millrace.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def node(url):
    if url is None or "://" not in url:
        return None
    host, path = parts(url)
    rest = url.split("#")[0]
    query = "?" + rest.split("?", 1)[1] if "?" in rest else ""
    return url.split("://")[0].lower() + "://" + host + (path or "/") + query


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.base, self.found, self.off = "", [], 0

    def handle_starttag(self, tag, attrs):
        have = {}
        for k, v in attrs:
            have.setdefault(k, v or "")
        self.off += tag == "noscript"
        if self.off:
            return
        if tag == "base" and have.get("href"):
            self.base = self.base or have["href"]
        if tag == "link" and "canonical" in have.get("rel", "").lower().split() and have.get("href"):
            self.found.append(have["href"])
        if tag == "meta" and have.get("http-equiv", "").lower() == "refresh":
            m = re.match(r"\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?[\"']?(.*?)[\"']?\s*$", have.get("content", ""), re.I | re.S)
            if m and m.group(1):
                self.found.append(m.group(1))

    def handle_endtag(self, tag):
        self.off -= tag == "noscript"


def rule_of(url):
    host, path = parts(url)
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def brute(pages):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, url, text in pages:
        if node(url) and text:
            p = Links()
            p.feed(text)
            p.close()
            for href in p.found:
                try:
                    to = node(urljoin(urljoin(url, p.base), href.strip()))
                except ValueError:
                    to = None
                if to:
                    parent[find(node(url))] = find(to)
    own = {}
    for x in list(parent):
        r = rule_of(x)
        if r:
            own.setdefault(find(x), set()).add(r.verdict)
    out = []
    for pid, url, _ in pages:
        r, host, path = rule_of(url), *parts(url)
        mine = own.get(find(node(url)), set()) if node(url) else set()
        out.append((pid, host, path, r and r.host + r.path, r.verdict if r else "block" if mine == {"block"} else "allow"))
    return sorted(out, key=repr)


def link(href, how):
    return {
        0: f'<html><head><LINK href="{href}" Rel="x Canonical"></head>', 1: f"<meta content='0; URL={href}' http-equiv=Refresh>",
        2: f"<meta http-equiv=\"refresh\" content=\"5;url='{href}'\">", 3: f"<!-- <link rel=canonical href={href}> -->",
        4: f"<script>'<link rel=canonical href={href}>'</script><p>x", 5: f"<link title='a > b' rel=canonical href='{href}' />",
        6: f"<noscript><meta http-equiv=refresh content='0;url={href}'></noscript>", 7: f"<link data-rel=canonical href={href}>",
    }[how]


PAGES = [
    (1, "http://Net.Example.NET/en/1#top", link("/es/2?a=1&amp;b=2", 0)),
    (2, "http://a.org/1", link("http://net.example.net/en/1", 1)),
    (3, "http://a.org/2", link("HTTP://A.org/1#x", 2)),
    (4, "http://www.example.com/en/x", link("http://b.org", 0)),
    (5, "http://b.org/", link("http://example.com/en/", 5)),
    (6, "http://example.com/en/", None), (7, "http://example.com", ""), (8, "https://sub.example.com/en/9?q#f", "<p>canonical"),
    (9, None, link("http://x.net/es/", 0)), (10, "no scheme", link("http://x.net/es/", 0)), (11, "http://", "<link rel=canonical>"),
    (12, "http://c.org/?q=http://d", link("http://x.net/fr/", 3)), (13, "http://c.org/s", link("http://x.net/fr/", 4)),
    (14, "http://notnet/es/", link("http://x.net/fr/1", 7)), (15, "http://net/es/", link("http://[bad", 0)),
    (16, "http://c.org/n", link("http://x.net/fr/", 6)), (17, "http://c.org/b", '<base href="http://x.net/fr/"><link rel=canonical href="y">'),
    (18, "http://c.org/refresh", '<meta http-equiv=refresh content="30">'), (None, "http://a.org/2", "x"), (3, "http://a.org/2", link("HTTP://A.org/1#x", 2)),
    (19, "http://c.org/long", "<p>w" * 60000 + "<!-- canonical"), (20, "ftp://net:80/es/", "canonical<link rel=\"canonical href=x>"),
]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    hosts = ["a.org", "b.net", "www.example.com", "example.com", "c.net", "www.d.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}" for i in range(300)]
    hub = "http://hub.org/all"
    pages = [(100 + i, u, link(rng.choice([hub, *urls[:40]]) if i % 3 else f"/de/{rng.randrange(300)}", rng.randrange(8))) for i, u in enumerate(urls)]
    chain = [(500 + i, f"http://chain.org/{i}", link(f"http://chain.org/{i + 1}", i % 3)) for i in range(30)]
    return PAGES + pages + chain + [(600, "http://chain.org/30", link("http://q.net/es/", 0))]


def got(rows):
    return sorted([tuple(r) for r in rows.collect()], key=repr)


def test_verdicts_equal_a_plain_reading(spark, made, monkeypatch):
    pages = spark.createDataFrame([(*p, "x", 1) for p in made], "page_id long, url string, html string, verdict string, v int")
    want = brute(made)
    rows = redirects.verdicts(pages, URL_RULES)
    assert rows.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert got(rows) == want
    monkeypatch.setattr(redirects, "BROADCAST_ROWS", -1)
    assert got(redirects.verdicts(pages.repartition(5), URL_RULES)) == want
    by_id = {r[0]: r[4] for r in want if r[0]}
    assert by_id[2] == by_id[3] == by_id[500] == "block" and by_id[4] == by_id[5] == "allow"


def test_no_pages_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert got(redirects.verdicts(empty, URL_RULES)) == []
    some = spark.createDataFrame([(1, "http://x.net/es/", None)], "page_id long, url string, html string")
    assert got(redirects.verdicts(some, [])) == [(1, "x.net", "/es/", None, "allow")]
