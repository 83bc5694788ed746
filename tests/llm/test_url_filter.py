import random
import re

import pytest

from fleetlens.llm import url_filter
from fleetlens.llm.url_filter import BLOCK_GLOBS, HOST_RULES, Automaton

URLS = [
    None, "", "no scheme.com/en/", "http://www.example.com/en/a", "http://example.com/en/a?x=/ads/", "HTTPS://A.EXAMPLE.COM/EN/",
    "https://x.net/es/y", "https://net/fr/", "https://xnet/fr/", "http://a.org/b/ads/c", "http://spam-farm.example.org/", "x://",
    "http://www.poker-room.org", "ftp://h.com#top", "http://h.com", "http://h.com?q", "a://b://c/d", "http://ads.org/\n/ads/x",
    "http://é.com/ü", "http://a.com/" + "b" * 20_000, "file:///login", "http://x.org/banner-2024.html", "http://x.org/calendar/2024/01/02",
    "http://evil.org/x.com/y", "http://user@example.com:80/en/", "http://example.com.evil.org/en/",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(v, h + p) for v, h, p in HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        verdict, rule = max(fits, key=lambda x: len(x[1]))
        return host, path, rule, verdict
    wild = lambda g, dot: re.escape(g).replace(r"\*", dot).replace(r"\+", dot).replace(r"\?", ".")
    block = any(re.fullmatch(r"\." + wild(h, ".*"), "." + host, re.S) and re.fullmatch(wild(p, ".*"), path, re.S) for h, p in BLOCK_GLOBS)
    return host, path, None, "block" if block else "allow"


def test_awkward_urls_like_brute_force(spark):
    rows = [(i if i % 5 else None, u, "x", "y") for i, u in enumerate(URLS + URLS[:4])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _after string")
    got = sorted((tuple(r) for r in url_filter.judge(pages).collect()), key=str)
    assert got == sorted(((i, *expected(u)) for i, u, _, _ in rows), key=str)


def test_many_random_patterns_at_once():
    rng = random.Random(3)
    patterns = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 12))) for _ in range(150)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    auto = Automaton([p.encode() for p in patterns])
    assert auto.words > 10
    data = "".join(texts).encode()
    at = [0]
    for t in texts:
        at.append(at[-1] + len(t))
    import numpy as np

    hit = auto.matches(np.frombuffer(data, np.uint8), np.array(at))
    for i, t in enumerate(texts):
        for j, p in enumerate(patterns):
            assert hit[i, j] == bool(re.fullmatch(p.replace("*", ".*").replace("?", "."), t)), (t, p)


def test_empty_table_and_bad_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(pages, host_rules=[("block", "*.com", "/")])
