import random
import re

import pyarrow as pa
import pytest

from quillstream.llm import url_filter as U


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, rule, verdict = max(fit)
        return host, path, rule, verdict
    bad = re.fullmatch(r"(?s)([^/]*doubleclick\.net/.*|.*/wp-admin/.*|.*/cgi-bin/.*|.*\.exe|.*\.zip)", host + path)
    return host, path, None, "block" if bad else "allow"


def test_against_rules_one_by_one(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "a.example.com", "notexample.com", "EXAMPLE.net", "x.example.net", "org", "W.org", "example.com.evil", "", ".com", "ad.doubleclick.net", "É.com"]
    paths = ["", "/", "/en/", "/en/7", "/en", "/en/71?x", "/de/8", "/de/", "/de/9#/en/", "/es/", "/x.com/en/", "/wp-admin/a", "/a.exe", "?q=/en/", "/En/"]
    urls = [rng.choice(["http://", "https://", "", "a://b://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(600)]
    urls += [None, "", "://", "no scheme", "http://com/en/" + "a" * 20_000, "HTTP://COM/en/\n7", "http://x.exe"]
    rows = [(k, u, "c") for k, u in enumerate(urls)] + [(None, "http://com/en/", "c"), (3, urls[3], "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, URL string")
    got = U.judge_urls(df).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: tuple(r)[1:] for r in got if r.page_id is not None}
    for k, u, _ in rows[: len(urls)]:
        assert by_id[k] == brute(u), u
    assert [tuple(r)[3:] for r in got if r.page_id is None] == [("com/en/", "block")]


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_automaton_against_patterns(seed):
    rng = random.Random(seed)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "\\*"]) for _ in range(rng.randint(0, 40))) for _ in range(40)]

    def pattern(g):
        out, i = "", 0
        while i < len(g):
            if g[i : i + 2] == "**":
                out, i = out + ".*", i + 2
            elif g[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif g[i] == "?":
                out, i = out + ".", i + 1
            elif g[i] == "\\":
                out, i = out + re.escape(g[i + 1]), i + 2
            else:
                out, i = out + re.escape(g[i]), i + 1
        return re.compile(out, re.S)

    texts = ["".join(rng.choice("ab/*") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    hit = U.GlobAutomaton.build(globs).matches(pa.array(texts))
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert bool(hit[i, j]) == bool(pattern(g).fullmatch(t)), (t, g)
