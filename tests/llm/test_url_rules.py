"""URL rules against a plain version."""

from __future__ import annotations

import random

import pytest

from kerbstat.llm import url_rules
from kerbstat.llm.queries import op2_url_filters


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_judge(url, rules, default="allow"):
    host, path = plain_split(url)
    fits = [r for r in rules if None not in r and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "allow"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


FIXED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URLS = [
    None, "", "no scheme", "http://", "https://example.com", "https://Example.COM/", "x://example.com/en/a?b=/fr/", "x://a.www.example.com/en/",
    "x://www.example.com/en", "x://net/es/", "x://a.net/fr/x#y", "x://anet/es/", "x://.net/es/", "x://com./", "x://a..com/#", "a://b://c.com/x",
    "x://ÉXAMPLE.com/en/", "x://b.com?q=/", "x://host\nline.com/p\nq", "x://" + "a." * 3000 + "net/es/" + "p" * 5000,
]


def test_fixed_rules(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(None, URLS[6], "h", 1)] * 2, "page_id bigint, url string, host string, rule int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = op2_url_filters(spark, str(tmp_path)).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        want = plain_judge(URLS[6] if r["page_id"] is None else URLS[r["page_id"]], FIXED)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want


@pytest.mark.parametrize("part", [3, 100_000])
def test_nested_rules_in_parts(spark, part):
    rng = random.Random(part)
    hosts = [".".join(rng.choice(["a", "b", "ab", "com"]) for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/bc", "/ab", "/b/a/"]
    rules = list({(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(50)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"s://{rng.choice(['', 'x.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'c', '/z'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    frame = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("a", None, "block"), ("a", "/", None)], "host string, path string, verdict string")
    for r in url_rules.judge(pages, frame, "block", part=part).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_judge(urls[r["page_id"]], rules, "block")


def test_no_pages_and_no_rules(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.judge(spark.createDataFrame([(1, "x://a/b")], none.schema), rules).first()["verdict"] == "allow"
    none.write.parquet(f"{tmp_path}/pages.parquet")
    assert op2_url_filters(spark, str(tmp_path)).count() == 0
