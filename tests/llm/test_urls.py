"""The cascade against set membership, and the rules against a plain reading."""

import pytest
from pyspark.sql import functions as F

from siteweave.llm import urls


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, rule in rules:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            key = (len(rule_host.split(".")), len(rule_path))
            if best is None or key > best[0]:
                best = (key, rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [
    None, "", "no host", "http://", "://", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en/1", "http://www.example.net/en/",
    "http://example.net/en", "http://notexample.net/en/", "https://a.example.com/de/?q=/en/", "https://example.com/en/", "http://b.org/fr/#x", "http://org/fr/",
    "http://org?/fr/", "a://b://net/", "http://x.net?y/z", "http://É.NET/é", "http://..net/", "http://net.com/", "http://example.net:80/en/", "x\n://a.net/\nb",
]


@pytest.mark.parametrize("max_bytes", [32 << 20, 0])
def test_rules_like_a_plain_reading(frame, compare, max_bytes):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[8], "x"), (None, URLS[7], "x")]
    got = urls.judge(frame(rows, "page_id long, url string, host string"), max_bytes=max_bytes).collect()
    compare(got, [(i, *plain(u, urls.RULES)) for i, u, _ in rows])


def test_many_rules_need_several_levels(spark, frame, compare):
    rules = tuple(("allow" if i % 3 else "block", f"h{i}.com/{'a' if i % 2 else ''}") for i in range(0, 400, 2))
    rows = [(i, f"http://s{i}.h{i % 500}.com/{'ab'[i % 2]}/x") for i in range(3000)]
    got = urls.judge(frame(rows, "page_id long, url string"), rules).collect()
    compare(got, [(i, *plain(u, rules)) for i, u in rows])


def test_cascade_is_exact_for_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.substring("key", -2, 2) == "17")
    levels = urls.build_cascade(listed, universe, 20_000)
    assert len(levels) > 1
    got = universe.filter(urls.listed_by(F.col("key"), levels))
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in listed.collect())
    assert sum(len(x.bits) for x in levels) < 1500


def test_empty_table_and_no_rules(frame):
    schema = "page_id long, url string"
    assert urls.judge(frame([], schema)).collect() == []
    assert [r["verdict"] for r in urls.judge(frame([(1, "http://a.net/")], schema), ()).collect()] == ["allow"]
