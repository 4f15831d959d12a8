import random

import pytest
from pyspark.sql import functions as F

from llm_helpers import rows_of
from lodeseek.llm import urlfilter as uf

RULES = [(0, "example.com", "review"), (1, "a.example.com", "block"), (2, "a.example.com/x", "allow"), (3, "a.example.com/x/y", "block"), (4, "com", "allow"), (5, "a.example.com/x", "later"), (6, "other.org/", "block"), (7, "a", "block"), (None, "z.com", "block")]


def unescaped(x):
    out, i = "", 0
    while i < len(x):
        code = x[i + 1 : i + 3]
        if x[i] == "%" and len(code) == 2 and all(c in "0123456789abcdefABCDEF" for c in code):
            c = chr(int(code, 16))
            out += c if c.isascii() and (c.isalnum() or c in "-._~") else "%" + code.upper()
            i += 3
        else:
            out += x[i]
            i += 1
    return out


def canonical(url):
    import re

    if url is None:
        return None
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://|//)?(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)", url.strip(" "))
    host = unescaped(m[1]).lower().rstrip(".")
    if not host:
        return None
    parts, kept = unescaped(m[2]).split("/"), []
    for x in parts:
        if x == "..":
            kept = kept[: max(len(kept) - 1, 1)]
        elif x != ".":
            kept.append(x)
    path = "/".join(kept + [""] * (parts[-1] in (".", "..")))
    numbers = host.split(".")
    address = host[0] == "[" or len(numbers) == 4 and all(n.isdigit() and len(n) < 4 for n in numbers)
    return (host if address else ",".join(reversed(numbers))) + ",)" + (path or "/")


def brute(urls, rules):
    out = []
    for i, url in urls:
        key = canonical(url)
        own = [] if key is None else [(-len(p), n, a) for n, p, a in rules if n is not None and p is not None and key.startswith(p)]
        best = min(own, default=(0, None, None))
        out.append((i, url, key, best[1], best[2], len(own)))
    return sorted(out, key=repr)


def urls():
    rnd = random.Random(1)
    hosts = ["example.com", "www.example.com", "a.example.com", "b.a.example.com", "aexample.com", "EXAMPLE.com.", "other.org", "com", "x.net", "sub.other.org", "a"]
    rows = [(i, rnd.choice(["http://", "https://", "", "//"]) + rnd.choice(["", "", "u:p@"]) + rnd.choice(hosts) + rnd.choice(["", ":80"]) + rnd.choice(["", "/", "/x", "/x/y/z", "/xyz", "/X", "/x?q=/a", "#f", "?q"])) for i in range(300)]
    return rows + [(300, None), (301, ""), (302, "http://"), (303, "/path"), (304, "  http://example.com/  "), (305, "http://a.example.com/x/" + "y" * 100_000), rows[0], rows[0], (None, "http://a.example.com/x"), (306, "http://münchen.de/ü"), (307, "http://"), (308, "http://[2001:DB8::1]:80/a"), (309, "//192.168.0.1/x"), (310, "http://%61.ex%61mple.com/%78/./q/../y%2fz%"), (311, "http://a.example.com/../x/."), (312, "http://a.example.com/x/..")]


@pytest.mark.parametrize("per_range", [7, 50, 20_000])
def test_as_by_hand(spark, per_range):
    rules = [(n, uf.prefix_of(p), a) for n, p, a in RULES] + [(20, "", "default"), (21, None, "none"), (22, "", "default again")]
    df = spark.createDataFrame(urls(), "page_id long, url string").withColumns({"key": F.lit(1), "part": F.lit(2), "id": F.lit(3), "action": F.lit(4)})
    found = uf.matched(df, spark.createDataFrame(rules, "rule_id long, prefix string, action string"), per_range=per_range)
    assert found.columns == ["page_id", "url", "key", "rule_id", "action", "n_rules"]
    assert rows_of(found) == brute(urls(), rules)


def test_keys():
    assert canonical("http://%61.ex%61mple.com/%78/./q/../y%2fz%") == "com,example,a,)/x/y%2Fz%" and canonical("http://[2001:DB8::1]:80/a") == "[2001:db8::1],)/a"
    assert uf.prefix_of("192.168.0.1/x") == "192.168.0.1,)/x" and canonical("http://a.example.com/../x/.") == "com,example,a,)/x/"


def test_a_key_of_most_rows_is_dealt_out(spark):
    rows = [(i, "http://a.example.com/x" if i % 3 else f"http://h{i}.net/") for i in range(900)]
    df, rules = spark.createDataFrame(rows, "page_id long, url string"), [(n, uf.prefix_of(p), a) for n, p, a in RULES]
    ends = uf.ranges(df.select(uf.key_of(F.col("url")).alias("key")), 30)
    assert max(ends.count(x) for x in set(ends)) > 5 and len(uf.ranges(df.select(uf.key_of(F.col("url")).alias("key")), 30, 4)) == 3
    assert rows_of(uf.matched(df, spark.createDataFrame(rules, "rule_id long, prefix string, action string"), per_range=30)) == brute(rows, rules)


def test_many_nested_rules_and_ranges(spark):
    rnd = random.Random(7)
    pages = [(i, f"http://{rnd.choice('abc')}.{rnd.choice('xyz')}.org/" + "/".join(rnd.choice("pq") for _ in range(rnd.randint(0, 6)))) for i in range(2000)]
    rules = [(i, uf.prefix_of(rnd.choice(["", rnd.choice("abc") + "."]) + f"{rnd.choice('xyz')}.org" + rnd.choice(["", "/" + "/".join(rnd.choice("pq") for _ in range(rnd.randint(0, 5)))])), f"act{i}") for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    assert rows_of(uf.matched(df, spark.createDataFrame(rules, "rule_id long, prefix string, action string"), per_range=40)) == brute(pages, rules)


def test_empty(spark):
    df = spark.createDataFrame(urls(), "page_id long, url string")
    none = spark.createDataFrame([], "rule_id long, prefix string, action string")
    assert uf.matched(df.limit(0), uf.rules_table(spark)).count() == 0
    got = uf.matched(df, none)
    assert got.count() == df.count() and got.where("rule_id is not null or n_rules > 0").count() == 0


def test_a_host_is_no_prefix_of_another_name():
    assert not canonical("http://aexample.com").startswith(uf.prefix_of("example.com"))
    assert canonical("http://a.example.com").startswith(uf.prefix_of("example.com"))
    assert not canonical("http://a.example.com/xy").startswith(uf.prefix_of("a.example.com/x/"))
