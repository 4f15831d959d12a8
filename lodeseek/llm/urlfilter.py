"""URL filters as a sort-merge range join of canonical keys with prefix rules.

A key is the host's labels reversed, then the path: http://www.A.example/x?y is example,a,www,)/x. Hosts that are
addresses (1.2.3.4, [2001:db8::1]) stay as they are. Escapes of letters, digits, - . _ ~ are undone, the others have upper-case digits,
and the path has no . or .. segments. All URLs
under a domain or a path prefix are then one interval of keys. Keys and rules are cut into the same ranges (a
rule goes to each range that its interval meets), sorted, and swept once: rules that are open at a key form
a stack, since intervals of prefixes nest, and its top is the most specific one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import table

#: URLs of a range, about, and the most ranges: beyond that ranges get longer (they are sorted outside of memory, and swept in batches).
RANGE, MOST_RANGES = 20_000, 2048
#: Keys sampled for each range to place its ends, at most 131,072 in all; they only decide where work is done.
SAMPLED = 64
_URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://|//)?(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"
_ADDRESS = r"^(\[.*\]|[0-9]{1,3}([.][0-9]{1,3}){3})$"
_PLAIN = {f"{ord(c):02X}": c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"}
_TOP = "\U0010ffff"

#: (pattern, action): a host means it and all hosts under it; a host with a path, that host's URLs from there on.
RULES = [
    ("example.com", "review"),
    ("example.net", "review"),
    ("example.org", "review"),
    *[(f"{host}.example.{tld}", "block") for host in ("spam-farm", "cheap-pills", "free-bets", "casino", "adult", "warez", "phish", "malware") for tld in ("com", "net", "org")],
    *[(f"m.{host}.example.{tld}", "block") for host in ("spam-farm", "cheap-pills", "free-bets") for tld in ("com", "net", "org")],
    ("www.cheap-pills.example.com", "review"),
    ("www.cheap-pills.example.com/en/9", "allow"),
    ("www.cheap-pills.example.com/en/92", "block"),
    ("spam-farm.example.org/en/7", "review"),
    ("spam-farm.example.org/en/72", "allow"),
    ("m.free-bets.example.com/de", "review"),
    ("m.free-bets.example.com/de/2", "allow"),
    ("blog.theres.example.com", "allow"),
    ("blog.theres.example.com/en", "allow"),
    ("blog.theres.example.com/en/65", "block"),
    ("blog.tionsh.example.net/es", "allow"),
    ("ththre.example.com/en/5", "block"),
    ("ththre.example.com/fr", "review"),
    ("ththre.example.com/fr/8", "block"),
    ("thther.example.net", "allow"),
    ("thther.example.org/en", "allow"),
    ("thther.example.org/en/6", "block"),
    ("www.therti.example.org", "block"),
    ("blog.ththan.example.net/fr/4", "allow"),
    ("com", "allow"),
    ("net", "allow"),
    ("example.edu", "allow"),
    ("", "allow"),
]


def _unescaped(x: Column) -> Column:
    plain = F.create_map(*[F.lit(v) for kv in _PLAIN.items() for v in kv])

    def part(p, i):
        code = F.upper(F.substring(p, 1, 2))
        rest = F.substring(p, 3, 1 << 30)
        known = F.element_at(plain, code)
        return F.when(i == 0, p).when(known.isNotNull(), F.concat(known, rest)).when(code.rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), code, rest)).otherwise(F.concat(F.lit("%"), p))

    return F.when(x.contains("%"), F.array_join(F.transform(F.split(x, "%"), part), "")).otherwise(x)


def _without_dots(path: Column) -> Column:
    parts = F.split(path, "/")

    def step(acc, x):
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    return F.when(path.contains("/."), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")).otherwise(path)


def key_of(url: Column) -> Column:
    """The canonical key of a URL: no scheme, user, port, query or fragment, lower-case host. Null without a host."""
    host = F.regexp_replace(F.lower(_unescaped(F.regexp_extract(F.trim(url), _URL, 1))), "[.]+$", "")
    path = _without_dots(_unescaped(F.regexp_extract(F.trim(url), _URL, 2)))
    labels = F.when(host.rlike(_ADDRESS), host).otherwise(F.array_join(F.reverse(F.split(host, "[.]")), ","))
    key = F.concat(labels, F.lit(",)"), F.when(path == "", "/").otherwise(path))
    return F.when(F.length(host) > 0, key)


def prefix_of(pattern: str) -> str:
    """The key prefix of a rule pattern; the empty pattern is the prefix of every key."""
    host, slash, path = pattern.partition("/")
    if not host:
        return ""
    host = host.lower()
    return (host if re.match(_ADDRESS, host) else ",".join(reversed(host.split(".")))) + "," + (f")/{path}" if slash else "")


def _upper(prefix: str) -> str:
    return prefix + _TOP


def ranges(keys: DataFrame, per_range: int = RANGE, most: int = MOST_RANGES) -> list[str]:
    """Ends that cut keys (one column, key) into ranges of about per_range rows, most ranges at most. A key of many rows is there several times."""
    n = keys.count()
    parts = min(most, -(-n // per_range))
    if parts < 2:
        return []
    sample = sorted(r[0] for r in keys.sample(min(1.0, SAMPLED * parts / n), seed=3).limit(2 * SAMPLED * parts).collect())
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def matched(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", per_range: int = RANGE) -> DataFrame:
    """(id, url, key, rule_id, action, n_rules) of every row of urls; rules: (rule_id long, prefix string, action string).

    The rule is the one of the longest prefix of the key, of equal prefixes that of the least rule_id; n_rules
    counts all rules that match. URLs without a host (null, empty) and those that no rule matches have a null
    rule and action and count 0. Rules with a null id or prefix are dropped. Repeated rows give repeated
    results; extra columns are not read; empty tables are no special case.
    """
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), key_of(F.col(url_col)).alias("key"))
    ends = ranges(rows.where("key is not null").select("key"), per_range)

    @F.arrow_udf("int")
    def part(keys: pa.Array) -> pa.Array:
        out = []
        for i, k in enumerate(keys.to_pylist()):
            a, b = bisect_left(ends, k), bisect_right(ends, k)
            # rows of a key that is the end of several ranges are dealt out among them
            out.append(b if b - a < 2 else a + 1 + i % (b - a))
        return pa.array(out, pa.int32())

    @F.arrow_udf("array<int>")
    def parts(prefixes: pa.Array) -> pa.Array:
        return pa.array([list(range(min(bisect_right(ends, p), bisect_left(ends, p) + 1), bisect_left(ends, _upper(p)) + 1)) for p in prefixes.to_pylist()], pa.list_(pa.int32()))

    none = F.lit(None)
    marks = rules.where("rule_id is not null and prefix is not null").select(F.explode(parts("prefix")).alias("part"), F.col("prefix").alias("key"), F.lit(0).alias("kind"), none.cast(rows.schema["id"].dataType).alias("id"), none.cast("string").alias("url"), "rule_id", "action")
    points = rows.where("key is not null").select(part("key").alias("part"), "key", F.lit(1).alias("kind"), "id", "url", none.cast("long").alias("rule_id"), none.cast("string").alias("action"))
    line = points.unionByName(marks).repartition(len(ends) + 1, "part").sortWithinPartitions("part", "key", "kind", F.desc("rule_id"))
    id_type = dict(rows.dtypes)["id"]

    def sweep(batches):
        stack: list[tuple[str, int, str]] = []
        at = None
        for b in batches:
            out: list[list] = [[], [], []]
            take = []
            cols = [b.column(c).to_pylist() for c in ("part", "key", "kind", "rule_id", "action")]
            for i, (p, key, kind, rule, action) in enumerate(zip(*cols)):
                if p != at:
                    at, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    stack.append((key, rule, action))
                else:
                    take.append(i)
                    top = stack[-1] if stack else (None, None, None)
                    out[0].append(top[1])
                    out[1].append(top[2])
                    out[2].append(len(stack))
            own = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("url"), own.column("key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], ["id", "url", "key", "rule_id", "action", "n_rules"])

    swept = line.mapInArrow(sweep, f"id {id_type}, url string, key string, rule_id long, action string, n_rules int")
    rest = rows.where("key is null").select("id", "url", "key", none.cast("long").alias("rule_id"), none.cast("string").alias("action"), F.lit(0).alias("n_rules"))
    return swept.unionByName(rest).withColumnRenamed("id", id_col)


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([(i, prefix_of(p), a) for i, (p, a) in enumerate(rules)], "rule_id long, prefix string, action string")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(table(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark))


def _unescaped_sql(x: str) -> str:
    plain = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in _PLAIN.items()) + "}"
    known = f"{plain}[upper(p[1:2])]"
    return f"""(string_split({x}, '%')[1] || array_to_string(list_transform(string_split({x}, '%')[2:], lambda p: case when {known} is not null then {known} || p[3:]
      when regexp_matches(p[1:2], '^[0-9A-Fa-f]{{2}}$') then '%' || upper(p[1:2]) || p[3:] else '%' || p end), ''))"""


SQL = rf"""
with rules(rule_id, prefix, action) as (values {', '.join(f"({i}, '{prefix_of(p)}', '{a}')" for i, (p, a) in enumerate(RULES))}),
cut as (
  select page_id, url, regexp_extract(trim(url), '{_URL}', 1) as h, regexp_extract(trim(url), '{_URL}', 2) as p from pages
), parsed as (
  select page_id, url, regexp_replace(lower({_unescaped_sql('h')}), '[.]+$', '') as host, string_split({_unescaped_sql('p')}, '/') as segs from cut
), walked as (
  select *, list_reduce(list_transform(segs, lambda x: [x]), lambda acc, x: case x[1] when '.' then acc when '..' then acc[1:greatest(len(acc) - 1, 1)] else acc || x end) as kept from parsed
), joined as (
  select page_id, url, host, array_to_string(case when segs[-1] in ('.', '..') and len(segs) > 1 then kept || [''] else kept end, '/') as path from walked
), keyed as (
  select page_id, url, case when length(host) > 0 then case when regexp_matches(host, '{_ADDRESS}') then host else array_to_string(list_reverse(string_split(host, '.')), ',') end
    || ',)' || case when path = '' then '/' else path end end as key from joined
), best as (
  select page_id, url, key, arg_min(r.rule_id, (-length(prefix), r.rule_id)) as rule_id, arg_min(action, (-length(prefix), r.rule_id)) as action, count(r.rule_id)::int as n_rules
  from (select *, row_number() over () as rn from keyed) k left join rules r on starts_with(key, prefix) group by rn, page_id, url, key
)
select page_id, url, key, rule_id::bigint as rule_id, action, n_rules from best
"""
