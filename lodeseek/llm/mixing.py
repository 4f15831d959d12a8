"""Mixing sources to target weights over a domain - language - source tree.

A token budget goes down the tree: each node splits its own among its children by weight, none above what
its leaves can give (MAX_EPOCHS times their tokens). What a child can't take its siblings take, by weight; as
no node is given more than its leaves hold, a shortage passes to an ancestor's other children only once all
siblings are full. Leaves then read their documents in epochs, each in an order of its own made from SEED:
whole epochs, and of the last one the prefix that makes up the allotted tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import TOKEN, n_tokens, table, written

LEVELS = ("domain", "lang", "source")
DOMAINS = {"web": 40, "reference": 25, "forum": 15, "books": 20, "other": 5}
LANGS = {"en": 50, "de": 20, "fr": 20}
#: Weight of a language that LANGS hasn't, and of every source.
LANG, SOURCE = 10, 1
#: The budget is this share (percent) of all tokens; a leaf's documents are read so many times at most.
BUDGET_PERCENT, MAX_EPOCHS = 80, 4
SEED = 20
#: Hex digits of a document's place in an epoch by which prefixes are first summed: 16**DIGITS buckets a leaf.
DIGITS = 3
NONE = "(none)"


def domain_of(source):
    """The domain of a source by its number; sources without one are of the domain other."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", "other").otherwise(F.element_at(F.array(*map(F.lit, ("web", "reference", "forum", "books"))), (F.when(number == "", "0").otherwise(number).cast("int") % 4 + 1)))


def _weights(level: str, weights: dict):
    if level == "source":
        return F.lit(SOURCE).cast("long")
    rest = DOMAINS["other"] if level == "domain" else LANG
    found = F.lit(rest)
    for k, w in weights.items():
        found = F.when(F.col(level) == k, w).otherwise(found)
    return found.cast("long")


def split(nodes: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """Gives each node (cap, w) its alloc of its parent's given, all integers.

    Children are filled in the order of cap / w: as long as a child's share of what is left reaches its cap
    it gets its cap; from the first one that isn't filled on, all get their share of what is left then,
    rounded down. Fewer tokens than there are children may stay unspent.
    """
    over = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = over.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("rn", F.row_number().over(order)).withColumn("left", F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    n = n.withColumn("lw", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    n = n.withColumn("stop", F.min(F.when(F.expr("w = 0 or cap * lw > left * w"), F.col("rn"))).over(over))
    n = n.withColumn("left", F.max(F.when(F.expr("rn = stop"), F.col("left"))).over(over)).withColumn("lw", F.max(F.when(F.expr("rn = stop"), F.col("lw"))).over(over))
    return n.withColumn("alloc", F.expr("case when stop is null or rn < stop then cap when w = 0 then 0L else (left * w) div lw end")).drop("rn", "left", "lw", "stop")


def budget(leaves: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, total: int | None = None, domains: dict | None = None, langs: dict | None = None) -> DataFrame:
    """leaves (domain, lang, source, tokens) with the alloc of each, top down."""
    weight = {"domain": DOMAINS if domains is None else domains, "lang": LANGS if langs is None else langs, "source": {}}
    n = leaves.where("tokens > 0")
    for level in LEVELS:
        n = n.withColumn(f"w_{level}", _weights(level, weight[level]))
    # what no weight reaches has no capacity
    n = n.withColumn("leaf_cap", F.when(F.expr("w_domain > 0 and w_lang > 0 and w_source > 0"), F.col("tokens") * max_epochs).otherwise(0))
    n = n.withColumn("leaf_cap", F.col("leaf_cap").cast("long"))
    every = Window.partitionBy(F.lit(0))
    want = F.lit(total).cast("long") if total is not None else F.expr(f"sum(tokens) over (partition by 0) * {percent} div 100")
    n = n.withColumn("given", want).withColumn("given", F.least(F.col("given"), F.sum("leaf_cap").over(every)))
    for i, level in enumerate(LEVELS):
        parent, here = LEVELS[:i], LEVELS[: i + 1]
        nodes = n.groupBy(*here).agg(F.sum("leaf_cap").alias("cap"), F.max(f"w_{level}").alias("w"), F.max("given").alias("given"))
        n = n.drop("given").join(split(nodes, parent, level).select(*here, F.col("alloc").alias("given")), list(here))
    return n.select(*LEVELS, "tokens", F.col("given").alias("alloc"))


def _leafed(docs: DataFrame, *columns: str) -> DataFrame:
    """(row, domain, lang, source, id): the columns of docs' rows as structs, their leaves, and id for the place in an epoch: of doc_id and text, so that rows of one id, or of none, have places of their own."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return docs.select(row.alias("row"), domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit(NONE)).alias("lang"), F.coalesce("source", F.lit(NONE)).alias("source"), F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE)), F.md5("text")).alias("id"), F.col("text"))


def _counted(docs: DataFrame, *columns: str) -> DataFrame:
    """_leafed() of the rows that have a token, with t, their tokens, in place of the text: written, so that they are counted once."""
    return written(_leafed(docs, *columns).withColumn("t", n_tokens(F.col("text"))).drop("text").where("t > 0"))


def _place(epoch):
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.col("id")))


def _planned(counted: DataFrame, **how) -> DataFrame:
    """(leaf, full, rest, end, before): whole epochs of each leaf, the tokens of its last one, and where that ends: in the bucket end of places, before which are before tokens."""
    own = list(LEVELS)
    plan = budget(counted.groupBy(*own).agg(F.sum("t").alias("tokens")), **how)
    plan = written(plan.select(*own, F.expr("alloc div tokens").alias("full"), F.expr("alloc % tokens").alias("rest")))
    bucket = F.substring(_place(F.col("full") + 1), 1, DIGITS)
    sums = counted.join(plan, own).where("rest > 0").groupBy(*own, "rest", bucket.alias("b")).agg(F.sum("t").alias("t"))
    before = Window.partitionBy(*own).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0))).where("before < rest and before + t >= rest").select(*own, F.col("b").alias("end"), "before")
    return written(plan.join(ends, own, "left"))


def _reads(rows: DataFrame, plan: DataFrame, tokens) -> tuple[DataFrame, DataFrame]:
    """What is read whole (a row for each epoch), and the rows of the buckets in which prefixes end, with t and take.

    Only the latter meet in one place: a bucket is one of 16**DIGITS of a leaf.
    """
    own = list(LEVELS)
    at = rows.join(plan, own).withColumn("place", F.when(F.col("rest") > 0, _place(F.col("full") + 1)))
    b = F.substring("place", 1, DIGITS)
    n = F.col("full") + F.when(b < F.col("end"), 1).otherwise(0)
    whole = at.withColumn("n", n).where("n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    edge = at.where(b == F.col("end")).withColumn("t", tokens)
    # rows of one place are the same in id and text: then their other columns say which comes first
    start = Window.partitionBy(*own).orderBy("place", F.to_json("row")).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum("t").over(start), F.lit(0))).where("left > 0").withColumn("take", F.least("t", "left"))
    return whole, edge.withColumn("epoch", F.col("full") + 1)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """(row, domain, epoch, t, take): a row per document and epoch that reads it; row: docs' columns but the text, t: its tokens, take: those read.

    take is less than t for the one document of a leaf where its prefix ends. Null lang and source are
    leaves named (none). Texts without a token (null, empty) are never read. Repeated rows count and are
    read as often as they are there. The order of the input's rows makes no difference. Columns that docs has
    besides are passed on in row, whatever their names. An empty table gives an empty one.
    """
    counted = _counted(docs, *[c for c in docs.columns if c != "text"])
    whole, edge = _reads(counted, _planned(counted, **how), F.col("t"))
    keep = ["row", "domain", "epoch", "t", "take"]
    return whole.withColumn("take", F.col("t")).select(*keep).unionByName(edge.select(*keep))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows that mixed() reads, with docs' columns; where a prefix ends inside a text, the text is cut there.

    A cut text has its tokens joined by blanks, and n_chars, if docs has it, is its length.
    """
    plan = _planned(_counted(docs, "doc_id"), **how)
    rows = _leafed(docs, *docs.columns).where(F.col("text").rlike(TOKEN))
    whole, edge = _reads(rows, plan, n_tokens(F.col("text")))
    cut = F.expr("take < t")
    text = F.when(cut, F.expr("array_join(slice(regexp_extract_all(text, '[^ \\\\t\\\\n\\\\r]+', 0), 1, cast(take as int)), ' ')")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    return whole.select(*[own[c].alias(c) for c in docs.columns]).unionByName(edge.select(*[changed.get(c, own[c]).alias(c) for c in docs.columns]))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens): what the mixture reads of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("row.doc_id", "domain", "row.lang", "row.source", "epoch", F.col("t").alias("n_tokens"), F.col("take").alias("take_tokens"))


def _cases(column: str, weights: dict, rest: int) -> str:
    return f"(case {column} " + " ".join(f"when '{k}' then {w}" for k, w in weights.items()) + f" else {rest} end)"


def _split_sql(name: str, level: int) -> str:
    here, parent = ", ".join(LEVELS[: level + 1]), ", ".join(LEVELS[:level]) or "1"
    own = LEVELS[level]
    return f"""
n{name} as (select {here}, sum(cap) as cap, max(w{level}) as w, max(given) as given from g{level} group by {here}),
o{name} as (select *, row_number() over (partition by {parent} order by cap::double / w, {own}) as rn,
  given - coalesce(sum(cap) over (partition by {parent} order by cap::double / w, {own} rows between unbounded preceding and 1 preceding), 0) as lft,
  sum(w) over (partition by {parent} order by cap::double / w, {own} rows between current row and unbounded following) as lw from n{name}),
s{name} as (select *, min(case when cap * lw > lft * w then rn end) over (partition by {parent}) as stop from o{name}),
t{name} as (select *, max(case when rn = stop then lft end) over (partition by {parent}) as sl, max(case when rn = stop then lw end) over (partition by {parent}) as sw from s{name}),
a{name} as (select {here}, case when stop is null or rn < stop then cap else (sl * w) // sw end as given from t{name}),
g{level + 1} as (select g.* exclude (given), a.given from g{level} g join a{name} a using ({here}))"""


def mix_sql(docs: str) -> str:
    """CTEs up to reads (doc_id, text, lang, source, n_chars, domain, epoch, n_tokens, take_tokens) over the rows of the table docs."""
    return rf"""
rows_ as (
  select *, case when coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') = '' then 'other'
      else ['web', 'reference', 'forum', 'books'][regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 4 + 1] end as domain,
    len(regexp_extract_all(text, '[^ \t\n\r]+'))::bigint as t, coalesce(lang, '{NONE}') as l_, coalesce(source, '{NONE}') as s_, coalesce(doc_id::varchar, '{NONE}') || '|' || md5(text) as id_ from {docs}
),
leaves as (select domain, l_ as lang, s_ as source, sum(t)::hugeint as tokens from rows_ where t > 0 group by all),
g0 as (select *, {_cases('domain', DOMAINS, DOMAINS['other'])}::hugeint as w0, {_cases('lang', LANGS, LANG)}::hugeint as w1, {SOURCE}::hugeint as w2, tokens * {MAX_EPOCHS} as cap,
  least(sum(tokens) over () * {BUDGET_PERCENT} // 100, sum(tokens) over () * {MAX_EPOCHS}) as given from leaves),
{','.join(_split_sql(f'_{i}', i) for i in range(3))},
plan as (select domain, lang, source, (given // tokens)::bigint as full_, (given % tokens)::bigint as rest_ from g3),
joined as (select r.*, p.full_, p.rest_ from rows_ r join plan p on r.domain = p.domain and r.l_ = p.lang and r.s_ = p.source where t > 0),
ordered as (select *, coalesce(sum(t) over (partition by domain, l_, s_ order by md5('{SEED}:' || (full_ + 1) || ':' || id_) rows between unbounded preceding and 1 preceding), 0) as start_ from joined),
reads as (
  select * exclude (t, full_, rest_, start_, l_, s_, id_, epoch_), epoch_ as epoch, t as n_tokens, t as take_tokens from (select *, unnest(generate_series(1, full_)) as epoch_ from ordered)
  union all by name select * exclude (t, full_, rest_, start_, l_, s_, id_), full_ + 1 as epoch, t as n_tokens, least(t, rest_ - start_)::bigint as take_tokens from ordered where start_ < rest_
)"""


SQL = f"with {mix_sql('documents')} select doc_id, domain, lang, source, epoch, n_tokens, take_tokens from reads"
