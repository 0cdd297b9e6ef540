"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a domain-language-source tree.  At every node it is shared among the
children by weight; a child never gets more than its capacity (its tokens times ``max_epochs``),
and what it cannot take goes to its siblings by weight.  Only when all siblings are full does the
shortage reach the parent's level, where it is shared in the same way.  A leaf with budget b and T
tokens takes ``b div T`` whole epochs and a token-prefix of ``b mod T`` tokens of one more epoch,
whose order is a hash seeded by seed and epoch.

Scale: built-in functions only.  Documents meet the leaf table (one row a leaf, written once, so
the planner sees its true size and broadcasts only a small one) in a map-side join and are never
shuffled with their texts.  The prefix is found by descent: tokens by hash bucket (256 a leaf), then
by the 256 parts of the one bucket in which the prefix ends, and so on; what is left, one part in
16 million of a leaf, is ordered exactly.  No leaf, however large, is sorted whole.

Defined cases: null levels count as ``(null)``; weights that are not listed are 1; documents
without a token (null, empty, blank) are never selected; rows that repeat an id within a leaf are
taken together or not at all; an empty table gives an empty result; a budget beyond all capacity
takes everything ``max_epochs`` times.  Shares are floored, so a node may leave fewer tokens
unspent than it has children.  Columns named like the result's (``domain`` and so on) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Store

LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"web": 60, "curated": 40}, "lang": {"de": 20, "en": 50, "es": 10, "fr": 20}, "source": {}}
WEB = tuple(f"src{i}" for i in range(10))
#: DIGITS: hexadecimal digits of a document's hash that are resolved by sums before any sorting.
MAX_EPOCHS, SEED, DIGITS = 4, 17, 6
#: The budget, as a share of the corpus's tokens.
NUM, DEN = 6, 10
BLANK = " \\t\\n\\r\\f"


def domain_of(source: Column) -> Column:
    return F.when(source.isin(*WEB), "web").otherwise("curated")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("decimal(38,0)")


def budgets(leaves: DataFrame, total: Column, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, levels=LEVELS) -> DataFrame:
    """``leaves`` (levels, tokens) with ``budget``, from capacities and weights, level by level."""
    cap = F.sum(F.col("tokens") * max_epochs)
    nodes = leaves.withColumn("given", F.least(total, cap.over(Window.partitionBy(F.lit(0)))))
    for depth, level in enumerate(levels):
        above, here = list(levels[:depth]), list(levels[: depth + 1])
        child = nodes.groupBy(*here).agg(cap.cast("decimal(38,0)").alias("cap"), F.max("given").cast("decimal(38,0)").alias("b")).withColumn("w", _weight(level, weights))
        order = Window.partitionBy(*(above or [F.lit(0)])).orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), level)
        child = child.withColumn("c0", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)"))
        child = child.withColumn("w0", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("decimal(38,0)"))
        full = (F.col("b") - F.col("c0")) * F.col("w") > F.col("cap") * F.col("w0")
        child = child.withColumn("full", full)
        first = Window.partitionBy(*(above or [F.lit(0)]))
        child = child.withColumn("rest", F.max(F.when(~F.col("full"), F.struct(F.col("w0"), F.col("b") - F.col("c0")))).over(first))
        share = F.expr("cast(rest.col2 as decimal(38,0)) * w div rest.w0")
        child = child.select(*here, F.when(F.col("full"), F.col("cap")).otherwise(share).cast("long").alias("share"))
        nodes = nodes.drop("given").join(child, here).withColumnRenamed("share", "given")
    return nodes.withColumnRenamed("given", "budget")


def _ordering(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: dict = WEIGHTS, num: int = NUM, den: int = DEN, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain=domain_of) -> DataFrame:
    """The selected documents with ``domain``, ``n_tokens`` and ``copies`` (1 or more)."""
    spark, levels = docs.sparkSession, list(LEVELS)
    store = Store(spark)
    keyed = docs.withColumn("domain", F.coalesce(domain(F.col("source")), F.lit("(null)"))).withColumn("n_tokens", token_count(F.col("text")))
    leaf = {f"__hf_{x}": F.coalesce(F.col(x), F.lit("(null)")) for x in levels}
    keyed = keyed.withColumns(leaf)
    slim = store.write(keyed.where("n_tokens > 0").select("doc_id", *(F.col(f"__hf_{x}").alias(x) for x in levels), "n_tokens"))
    stats = slim.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    total = F.expr(f"cast(sum(tokens) over (partition by 0) * {num} div {den} as long)")
    plan = budgets(stats.withColumn("all", total), F.col("all"), weights, max_epochs).select(*levels, "tokens", "budget")
    plan = store.write(plan.withColumn("epoch", F.expr("budget div tokens")).withColumn("prefix", F.expr("budget % tokens")))
    ranked = slim.join(plan, levels).withColumn("h", _ordering(F.col("doc_id"), F.col("epoch"), seed))
    run = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = plan.select(*levels, F.lit("").alias("last"), F.lit(0).cast("long").alias("s0"))
    for depth in range(1, DIGITS // 2 + 1):
        # Two more digits of the one bucket in which the prefix ends: at most 256 sums a leaf.
        inside = ranked.join(ends, levels).where(F.col("h").startswith(F.col("last"))).withColumn("bucket", F.substring("h", 1, 2 * depth))
        sums = inside.groupBy(*levels, "prefix", "s0", "bucket").agg(F.sum("n_tokens").alias("s"))
        sums = sums.withColumn("s1", (F.col("s0") + F.coalesce(F.sum("s").over(run), F.lit(0))).cast("long")).where("s1 <= prefix and prefix < s1 + s")
        ends = store.write(sums.select(*levels, F.col("bucket").alias("last"), F.col("s1").alias("s0")))
    within = ranked.join(ends, levels).where(F.col("h").startswith(F.col("last"))).groupBy(*levels, "prefix", "s0", "h", "doc_id").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*levels).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = store.write(within.withColumn("c", F.col("s0") + F.sum("n").over(upto)).where("c <= prefix").select(*levels, "doc_id").distinct())
    side = lambda t, tag: t.select(*(F.col(c).alias(f"{tag}{c}") for c in t.columns))
    on = lambda tag: [F.col(f"__hf_{x}") == F.col(f"{tag}{x}") for x in levels]
    out = keyed.where("n_tokens > 0").join(side(plan, "__hf_p_"), on("__hf_p_")).join(side(ends, "__hf_e_"), on("__hf_e_"), "left")
    out = out.join(side(edge, "__hf_b_"), [*on("__hf_b_"), F.col("doc_id").eqNullSafe(F.col("__hf_b_doc_id"))], "left")
    bucket = F.substring(_ordering(F.col("doc_id"), F.col("__hf_p_epoch"), seed), 1, DIGITS)
    extra = (bucket < F.col("__hf_e_last")) | F.coalesce(F.col("__hf_b_domain").isNotNull(), F.lit(False))
    out = out.withColumn("copies", (F.col("__hf_p_epoch") + F.when(extra, 1).otherwise(0)).cast("long")).where("copies > 0")
    return out.select(*[c for c in docs.columns if c not in ("domain", "n_tokens", "copies")], "domain", "n_tokens", "copies")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _level_sql(depth: int) -> str:
    above, here = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
    part = "PARTITION BY " + ", ".join(above) if above else ""
    prev = f"n{depth}"
    w = "CASE " + " ".join(f"WHEN {LEVELS[depth]} = '{k}' THEN {v}" for k, v in WEIGHTS[LEVELS[depth]].items()) + " ELSE 1 END" if WEIGHTS[LEVELS[depth]] else "1"
    k = ", ".join(here)
    return f"""
a{depth} AS (SELECT {k}, CAST(sum(tokens * {MAX_EPOCHS}) AS HUGEINT) AS cap, CAST(max(given) AS HUGEINT) AS b, CAST({w} AS HUGEINT) AS w FROM {prev} GROUP BY ALL),
c{depth} AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w0
  FROM a{depth} WINDOW o AS ({part} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {LEVELS[depth]})),
f{depth} AS (SELECT *, (b - c0) * w > cap * w0 AS isfull FROM c{depth}),
s{depth} AS (SELECT *, max(CASE WHEN NOT isfull THEN w0 END) OVER q AS rw, min(CASE WHEN NOT isfull THEN b - c0 END) OVER q AS rb_any, max(CASE WHEN NOT isfull THEN b - c0 END) OVER q AS rb FROM f{depth} WINDOW q AS ({part})),
n{depth + 1} AS (SELECT p.* EXCLUDE (given), CAST(CASE WHEN s.isfull THEN s.cap ELSE s.rb * s.w // s.rw END AS BIGINT) AS given FROM {prev} p JOIN s{depth} s USING ({k}))"""


SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IN ({", ".join(f"'{s}'" for s in WEB)}) THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
  lang AS lang0, source AS source0, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS BIGINT) AS n_tokens FROM documents),
k AS (SELECT * FROM d WHERE n_tokens > 0),
l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM k GROUP BY ALL),
n0 AS (SELECT *, CAST(least((SELECT sum(tokens) * {NUM} // {DEN} FROM l), (SELECT sum(tokens) * {MAX_EPOCHS} FROM l)) AS BIGINT) AS given FROM l),
{_level_sql(0)}, {_level_sql(1)}, {_level_sql(2)},
p AS (SELECT domain, lang, source, given // tokens AS epoch, given % tokens AS prefix FROM n3),
h AS (SELECT k.*, p.epoch, p.prefix, md5('{SEED}:' || p.epoch || ':' || k.doc_id) AS h FROM k JOIN p USING (domain, lang, source)),
g AS (SELECT domain, lang, source, h, doc_id, any_value(prefix) AS prefix, sum(n_tokens) AS n FROM h GROUP BY ALL),
c AS (SELECT domain, lang, source, doc_id, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) <= prefix AS extra FROM g)
SELECT h.doc_id, h.domain, h.lang0 AS lang, h.source0 AS source, h.n_tokens, CAST(h.epoch + CASE WHEN c.extra THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM h JOIN c ON h.doc_id = c.doc_id AND h.domain = c.domain AND h.lang = c.lang AND h.source = c.source
WHERE h.epoch + CASE WHEN c.extra THEN 1 ELSE 0 END > 0
"""
