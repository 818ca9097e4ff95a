"""Mixing sources to target weights: hierarchical budgeting.

The tree is domain, language, source. A token budget goes down it: at each node it is split among the children by weight,
but no child gets more than its subtree holds over ``max_epochs`` passes; what it can't take goes to its siblings by weight,
so a shortage is met by siblings first and by an ancestor's siblings only when the whole subtree is short. The split has a
closed form (children sorted by capacity over weight, running sums), done here with window functions on the table of nodes in
exact integers; at most one token a child is lost to rounding. If the whole tree is short, it gives all it has.

A leaf with budget b and n tokens takes b div n full epochs and, from the next epoch's seeded order, the longest prefix
of documents whose tokens fit in the rest. Tokens are those of the tokenizer of ``token_counts``; they are counted once.
The prefix is found without sorting a leaf: the order's hash is cut into buckets of a few thousand documents by leaf size,
sums of buckets find the one where the budget ends, and only that is sorted. What results is one row a leaf, so the
documents are chosen by a join with a table as small as the list of sources, and their texts are never shuffled.

Cases: NULL language or source is the node '' of its own. NULL and blank texts are never chosen and count nothing. Rows
with the same hash (the same id, or the same text where there is no id) are chosen together or not at all. An empty table
gives an empty table. A node whose weight is 0 gets nothing, and what is below it is no capacity of the nodes above, so its
share goes to siblings. Other columns pass unchanged. Names of domains, languages and sources may hold quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._shared import fresh, small_enough, written
from millrace.llm.token_counts import counted

BUDGET_PERCENT, MAX_EPOCHS, SEED, BUCKET_ROWS, BROADCAST_LEAVES = 80, 4, 29, 8192, 500_000
DOMAINS = {
    "web": ["src0", "src1", "src2", "src3", "src4", "src5"],
    "forum": ["src6", "src7", "src8", "src9", "src10"],
    "reference": ["src11", "src12", "src13", "src14", "src15"],
}
DOMAIN_WEIGHTS = {"web": 45, "forum": 15, "reference": 30, "other": 10}
LANG_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 8, "": 2}
SOURCE_WEIGHTS = {"src0": 40, "src3": 20, "src12": 25, "": 10}


def quoted(s: str) -> str:
    """A string literal of both SQLs (Spark's also needs backslashes doubled; the other's must have none)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "''") + "'"


def case(column: str, values: dict[str, int], default: int) -> str:
    """A CASE expression over literals, valid in Spark and in the oracle's SQL."""
    arms = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in values.items() if k)
    return f"CAST(CASE {column} {arms} ELSE {default} END AS BIGINT)" if arms else f"CAST({default} AS BIGINT)"


def domain_case(column: str, domains: dict[str, list[str]]) -> str:
    return "CASE " + " ".join("WHEN " + column + " IN (" + ", ".join(map(quoted, v)) + f") THEN {quoted(k)}" for k, v in domains.items()) + " ELSE 'other' END"


def water_fill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """nodes (parent columns, key, weight, cap, budget of the parent) plus ``share``: what each node gets of the budget."""
    ratio = F.col("cap").cast("double") / F.col("weight")
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = w.orderBy(ratio, key)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = before * F.col("weight") + F.col("cap") * weights <= F.col("budget") * F.col("weight")
    nodes = nodes.filter("weight > 0").withColumn("full", full)
    nodes = nodes.withColumn("got", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(w))
    nodes = nodes.withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(w))
    return nodes.withColumn("share", F.expr("CASE WHEN full THEN cap ELSE (budget - got) * weight div open END")).drop("full", "got", "open")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: tuple[str, str, str]) -> DataFrame:
    """leaves (dom, lang, src, cap, ...) plus ``share``; weights: SQL for a node's weight at each level."""
    keys, every = ["dom", "lang", "src"], leaves
    for weight in weights:  # what can get nothing is nobody's capacity
        leaves = leaves.filter(f"{weight} > 0")
    for depth, weight in enumerate(weights):
        parent, key = keys[:depth], keys[depth]
        nodes = leaves.groupBy(*parent, key).agg(F.sum("cap").alias("cap")).withColumn("weight", F.expr(weight))
        if depth:
            nodes = nodes.join(given.select(*parent, F.col("share").alias("budget")), parent)
        else:
            nodes = nodes.crossJoin(every.agg(budget.cast("long").alias("budget")))
        given = water_fill(nodes, parent, key)
    return leaves.join(given.select(*keys, "share"), keys)


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), key))


def mix(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", budget_percent: int = BUDGET_PERCENT,
    budget_tokens: int | None = None, max_epochs: int = MAX_EPOCHS, domains: dict[str, list[str]] = DOMAINS, domain_weights: dict[str, int] = DOMAIN_WEIGHTS,
    lang_weights: dict[str, int] = LANG_WEIGHTS, source_weights: dict[str, int] = SOURCE_WEIGHTS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
    broadcast_leaves: int = BROADCAST_LEAVES, plan: bool = False, **tokenizer,
) -> DataFrame:
    """df's rows, each as often as the mixture takes it; with ``plan`` (doc_id, domain, lang, source, epoch, n_tokens) instead.
    The budget is ``budget_tokens``, or else that percentage of the tokens there are. ``tokenizer``: see ``token_counts.counted``."""
    c = lambda x: F.col(f"`{x}`")
    dom, lg, src, key, n, h = (x for x in fresh(df, "dom", "lang", "src", "key", "n", "h"))
    own = {
        src: F.coalesce(c(source).cast("string"), F.lit("")), lg: F.coalesce(c(lang).cast("string"), F.lit("")),
        key: F.coalesce(c(doc_id).cast("string"), F.md5(c(text)), F.lit("")),
    }
    docs = df.filter(c(text).rlike("\\S")).withColumns(own).withColumn(dom, F.expr(domain_case(f"`{src}`", domains)))
    slim = docs.select(F.col(dom).alias("dom"), F.col(lg).alias("lang"), F.col(src).alias("src"), F.col(key).alias("key"), c(doc_id).alias("id"), c(text).alias("n"))
    slim = written(counted(slim, **tokenizer), "mix")
    keys = ["dom", "lang", "src"]
    leaves = slim.groupBy(*keys).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).withColumn("cap", F.col("tokens") * max_epochs)
    budget = F.lit(budget_tokens) if budget_tokens is not None else F.expr(f"sum(tokens) * {budget_percent} div 100")
    weights = (case("dom", domain_weights, domain_weights.get("other", 1)), case("lang", lang_weights, lang_weights.get("", 1)), case("src", source_weights, source_weights.get("", 1)))
    leaves = leaf_budgets(leaves, F.coalesce(budget, F.lit(0)), weights)
    leaves = leaves.withColumn("epochs", F.expr("share div tokens")).withColumn("rest", F.expr("share - (share div tokens) * tokens"))
    # buckets: the first 60 bits of the hash, cut into 2^bits by the leaf's size
    leaves = leaves.withColumn("width", F.expr(f"shiftleft(1L, cast(60 - greatest(0, ceil(log2(docs / {float(bucket_rows)}))) as int))")).drop("cap", "share", "docs", "tokens")
    leaves = written(leaves.withColumn("at_most", F.col("epochs")), "leaves")
    few, count = small_enough(leaves, broadcast_leaves)
    hint = F.broadcast if few else (lambda x: x)
    part = slim.join(hint(leaves.filter("rest > 0").drop("at_most")), keys).withColumn("h", order_hash(seed, F.col("epochs"), F.col("key")))
    part = part.withColumn("b", F.expr("cast(conv(substr(h, 1, 15), 16, 10) as bigint) div width"))
    sums = part.groupBy(*keys, "b", "rest").agg(F.sum("n").alias("sum"))
    run = Window.partitionBy(*keys).orderBy("b")
    sums = sums.withColumn("before", F.sum("sum").over(run) - F.col("sum"))
    edge = sums.filter("before <= rest AND before + sum > rest").select(*keys, F.col("b").alias("cut_b"), "before")
    rows = part.join(hint(edge), keys).filter("b = cut_b").groupBy(*keys, "h", "rest", "before").agg(F.sum("n").alias("n"))
    fits = rows.withColumn("cum", F.col("before") + F.sum("n").over(Window.partitionBy(*keys).orderBy("h"))).filter("cum <= rest")
    last = fits.groupBy(*keys).agg(F.max("h").alias("last"))
    cuts = leaves.join(edge.drop("before"), keys, "left").join(last, keys, "left")
    cuts = cuts.select(
        F.col("dom").alias(dom), F.col("lang").alias(lg), F.col("src").alias(src), *(F.col(x).alias(f"{h}{x}") for x in ("epochs", "rest", "width", "cut_b", "last"))
    )
    cuts = written(cuts, "cuts")
    at = lambda x: F.col(f"{h}{x}")
    if plan:
        docs = slim.select(F.col("dom").alias(dom), F.col("lang").alias(lg), F.col("src").alias(src), F.col("key").alias(key), F.col("id").alias(f"{h}id"), F.col("n").alias(n))
    out = docs.join(hint(cuts), [dom, lg, src]).withColumn(h, order_hash(seed, at("epochs"), F.col(key)))
    b = F.expr(f"cast(conv(substr({h}, 1, 15), 16, 10) as bigint) div {h}width")
    # without an edge the whole leaf fits, which happens only when nothing is left over
    chosen = (at("rest") > 0) & ((b < at("cut_b")) | ((b == at("cut_b")) & (F.col(h) <= at("last"))))
    times = at("epochs").cast("int") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    out = out.withColumn(h, times).filter(F.col(h) > 0).withColumn(h, F.explode(F.sequence(F.lit(0), F.col(h) - 1)))
    if not plan:
        return out.select(*(c(x) for x in df.columns))
    return out.select(F.col(f"{h}id").alias("doc_id"), F.col(dom).alias("domain"), F.col(lg).alias("lang"), F.col(src).alias("source"), F.col(h).cast("long").alias("epoch"), F.col(n).alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: one row for each time a document is taken."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), plan=True)
