"""Operator 3, mixing sources to target weights by hierarchical budgets.

Leaves are (domain, lang, source). A budget of tokens goes from the root to domains, languages and sources by their
weights: target weights that a caller gives for nodes of any level, and default ones (a function of the node's tokens) for the others, scaled so
that the given weights are shares of their parent's budget. What a node can hold is max_epochs times its tokens. A child whose share exceeds what it can hold is filled, and the
rest goes to its siblings in proportion to their weights, so a shortage reaches a node's ancestors' other children only when
all its siblings are full. Sorted by capacity over weight, the filled children are a prefix, which two running sums tell: no
iteration, and windows over leaves only.

In each leaf, whole epochs repeat every document; of the last one, in the order of md5(seed:epoch:doc_id), documents are taken as
long as their running sum of tokens stays within the rest. Sums over BUCKETS prefixes of that hash find the bucket in which the
prefix ends, so that only this bucket's documents are ever ordered.

Tokens are words [^\\x20\\x09-\\x0D]+. Nulls and ties: a null lang or source is a leaf of its own, '-'; a null text has no tokens;
a null doc_id hashes as an empty one. Equal rows come or go together. A document without tokens stays as often as its leaf's whole epochs
and prefix say. An empty table gives no rows. Other columns pass through unchanged; domain, n_tokens and copies are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, documents, written

SEED, MAX_EPOCHS, SHARE, BUCKETS = 17, 2, 1.0, 3  # BUCKETS: hex digits
LEAF = ("domain", "__lang", "__source")


def domain_of(source: Column) -> Column:
    """The default domain of a source: one of two halves of the sources, by a hash."""
    return F.when(F.substring(F.md5(F.coalesce(source, F.lit("-"))), 1, 1) < "8", "a").otherwise("b")


def weight_of(tokens: Column) -> Column:
    """The default weight of a node: its tokens to the power of 3/4, so that small nodes gain."""
    return F.greatest(F.floor(F.sqrt(tokens) * F.sqrt(F.sqrt(tokens))), F.lit(1)).cast("long")


def filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent, name, w, capacity, of_parent) with budget: the parent's budget by weight, none over its capacity."""
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = whole.orderBy((F.col("capacity") / F.col("w")).asc(), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("of_parent") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    weight = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    nodes = nodes.withColumn("level", rest / weight).withColumn("place", F.row_number().over(order))
    nodes = nodes.withColumn("full", F.col("capacity") / F.col("w") <= F.col("level"))
    nodes = nodes.withColumn("n_full", F.sum(F.col("full").cast("int")).over(whole))
    level = F.max(F.when(F.col("place") == F.col("n_full") + 1, F.col("level"))).over(whole)
    return nodes.withColumn("common", level).withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.col("common") * F.col("w")).cast("long"))).drop("level", "place", "full", "n_full", "common", "of_parent")


#: Units of a parent's budget in which given weights are counted.
PARTS = 1_000_000


def targeted(nodes: DataFrame, parent: list[str], name: str, targets: dict[tuple, float]) -> DataFrame:
    """nodes (parent, name, w, ...) with w from targets where they name the node, by (domain, lang, source) as far as its level; others share what is left by their w.

    Given weights are shares of the parent's budget; they must be positive, and those of one parent 1 at most. Where no node is left for the
    rest, or nothing is left for the others, the budget goes by the given weights alone (a weight of one part for the others).
    """
    depth = len(parent) + 1
    own = {k: v for k, v in targets.items() if len(k) == depth}
    if any(v <= 0 for v in own.values()):
        raise ValueError("target weights must be positive")
    for k in own:
        if sum(v for x, v in own.items() if x[:-1] == k[:-1]) > 1 + 1e-9:
            raise ValueError(f"target weights below {k[:-1]} are over 1")
    if not own:
        return nodes
    table = nodes.sparkSession.createDataFrame([(*("-" if x is None else x for x in k), int(round(v * PARTS))) for k, v in own.items()], ", ".join(f"`{c}` string" for c in LEAF[:depth]) + ", target long")
    joined = nodes.join(F.broadcast(table), list(LEAF[:depth]), "left")  # as many rows as the caller gave
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    given = F.coalesce(F.sum("target").over(whole), F.lit(0))
    others = F.sum(F.when(F.col("target").isNull(), F.col("w"))).over(whole)
    joined = joined.withColumn("given", given).withColumn("others", others)
    rest = F.greatest(F.floor(F.greatest(F.lit(PARTS) - F.col("given"), F.lit(0)) * (F.col("w") / F.col("others"))), F.lit(1)).cast("long")
    return joined.withColumn("w", F.when(F.col("given") == 0, F.col("w")).otherwise(F.coalesce("target", rest))).drop("target", "given", "others")


def mixed(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain=domain_of, weight=weight_of, targets: dict[tuple, float] | None = None) -> DataFrame:
    """docs that the mix takes, with domain, n_tokens and copies (how often). share: the budget over all tokens.

    targets: shares of the parent's budget by (domain,), (domain, lang) or (domain, lang, source), None for a null lang or source.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*own, domain(F.col("source")).alias("domain"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), F.coalesce("lang", F.lit("-")).alias("__lang"), F.coalesce("source", F.lit("-")).alias("__source"))
    slim, _ = written(rows.select(*LEAF, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "n_tokens"), "mix")
    leaves = slim.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    sums = {d: Window.partitionBy(*LEAF[: d + 1]) for d in range(3)}
    for d in range(3):
        leaves = leaves.withColumn(f"t{d}", F.sum("tokens").over(sums[d]))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    above: DataFrame | None = None
    for d, name in enumerate(LEAF):
        parent = list(LEAF[:d])
        nodes = leaves.groupBy(*parent, name).agg(F.max(f"t{d}").alias("t")).withColumn("w", weight(F.col("t"))).withColumn("capacity", F.col("t") * max_epochs).drop("t")
        nodes = targeted(nodes, parent, name, targets) if targets else nodes
        nodes = nodes.withColumn("of_parent", F.lit(int(share * total)).cast("long")) if above is None else nodes.join(above.select(*parent, F.col("budget").alias("of_parent")), parent)
        above = filled(nodes, parent, name)
    leaves = leaves.select(*LEAF, "tokens").join(above.select(*LEAF, "budget"), list(LEAF))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long")
    leaves, _ = written(leaves.select(*LEAF, epochs.alias("epochs"), F.when(F.col("tokens") > 0, F.col("budget") - epochs * F.col("tokens")).otherwise(0).alias("rest")), "leaves")
    small = F.broadcast(leaves) if leaves.count() * 200 <= BROADCAST_BYTES else leaves
    hashed = slim.join(small, list(LEAF)).withColumn("hash", F.md5(F.concat_ws(":", F.lit(seed), "epochs", "id"))).withColumn("bucket", F.substring("hash", 1, BUCKETS))
    buckets = hashed.groupBy(*LEAF, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = buckets.withColumn("until", running).where("until > rest and until - n <= rest").select(*LEAF, "bucket", (F.col("until") - F.col("n")).alias("before"))
    ends, _ = written(ends.groupBy(*LEAF).agg(F.min(F.struct("bucket", "before")).alias("e")).select(*LEAF, F.col("e.bucket").alias("last"), F.col("e.before").alias("before")), "ends")
    small_ends = F.broadcast(ends) if ends.count() * 200 <= BROADCAST_BYTES else ends
    edge = hashed.join(small_ends, list(LEAF)).where("bucket = last")
    edge = edge.withColumn("sum", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("hash"))).where("sum <= rest")
    cut = edge.groupBy(*LEAF).agg(F.max("hash").alias("top"))
    plan = leaves.join(ends, list(LEAF), "left").join(cut, list(LEAF), "left").select(*LEAF, F.col("epochs").alias("__epochs"), F.coalesce("top", "last").alias("__cutoff"))
    plan, _ = written(plan, "plan")
    plan = F.broadcast(plan) if plan.count() * 200 <= BROADCAST_BYTES else plan
    taken = F.md5(F.concat_ws(":", F.lit(seed), "__epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) <= F.col("__cutoff")
    out = rows.join(plan, list(LEAF)).withColumn("copies", F.col("__epochs") + F.coalesce(taken, F.lit(False)).cast("long"))
    return out.where("copies > 0").select(*own, "domain", "n_tokens", "copies")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _oracle() -> str:
    sql = r"""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN substr(md5(coalesce(source, '-')), 1, 1) < '8' THEN 'a' ELSE 'b' END AS domain,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
                  coalesce(lang, '-') AS __lang, coalesce(source, '-') AS __source FROM documents),
l AS (SELECT domain, __lang, __source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL)"""
    above = ""
    for k, name in enumerate(LEAF):
        parent = list(LEAF[:k])
        keys = ", ".join([*parent, name])
        over = f"PARTITION BY {', '.join(parent)}" if parent else ""
        budget = f"(SELECT floor({SHARE} * sum(tokens))::BIGINT FROM l)" if not parent else "of_parent"
        source = f"(SELECT {keys}, sum(tokens)::BIGINT AS t FROM l GROUP BY {keys})"
        source += f" JOIN (SELECT {', '.join(parent)}, budget AS of_parent FROM {above}) USING ({', '.join(parent)})" if parent else ""
        sql += f""",
n{k} AS (SELECT {keys}, {budget} AS of_parent, greatest(floor(sqrt(t::DOUBLE) * sqrt(sqrt(t::DOUBLE))), 1)::BIGINT AS w, t * {MAX_EPOCHS} AS capacity FROM {source}),
o{k} AS (SELECT *, row_number() OVER o AS place, (of_parent - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(w) OVER p - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
        FROM n{k} WINDOW p AS ({over}), o AS ({over} ORDER BY capacity::DOUBLE / w::DOUBLE, {name})),
f{k} AS (SELECT *, capacity::DOUBLE / w::DOUBLE <= level AS filled FROM o{k}),
c{k} AS (SELECT *, count(*) FILTER (WHERE filled) OVER ({over}) AS n_full FROM f{k}),
b{k} AS (SELECT {keys}, CASE WHEN filled THEN capacity ELSE floor(max(CASE WHEN place = n_full + 1 THEN level END) OVER ({over}) * w)::BIGINT END AS budget FROM c{k})"""
        above = f"b{k}"
    leaf = ", ".join(LEAF)
    sql += f""",
e AS (SELECT {leaf}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget - (budget // tokens) * tokens ELSE 0 END AS rest FROM l JOIN b2 USING ({leaf})),
h AS (SELECT d.*, e.epochs, e.rest, md5('{SEED}:' || e.epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS hash FROM d JOIN e USING ({leaf})),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY hash) AS until FROM h)
SELECT doc_id, domain, lang, source, n_tokens, epochs + (until <= rest)::BIGINT AS copies FROM s WHERE epochs + (until <= rest)::BIGINT > 0
"""
    return sql


ORACLE = _oracle()
