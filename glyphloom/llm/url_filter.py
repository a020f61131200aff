"""Operator 7, URL filter: rules, then a tree of path templates for each host, in DataFrame operations only.

Rules (host suffix, path prefix) give their urls a verdict; those verdicts are the labels of the method, which judges the
urls that no rule fits. A url's template is its path's segments, all of them, with what looks variable as a wildcard: digits as '#', long
tokens of hex digits as '@', segments of over LONG characters or with HYPHENS hyphens as '*'. Whether a segment looks variable is
told by itself alone, so a node's templates don't depend on how many there are. Each prefix of a template is a node of the tree.

Siblings whose labels differ no more than chance allows (a 2x2 chi-square below SAME) are merged: they share their pooled counts.
A node with labels has as its purity the blocked share of all its urls, unlabelled ones included, smoothed towards its parent's
with the weight of SMOOTH urls. A node without labels is judged as a branch: by the share of its labelled siblings that are mostly
blocked, smoothed towards the share of all labels with the weight of SMOOTH branches; without labelled siblings it has its parent's
purity. A url is blocked if its template's purity is REJECT or more.

Nulls and ties: a null url or one without '://' has an empty host and path, and no rule fits it; it is judged with all others
of that host. Of rules of equal length the one later in order of text wins. Repeated page_ids stay. Very long urls are templates like others.
An empty table gives no rows. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import removed, written

#: (verdict, host and path) as the query's contract has them.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LONG, HYPHENS, SAME, SMOOTH, REJECT = 24, 3, 3.84, 4.0, 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, prefix = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def template_of(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards; none for an empty path."""
    plain = F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "@"), "[0-9]+", "#")
    variable = lambda x: (F.length(x) > LONG) | (F.length(x) - F.length(F.translate(x, "-", "")) >= HYPHENS)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.substr(plain, F.lit(2)), "/"), lambda x: F.when(variable(x), "*").otherwise(x)))


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.array_join(template_of(F.col("path")), "/").alias("template"), F.size(template_of(F.col("path"))).alias("depth"))
    own = rows.groupBy("host", "template", "depth").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
    templates, at = written(own, "templates")
    # every prefix of a template is a node, the empty one at level 0 its host's
    part = F.split("template", "/")
    prefix = F.array_join(F.slice(part, 1, F.col("d")), "/")
    above = F.array_join(F.slice(part, 1, F.greatest(F.col("d") - 1, F.lit(0))), "/")
    levels = templates.withColumn("d", F.explode(F.sequence(F.lit(0), "depth"))).select("host", "template", "depth", "d", prefix.alias("node"), above.alias("parent"), "n", "labelled", "blocked")
    nodes = levels.groupBy("host", "d", "node", "parent").agg(*(F.sum(c).cast("double").alias(c) for c in ("n", "labelled", "blocked")))
    siblings = Window.partitionBy("host", "d", "parent")
    b, m = F.col("blocked"), F.col("labelled")
    rb, rm = F.sum("blocked").over(siblings) - b, F.sum("labelled").over(siblings) - m
    nodes = nodes.withColumn("rb", rb).withColumn("rm", rm)
    rb, rm = F.col("rb"), F.col("rm")
    cross, spread = b * (rm - rb) - rb * (m - b), m * rm * (b + rb) * ((m - b) + (rm - rb))
    same = (m > 0) & (rm > 0) & (F.when(spread > 0, (m + rm) * cross * cross / spread).otherwise(F.lit(0.0)) < SAME)
    nodes = nodes.withColumn("same", same)
    pooled = [F.when(F.col("same"), F.sum(F.when(F.col("same"), F.col(c))).over(siblings)).otherwise(F.col(c)).alias(c) for c in ("n", "labelled", "blocked")]
    branches = [F.sum(F.when(m > 0, 1.0).otherwise(0.0)).over(siblings).alias("known"), F.sum(F.when((m > 0) & (2 * b > m), 1.0).otherwise(0.0)).over(siblings).alias("bad")]
    nodes, nodes_at = written(nodes.select("host", "d", "node", *pooled, *branches), "nodes")
    everything = templates.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")).first()
    share = min(everything["blocked"] / everything["labelled"], 0.5) if everything["labelled"] else 0.0
    facts = F.struct("d", "n", "labelled", "blocked", "known", "bad")
    walk = levels.select("host", "template", "depth", "d", "node").join(nodes, ["host", "d", "node"]).groupBy("host", "template", "depth").agg(F.sort_array(F.collect_list(facts)).alias("walk"))
    judged = walk.select("host", "template", "depth", F.aggregate("walk", F.lit(float(share)), lambda p, x: purity(p, x, share)).alias("purity"))
    judged, _ = written(judged, "judged")
    removed(pages.sparkSession, at, nodes_at)
    out = rows.join(judged, ["host", "template", "depth"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def purity(above: Column, x: Column, share: float) -> Column:
    """Of a node (n, labelled, blocked; known and bad siblings), from its parent's and the share of all labels."""
    as_urls = (x["blocked"] + SMOOTH * above) / (x["n"] + SMOOTH)
    as_branch = (x["bad"] + F.lit(SMOOTH * share)) / (x["known"] + SMOOTH)
    return F.when(x["labelled"] > 0, as_urls).when(x["known"] > 0, as_branch).otherwise(above)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    """The same rules, template tree and purity in DuckDB SQL."""
    sql = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
rules(verdict, h, p, rule) AS (VALUES """
    sql += ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in RULES)
    sql += f"""),
fit AS (SELECT hp.page_id, hp.host, hp.path, r.rule, r.verdict AS ruled,
               CASE WHEN hp.path = '' THEN []::VARCHAR[] ELSE list_transform(string_split(substr(regexp_replace(regexp_replace(hp.path, '[0-9a-fA-F]{{16,}}', '@', 'g'), '[0-9]+', '#', 'g'), 2), '/'),
                    lambda x: CASE WHEN length(x) > {LONG} OR length(x) - length(replace(x, '-', '')) >= {HYPHENS} THEN '*' ELSE x END) END AS segs,
               row_number() OVER (PARTITION BY hp.page_id, hp.host, hp.path ORDER BY length(r.rule) DESC NULLS LAST, r.rule DESC) AS nth
        FROM hp LEFT JOIN rules r ON (hp.host = r.h OR ends_with(hp.host, '.' || r.h)) AND starts_with(hp.path, r.p)),
rows_ AS (SELECT * FROM fit WHERE nth = 1),
t AS (SELECT host, segs, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (WHERE ruled = 'block') AS blocked FROM rows_ GROUP BY host, segs),
g AS (SELECT CASE WHEN sum(labelled) > 0 THEN least(sum(blocked)::DOUBLE / sum(labelled)::DOUBLE, 0.5) ELSE 0.0 END AS share FROM t),
lv AS (SELECT host, segs, unnest(generate_series(0, len(segs))) AS d, n, labelled, blocked FROM t),
nd AS (SELECT host, d, segs[1:d] AS node, segs[1:greatest(d - 1, 0)] AS parent, sum(n)::DOUBLE AS n, sum(labelled)::DOUBLE AS labelled, sum(blocked)::DOUBLE AS blocked FROM lv GROUP BY ALL),
sb AS (SELECT *, blocked AS b, labelled AS m, sum(blocked) OVER w - blocked AS rb, sum(labelled) OVER w - labelled AS rm,
              sum(CASE WHEN labelled > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS known, sum(CASE WHEN labelled > 0 AND 2 * blocked > labelled THEN 1.0::DOUBLE ELSE 0 END) OVER w AS bad
       FROM nd WINDOW w AS (PARTITION BY host, d, parent)),
sm AS (SELECT *, m > 0 AND rm > 0 AND (CASE WHEN m * rm * (b + rb) * ((m - b) + (rm - rb)) > 0
              THEN (m + rm) * (b * (rm - rb) - rb * (m - b)) * (b * (rm - rb) - rb * (m - b)) / (m * rm * (b + rb) * ((m - b) + (rm - rb))) ELSE 0 END) < {SAME} AS same FROM sb),
pl AS (SELECT host, d, node, known, bad, """
    sql += ", ".join(f"CASE WHEN same THEN sum({c}) FILTER (WHERE same) OVER w ELSE {c} END AS {c}" for c in ("n", "labelled", "blocked"))
    sql += f""" FROM sm WINDOW w AS (PARTITION BY host, d, parent)),
wk AS (SELECT lv.host, lv.segs, list({{'d': lv.d, 'n': pl.n, 'm': pl.labelled, 'b': pl.blocked, 'k': pl.known, 'x': pl.bad, 'p': 0.0::DOUBLE}} ORDER BY lv.d) AS walk
       FROM lv JOIN pl ON lv.host = pl.host AND lv.d = pl.d AND lv.segs[1:lv.d] = pl.node GROUP BY lv.host, lv.segs),
pu AS (SELECT host, segs, list_reduce(walk, lambda a, x: {{'d': x.d, 'n': x.n, 'm': x.m, 'b': x.b, 'k': x.k, 'x': x.x,
              'p': CASE WHEN x.m > 0 THEN (x.b + {SMOOTH}::DOUBLE * a.p) / (x.n + {SMOOTH}::DOUBLE) WHEN x.k > 0 THEN (x.x + {SMOOTH}::DOUBLE * share) / (x.k + {SMOOTH}::DOUBLE) ELSE a.p END}},
              {{'d': -1::BIGINT, 'n': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'k': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'p': share}}).p AS p FROM wk, g)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN pu.p >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM rows_ r JOIN pu ON r.host = pu.host AND r.segs = pu.segs
"""
    return sql


ORACLE = _oracle()
