"""URL filters: rules by host and path, and trust propagated over the graph of hosts where no rule fits.

Trust is a personalised PageRank that restarts at hosts whose pages rules allow; distrust is one over the reversed
edges, restarting at hosts whose pages rules block (a host that links to blocked hosts is suspect). A threshold on
both judges the host.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import BROADCAST_ROWS, durable, sized, stored, table

#: Host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Share of a score that goes on along edges; rounds, where they are fixed; a host is blocked if its distrust is above so many times its trust.
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 1.0
#: Scores have converged when a round changes them by less than this, summed over all hosts and both scores.
TOLERANCE = 1e-9
#: Pages of one host that may meet in one task, about, where its scores are too many to broadcast.
HOT_PAGES = 100_000
#: Edges for each task of a round, about.
TASK_EDGES = 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return _folded(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _folded(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits. A rule fits its host and all subdomains."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def host_edges(pages: DataFrame, url: str = "url", html: str = "html", family: int | None = None) -> DataFrame:
    """(src, dst, w): links between different hosts, counted.

    With ``family``, a host of so many labels and its parent (m.site.example.org and site.example.org) count as linked both
    ways, too. Both ends of a link are folded alike.
    """
    target = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(target), F.lit(1))
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(found).alias("dst")).withColumn("dst", _folded(F.col("dst")))
    edges = links if family is None else links.unionByName(_family(pages, url, family))
    return edges.where("src != dst AND src != '' AND dst != ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def _family(pages: DataFrame, url: str, family: int) -> DataFrame:
    hosts = pages.select(host_of(F.col(url)).alias("src")).distinct()
    child = hosts.where(F.size(F.split("src", "[.]")) >= family).select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst"))
    return child.unionByName(child.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) over edges (src, dst, w), by power iteration.

    Weights are divided by the sum of a host's outgoing (trust) or incoming (distrust) weights. What reaches a host
    without further edges stays there for that round only. Partial sums are formed before every shuffle. Without
    ``rounds`` it goes on until the summed change is below ``tolerance``; each round's change is damped, so that takes
    some 130 rounds for a seed mass of 1 and some 210 for a million. Only the sum of the changes reaches the driver.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("o"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("i"))
    share = durable(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("w") / F.col("o")).alias("f"), (F.col("w") / F.col("i")).alias("r")))
    seeds = durable(seeds.select("host", "trust", "distrust"))
    parts = math.ceil((share.count() + seeds.count()) / TASK_EDGES) or 1
    state = seeds
    keep = [(1 - damping) * F.col(c) for c in ("trust", "distrust")]
    zero = F.lit(0.0)
    names = ("trust", "distrust", "was_trust", "was_distrust")
    done = 0
    while rounds is None or done < rounds:
        on = share.join(state.withColumnRenamed("host", "src").where("trust > 0"), "src").select(F.col("dst").alias("host"), (damping * F.col("trust") * F.col("f")).alias("trust"), zero.alias("distrust"))
        back = share.join(state.withColumnRenamed("host", "dst").where("distrust > 0"), "dst").select(F.col("src").alias("host"), zero.alias("trust"), (damping * F.col("distrust") * F.col("r")).alias("distrust"))
        again = seeds.select("host", keep[0].alias("trust"), keep[1].alias("distrust"))
        new = again.unionByName(on).unionByName(back).select("*", zero.alias("was_trust"), zero.alias("was_distrust"))
        old = state.select("host", zero.alias("trust"), zero.alias("distrust"), F.col("trust").alias("was_trust"), F.col("distrust").alias("was_distrust"))
        both = stored(new.unionByName(old).groupBy("host").agg(*[F.sum(c).alias(c) for c in names]).coalesce(parts))
        state = both.select("host", "trust", "distrust")
        done += 1
        if rounds is None and (both.agg(F.sum(F.abs(F.col("trust") - F.col("was_trust")) + F.abs(F.col("distrust") - F.col("was_distrust")))).first()[0] or 0.0) < tolerance:
            break
    return state


def _with_scores(base: DataFrame, scores: DataFrame) -> DataFrame:
    """``base`` with the scores of its hosts: broadcast if they are few; else hot hosts go in parts, a row of scores to each."""
    if scores.count() <= BROADCAST_ROWS:
        return base.join(F.broadcast(scores), "host", "left")
    counts = base.groupBy("host").agg(F.count("*").alias("n"))
    parts = counts.where(F.col("n") > HOT_PAGES).select("host", F.ceil(F.col("n") / HOT_PAGES).cast("int").alias("parts"))
    hot = sized(durable(parts))
    part = F.coalesce("parts", F.lit(1))
    dealt = base.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("path", *[c for c in base.columns if c.startswith("__keep")]), part).cast("int")).drop("parts")
    spread = scores.join(hot, "host", "left").select("host", "trust", "distrust", F.explode(F.sequence(F.lit(0), part - 1)).alias("part"))
    return dealt.join(spread, ["host", "part"], "left").drop("part")


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",), rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Kept columns with host, path, rule, verdict, trust and distrust (of the host, converged unless ``rounds`` is set).

    Null URLs, and those without ``://``, have an empty host and path, no rule, no trust and the verdict allow, as
    have all hosts that neither seeds nor edges reach. A seed's strength is the share of its pages with a rule that
    rules allow (block). Ties between trust and distrust are allowed. Repeated rows count as pages of their own and
    each has a row; very long pages are searched whole, in linear time; an empty table gives an empty result. A kept
    column that is called like a result gives way to it, others may have any name. Only a link in the HTML is an edge. A
    host with very many pages is dealt out in parts, each with a row of its scores.
    """
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "verdict", "trust", "distrust"))
    own = [f"__keep{i}" for i in range(len(keep))]
    base = pages.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)], F.col(f"`{url}`").alias("__url"))
    base = base.select(*own, host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), by_rule.alias("__by_rule"))
    of = lambda v: F.avg(F.when(F.col("__by_rule") == v, 1.0).otherwise(0.0))
    seeds = base.where("rule IS NOT NULL AND host != ''").groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    edges = durable(host_edges(pages.select(F.col(url).alias("url"), F.col(html).alias("html"))))
    scores = propagate(edges, seeds, rounds=rounds)
    found = _with_scores(base, scores)
    suspect = F.coalesce(F.col("distrust"), F.lit(0.0)) > threshold * F.coalesce(F.col("trust"), F.lit(0.0))
    verdict = F.coalesce("__by_rule", F.when(suspect, "block").otherwise("allow"))
    return found.select(*[F.col(o).alias(c) for c, o in zip(keep, own)], "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages``, judged; the host's scores are given to six decimals."""
    found = judge(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def _sql(rounds: int = 250) -> str:
    """The same with a fixed number of rounds, which is enough for scores of up to a million hosts to converge."""
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in order]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"
    fold = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = r"""(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)"""
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, {fold("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, {case([h + q for h, q, _ in order])} AS rule, {case([v for *_, v in order])} AS by_rule FROM p),
seeds AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0.0 END) AS d FROM r WHERE rule IS NOT NULL AND host <> '' GROUP BY host),
links AS (SELECT host AS src, {fold("x")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS x FROM p)),
edges AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
share AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS f, w / sum(w) OVER (PARTITION BY dst) AS b FROM edges),
pr(k, host, t, d) AS (
  SELECT 0, host, t, d FROM seeds
  UNION ALL SELECT k + 1, host, sum(t), sum(d) FROM (
    SELECT k, seeds.host, {1 - DAMPING!r} * seeds.t AS t, {1 - DAMPING!r} * seeds.d AS d FROM seeds, (SELECT DISTINCT k FROM pr)
    UNION ALL SELECT k, dst, {DAMPING} * t * f, 0.0 FROM pr JOIN share ON src = host
    UNION ALL SELECT k, src, 0.0, {DAMPING} * d * b FROM pr JOIN share ON dst = host)
  WHERE k < {rounds} GROUP BY k, host),
s AS (SELECT host, t, d FROM pr WHERE k = {rounds})
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN coalesce(d, 0) > {THRESHOLD} * coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(t, 0.0), 6) AS trust, round(coalesce(d, 0.0), 6) AS distrust
FROM r LEFT JOIN s USING (host)
"""


OP8_SQL = _sql()
