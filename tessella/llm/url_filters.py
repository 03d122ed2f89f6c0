"""Operator 7: url verdicts by rules, and by trust over the host graph where no rule fits.

Edges run from the host of a page to the hosts of the absolute links in its html; links within a host say nothing about it and
are left out. Trust starts at hosts whose pages the rules mostly allow and follows the links; distrust starts at hosts whose pages
the rules mostly block and follows the links backwards (who links to a blocked host loses trust). Both are personalised PageRank
vectors with one unit a seed. Distrust is divided among all who link to a blocked host, so it sinks with their number. Exposure is not:
it goes from linked to linking host by the part of the links of the linking one, and is the mass on blocked hosts of a PageRank
personalised to the host. With a single linker a blocked host both are the same. A page that no rule fits is blocked if the distrust or
the exposure of its host reaches THRESHOLD and exceeds its trust.

Seeds are hosts of pages and hosts that are only linked to. Of a host with pages the rules' verdicts on its pages decide; of one without
any, those on the urls that other hosts link to, link by link. A link without a path goes to the path ``/``.

Everything here is DataFrame functions. Pages are aggregated to hosts and host pairs before any join, so a host that holds a third of
the pages is one row in the graph.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no links;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, UPPER, Scratch, lower_ascii, pick, small_enough

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
STEPS = 20
TOLERANCE = 1e-6
THRESHOLD = 0.05
#: Part of a host's pages (of the links to it, if it has no pages) that the rules must allow (block) to make it a trusted (blocked) seed: more than this.
SEED_SHARE = 0.5


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null where none does. Of equally long rules the first wins."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick_by = lambda value: reduce(lambda rest, r: F.when(_fits(host, path, r), F.lit(value(r))).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))
    return pick_by(lambda r: r[1] + r[2]), pick_by(lambda r: r[0])


def host_edges(pages: DataFrame, rules=RULES) -> DataFrame:
    """(src, dst, links, allowed, blocked) between different hosts, from absolute and scheme-relative links, and how many of the links
    the rules allow and block. pages: host, html."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), 1)
    links = pages.where("host != ''").select("host", F.explode(found).alias("link"))
    url = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    ends = links.select(F.col("host").alias("src"), host_of(url).alias("dst"), path_of(url).alias("path")).where("dst != '' and src != dst")
    _, verdict = longest_rule(F.col("dst"), F.when(F.col("path") == "", "/").otherwise(F.col("path")), rules)
    times = lambda v: F.count(F.when(F.col("verdict") == v, 1)).cast("double")
    return ends.withColumn("verdict", verdict).groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"), times("allow").alias("allowed"), times("block").alias("blocked"))


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, name: str, by: str = "src") -> DataFrame:
    """Personalised PageRank (host, mass) of seeds (host, seed) over edges (src, dst, links), until it moves by TOLERANCE a seed at most.

    With by="dst" a link counts by its part of the links into dst: the mass is not divided among those it goes to.
    """
    out = edges.groupBy(by).agg(F.sum("links").alias("total"))
    shares = scratch.table(edges.join(out, by).select("src", "dst", (F.col("links") / F.col("total")).alias("share")), f"{name}-shares")
    start = seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("base"))
    mass = scratch.table(start.withColumnRenamed("base", "mass"), f"{name}-0")
    if shares.isEmpty():
        return mass
    for step in range(1, STEPS + 1):
        sent = mass.withColumnRenamed("host", "src").join(shares, "src").groupBy("dst").agg(F.sum(F.col("mass") * F.col("share")).alias("got"))
        moved = start.join(sent.withColumnRenamed("dst", "host"), "host", "full").select("host", (F.coalesce("base", F.lit(0.0)) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("mass"))
        after = scratch.table(moved, f"{name}-{step}")
        delta = after.join(mass.withColumnRenamed("mass", "old"), "host", "left").agg(F.sum(F.abs(F.col("mass") - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        scratch.drop(f"{name}-{step - 1}")
        mass = after
        if delta <= TOLERANCE:
            break
    return mass


def host_trust(pages: DataFrame, scratch: Scratch, rules=RULES) -> DataFrame:
    """(host, trust, distrust, exposure) of all hosts that are seeds or that a link path joins to one. pages: host, verdict, html."""
    share = lambda v: (F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0)) > SEED_SHARE).cast("double")
    crawled = scratch.table(pages.where("host != ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "crawled")
    edges = scratch.table(host_edges(pages, rules), "edges")
    part = lambda n: (F.sum(n) / F.sum("links") > SEED_SHARE).cast("double")
    linked = edges.groupBy(F.col("dst").alias("host")).agg(part("allowed").alias("good"), part("blocked").alias("bad")).where("good > 0 or bad > 0")
    seeds = scratch.table(crawled.unionByName(linked.join(crawled, "host", "left_anti")), "seeds")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = propagate(seeds.where("good > 0").select("host", F.col("good").alias("seed")), edges, scratch, "trust")
    bad = seeds.where("bad > 0").select("host", F.col("bad").alias("seed"))
    masses = {"trust": trust, "distrust": propagate(bad, back, scratch, "distrust"), "exposure": propagate(bad, back, scratch, "exposure", by="dst")}
    every = reduce(lambda a, b: a.join(b, "host", "full"), (m.withColumnRenamed("mass", name) for name, m in masses.items()))
    return scratch.table(every.select("host", *(F.coalesce(name, F.lit(0.0)).alias(name) for name in masses)), "hosts")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust and exposure of the host."""
    scratch = Scratch(pages.sparkSession)
    parsed = pick(pages, "page_id", "url", "html").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "verdict": verdict})
    hosts = host_trust(ruled, scratch, rules)
    scratch.drop_all_but("hosts")
    risk = F.coalesce(F.greatest("distrust", "exposure"), F.lit(0.0))
    bad = (risk >= threshold) & (risk > F.coalesce("trust", F.lit(0.0)))
    return (
        ruled.drop("html")
        .join(small_enough(hosts), "host", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust", "exposure")
    )


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def oracle(steps: int = STEPS) -> str:
    """The same in SQL, the steps written out; it always takes all steps, which moves a mass by TOLERANCE at most."""
    def spread(name: str, seed: str, edges: str, by: str = "src") -> str:
        out = f"{name}_s AS (SELECT src, dst, links / sum(links) OVER (PARTITION BY {by}) AS share FROM {edges}), {name}_b AS (SELECT host, {1 - DAMPING!r}::DOUBLE AS base FROM seeds WHERE {seed}), {name}_0 AS (SELECT host, base AS mass FROM {name}_b)"
        for k in range(1, steps + 1):
            out += f""", {name}_{k} AS (SELECT host, sum(mass) AS mass FROM (SELECT host, base AS mass FROM {name}_b UNION ALL SELECT s.dst, {DAMPING}::DOUBLE * m.mass * s.share FROM {name}_{k - 1} m JOIN {name}_s s ON m.host = s.src) GROUP BY host)"""
        return out

    fits = lambda r: f"((host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in ordered) + " END"
    host = lambda url: f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = lambda url: f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    share = lambda v: f"avg(CASE WHEN verdict = '{v}' THEN 1.0 ELSE 0.0 END) > {SEED_SHARE}"
    part = lambda v: f"sum(CASE WHEN verdict = '{v}' THEN 1.0 ELSE 0.0 END) / count(*) > {SEED_SHARE}"
    return f"""
WITH p AS (SELECT page_id, {host("coalesce(url, '')")} AS host, {path("coalesce(url, '')")} AS path, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS verdict FROM p),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS link FROM r WHERE host != ''),
u AS (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS url FROM l),
m AS (SELECT src, {host("url")} AS host, CASE WHEN {path("url")} = '' THEN '/' ELSE {path("url")} END AS path FROM u),
n AS (SELECT *, {case(lambda r: r[0])} AS verdict FROM m WHERE host != '' AND src != host),
edges AS (SELECT src, host AS dst, count(*)::DOUBLE AS links FROM n GROUP BY src, host),
back AS (SELECT dst AS src, src AS dst, links FROM edges),
crawled AS (SELECT host, {share("allow")} AS good, {share("block")} AS bad FROM r WHERE host != '' GROUP BY host),
seeds AS (SELECT * FROM crawled UNION ALL SELECT host, {part("allow")} AS good, {part("block")} AS bad FROM n WHERE host NOT IN (SELECT host FROM crawled) GROUP BY host),
{spread("t", "good", "edges")}, {spread("b", "bad", "back")}, {spread("e", "bad", "back", "dst")}
SELECT r.page_id, r.host, r.path, r.rule,
  coalesce(r.verdict, CASE WHEN greatest(coalesce(b.mass, 0), coalesce(e.mass, 0)) >= {THRESHOLD} AND greatest(coalesce(b.mass, 0), coalesce(e.mass, 0)) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN t_{steps} t ON r.host = t.host LEFT JOIN b_{steps} b ON r.host = b.host LEFT JOIN e_{steps} e ON r.host = e.host
"""


ORACLE = oracle()
