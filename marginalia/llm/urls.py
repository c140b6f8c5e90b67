"""URL filters: rules first, then trust and distrust spread over the graph of hosts.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest one decides.
Where none fits, the host decides. Its seed trust is the share of its pages that an allow rule covers, its seed
distrust the share that a block rule covers. Links between pages of different hosts make host edges, each pair once.
Trust is a personalised PageRank from the trusted seeds along the edges; distrust one from the blocked seeds along
the reversed edges (who links to bad hosts is suspect). A host is blocked when its distrust exceeds its trust
by THRESHOLD or more.

Ranks are whole numbers, in units of 1 / ONE, and shares of them are rounded down, so that sums don't depend on the
order of rows. A rank table's row is a host and a direction; each round is one join with the edges and one aggregate
with partial sums, cut by a checkpoint; a hub's edges are never gathered. DataFrame functions only.

Defined results: a null url, or one without ://, has empty host and path; no rule fits it, and the host "" is judged
like any other (it has no seeds, so it is allowed). Null html has no links. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.shared import cut, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ONE = 10**12
#: Share of a rank that comes over edges, in hundredths.
DAMPING = 85
ROUNDS = 20
#: Distrust less trust from which a host is blocked: as if half of its pages were blocked by rules.
THRESHOLD = ONE * (100 - DAMPING) // 100 // 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)


def _by_length(rules: tuple) -> list:
    return sorted(rules, key=lambda r: -len(r[0] + r[1]))


def ruled(df: DataFrame, rules: tuple = RULES) -> DataFrame:
    """df with host and path, to the same with `rule` and `ruling`; null where none fits."""
    rule = ruling = F.lit(None).cast("string")
    for host, path, verdict in reversed(_by_length(rules)):
        fits = _fits(host, path)
        rule, ruling = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return df.withColumn("rule", rule).withColumn("ruling", ruling)


def links(pages: DataFrame) -> DataFrame:
    """(host, html) to the distinct edges (src, dst) between different hosts."""
    found = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))).alias("dst"))
    return found.select(F.col("host").alias("src"), F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst and src <> ''").distinct()


def ranks(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """(host, trust, distrust) seeds in units and edges (src, dst) to the ranks of every host that has any."""
    out_of = edges.groupBy("src").agg(F.count("*").alias("n"))
    into = edges.groupBy("dst").agg(F.count("*").alias("n"))
    ways = edges.join(out_of, "src").select(F.lit("trust").alias("way"), "src", "dst", "n")
    ways = cut(ways.unionByName(edges.join(into, "dst").select(F.lit("distrust").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")))
    own = seeds.select("host", F.explode(F.array(*(F.struct(F.lit(w).alias("way"), F.col(w).alias("seed")) for w in ("trust", "distrust")))).alias("s")).select("host", "s.*").where("seed > 0")
    own = cut(own.select("way", "host", F.expr(f"seed * {100 - damping} div 100").alias("own")))
    now = own.withColumnRenamed("own", "rank")
    if not ways.isEmpty():
        for _ in range(rounds):
            sent = now.join(ways, (now["way"] == ways["way"]) & (now["host"] == ways["src"])).select(now["way"], F.col("dst").alias("host"), F.expr(f"rank * {damping} div (100 * n)").alias("rank"))
            after = cut(sent.unionByName(own.withColumnRenamed("own", "rank")).groupBy("way", "host").agg(F.sum("rank").alias("rank")))
            still = after.exceptAll(now).isEmpty()
            now = after
            if still:
                break
    return now.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("way") == "trust", F.col("rank"))), F.lit(0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("way") == "distrust", F.col("rank"))), F.lit(0)).alias("distrust"))


def judged(pages: DataFrame, rules: tuple = RULES, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, url, html) to page_id, host, path, rule, verdict, and the host's trust and distrust."""
    named = ruled(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    share = lambda verdict: F.expr(f"count_if(ruling = '{verdict}') * {ONE} div count(*)")
    seeds = cut(named.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    edges = cut(links(pages.select(host_of(F.col("url")).alias("host"), "html")))
    bad = ranks(seeds, edges, rounds)
    # hosts with ranks; the pages' side isn't gathered by host
    both = named.join(bad, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0))).withColumn("distrust", F.coalesce("distrust", F.lit(0)))
    own = F.when(F.col("distrust") - F.col("trust") >= THRESHOLD, "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), "trust", "distrust")


def op8_host_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql() -> str:
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = " ".join(f"WHEN {fit(h, p)} THEN '{h + p}'" for h, p, _ in _by_length(RULES))
    ruling = " ".join(f"WHEN {fit(h, p)} THEN '{v}'" for h, p, v in _by_length(RULES))
    link = _LINK.replace("'", "''")
    steps = []
    for k in range(ROUNDS):
        steps.append(f"""r{k + 1} AS (SELECT way, host, CAST(sum(rank) AS BIGINT) AS rank FROM (
  SELECT w.way, w.dst AS host, r.rank * {DAMPING} // (100 * w.n) AS rank FROM r{k} r JOIN ways w ON r.way = w.way AND r.host = w.src
  UNION ALL SELECT way, host, rank FROM r0) GROUP BY way, host)""")
    return rf"""
WITH named AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{_HOST}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_PATH}', 1) AS path FROM pages),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {ruling} END AS ruling FROM named),
seeds AS (SELECT host, count(*) FILTER (ruling = 'allow') * {ONE} // count(*) AS trust, count(*) FILTER (ruling = 'block') * {ONE} // count(*) AS distrust FROM ruled GROUP BY host),
edges AS (SELECT DISTINCT host AS src, translate(dst, '{_UPPER}', '{_LOWER}') AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dst FROM named) WHERE host <> '' AND host <> translate(dst, '{_UPPER}', '{_LOWER}')),
ways AS (SELECT 'trust' AS way, src, dst, count(*) OVER (PARTITION BY src) AS n FROM edges UNION ALL SELECT 'distrust', dst, src, count(*) OVER (PARTITION BY dst) FROM edges),
r0 AS (SELECT * FROM (SELECT 'trust' AS way, host, trust * {100 - DAMPING} // 100 AS rank FROM seeds WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust * {100 - DAMPING} // 100 FROM seeds WHERE distrust > 0)),
{", ".join(steps)},
bad AS (SELECT host, CAST(coalesce(sum(rank) FILTER (way = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(rank) FILTER (way = 'distrust'), 0) AS BIGINT) AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.ruling, CASE WHEN coalesce(b.distrust, 0) - coalesce(b.trust, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(b.trust, 0) AS trust, coalesce(b.distrust, 0) AS distrust
FROM ruled p LEFT JOIN bad b USING (host)"""


ORACLE_SQL = _sql()
