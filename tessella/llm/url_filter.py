"""URL verdicts: a rule list first, then link-graph propagation between hosts.

Trust spreads along links from hosts that rules allow; distrust spreads against
them, from hosts that rules block to those that link to them. Both walks start
from the same kind of seed: the share of a host's pages that rules allow, or
block. A host gets the trusted share of the links to it and the distrusted share
of its own links, damped at each step (personalised PageRank read from the host
that receives), and never less than its seed: scores stay between 0 and 1,
however many hosts share a neighbour or pass on what they have. A host whose
distrust exceeds its trust by ``threshold`` is blocked where no rule fits.
DataFrame operations only.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, drop
from . import _carry

# The rules of the registered query (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

DAMPING, THRESHOLD, TOLERANCE, ROUNDS = 0.85, 0.5, 1e-4, 60
#: Rules are policy text, held in the plan as one table of constants; they don't grow with the data.
MOST_RULES = 50_000
#: Blocked hosts up to this number are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits (as text) and its verdict; nulls where none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of two rules of one length the one that blocks wins, then the smaller text. The rules are
    dealt into slots by a checksum of their host, and each suffix of a host looks in one slot, so a page's work does not
    depend on their number.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    slots: list[list[dict]] = [[] for _ in range(2 * len(rules) + 1)]
    for place, (h, p, v) in enumerate(ranked):
        slots[zlib.crc32(h.encode()) % len(slots)].append({"place": place, "host": h, "path": p, "verdict": v})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<place:int,host:string,path:string,verdict:string>>>")
    labels = F.split(host_col, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = lambda s: F.filter(F.get(table, (F.crc32(s) % len(slots)).cast("int")), lambda r: (r["host"] == s) & F.startswith(path_col, r["path"]))
    best = F.array_min(F.flatten(F.transform(suffixes, fits)))
    return F.concat(best["host"], best["path"]), best["verdict"]


def linked_hosts(html: Column) -> Column:
    """Hosts of the absolute links of anchors, as often as they occur; a relative link stays on its host and is none."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    hosts = F.transform(found, lambda x: host(F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x)))
    return F.when(html.contains("//"), hosts).otherwise(F.array().cast("array<string>"))


def host_edges(pages: DataFrame, *, links_col: str = "links", host_col: str = "host") -> DataFrame:
    """Links between different hosts: ``src``, ``dst`` and ``links``, one row for each pair; counted in each task before they are shuffled."""
    rows = pages.select(F.col(host_col).alias("src"), F.explode(links_col).alias("dst"))
    return rows.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS, shares: bool = False) -> DataFrame:
    """Trust and distrust of every host of ``edges`` (src, dst, links) and ``seeds`` (host, trust, distrust).

    Each round a host keeps ``1 - damping`` of its seed and receives ``damping``
    of what its neighbours send: trust is sent along links in proportion to their
    number, distrust against them. A host that can send nowhere keeps what it has.

    With ``shares`` a host receives the mean of its neighbours' scores, weighted by
    links, in place of parts of their mass, and has its seed or ``damping`` of that mean,
    whichever is larger. A round moves no score by more than ``damping`` times the
    largest move before, so the defaults reach ``tolerance`` within ``rounds``.

    Rounds end when no score moves by ``tolerance`` or more, however many hosts there
    are, or after ``rounds``. Each is written to the shared folder; a heavily linked host is summed up in every task first.
    """
    hosts = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    kinds = F.array(F.lit("trust"), F.lit("distrust"))
    nodes = hosts.join(seeds, "host", "left").select(F.explode(kinds).alias("kind"), "host", "trust", "distrust")
    nodes = cut(nodes.select("kind", "host", F.coalesce(F.when(F.col("kind") == "trust", F.col("trust")).otherwise(F.col("distrust")), F.lit(0.0)).alias("seed")), "urls-nodes")
    sent = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links").union(edges.select(F.lit("distrust"), "dst", "src", "links"))
    end = "to" if shares else "host"
    total = sent.groupBy("kind", end).agg(F.sum("links").alias("total"))
    moves = sent.join(total, ["kind", end]).select("kind", "host", "to", (F.col("links") / F.col("total")).alias("share"))
    if not shares:
        moves = moves.union(nodes.join(total, ["kind", "host"], "left_anti").select("kind", "host", F.col("host").alias("to"), F.lit(1.0).alias("share")))
    moves = cut(moves, "urls-moves")
    scores = nodes.select("kind", "host", F.col("seed").alias("score"))
    for _ in range(rounds):
        got = moves.join(scores, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        now = nodes.join(got, ["kind", "host"], "left").join(scores.withColumnRenamed("score", "before"), ["kind", "host"])
        got = damping * F.coalesce("got", F.lit(0.0))
        value = F.round(F.greatest("seed", got) if shares else (1 - damping) * F.col("seed") + got, 12)
        after = cut(now.select("kind", "host", value.alias("score"), F.abs(value - F.col("before")).alias("moved")), "urls-scores")
        moved = after.agg(F.max("moved")).first()[0] or 0.0
        drop(scores)
        scores = after
        if moved < tolerance:
            break
        kept = after
        scores = kept.select("kind", "host", "score")
        scores._tessella_path = kept._tessella_path
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score"))).alias(kind)
    drop(nodes)
    drop(moves)
    found = scores.groupBy("host").agg(of("trust"), of("distrust"))
    found._tessella_path = getattr(scores, "_tessella_path", None)
    return found


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """Verdict on every page: ``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and the host's ``blocked_host``.

    One row for each row of ``pages``; other columns are not read. A null url, or one
    without ``://``, has an empty host and path, fits no rule and is allowed. A null
    html has no links. Repeated pages count as often as they occur. No rows give no rows.
    """
    name, verdict = match(F.col("host"), F.col("path"), rules)
    url, html = _carry.column(url_col), _carry.column(html_col)
    read = pages.select(_carry.column(id_col).alias("_id"), host(url).alias("host"), path(url).alias("path"), linked_hosts(html).alias("links"))
    judged = cut(read.select("_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "links"), "urls-judged")  # the only reading of the pages
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    seeds = cut(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "urls-seeds")
    edges = cut(host_edges(judged), "urls-edges")
    scores = propagate(edges, seeds, shares=True)
    blocked = cut(scores.where(F.col("distrust") - F.col("trust") >= threshold).select("host", F.lit(True).alias("blocked_host")), "urls-blocked")
    drop(seeds)
    drop(edges)
    drop(scores)
    if blocked.count() <= BROADCAST_HOSTS:
        blocked = F.broadcast(blocked)
    result = judged.drop("links").join(blocked, "host", "left").withColumn("blocked_host", F.coalesce("blocked_host", F.lit(False)))
    by_method = F.when(F.col("blocked_host"), "block").otherwise("allow")
    return result.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), "blocked_host")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    host_of = lambda x: rf"translate(regexp_extract({x}, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    return rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {rules}),
pg AS (
  SELECT page_id, html, CASE WHEN sep > 0 THEN {host_of("url")} ELSE '' END AS host,
         CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT *, coalesce(strpos(url, '://'), 0) AS sep FROM pages)),
hp AS (SELECT DISTINCT host, path FROM pg),
fit AS (
  SELECT host, path, arg_min(h || p, (-length(h || p), v <> 'block', h || p)) AS rule, arg_min(v, (-length(h || p), v <> 'block', h || p)) AS verdict
  FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
judged AS (SELECT pg.page_id, pg.host, pg.path, pg.html, fit.rule, fit.verdict FROM pg LEFT JOIN fit ON pg.host = fit.host AND pg.path = fit.path),
seed AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS distrust
  FROM judged WHERE host <> '' GROUP BY host),
link AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS url FROM judged WHERE html LIKE '%//%'),
edge AS (
  SELECT src, dst, count(*) AS links FROM (SELECT src, {host_of("CASE WHEN starts_with(url, '//') THEN 'x:' || url ELSE url END")} AS dst FROM link)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
node AS (
  SELECT k.kind, x.host, coalesce(CASE WHEN k.kind = 'trust' THEN seed.trust ELSE seed.distrust END, 0) AS seed
  FROM (SELECT host FROM seed UNION SELECT src FROM edge UNION SELECT dst FROM edge) x(host) CROSS JOIN (VALUES ('trust'), ('distrust')) k(kind) LEFT JOIN seed ON seed.host = x.host),
sent AS (SELECT 'trust' AS kind, src AS host, dst AS to_, links FROM edge UNION ALL SELECT 'distrust', dst, src, links FROM edge),
move AS (SELECT kind, host, to_, links / sum(links) OVER (PARTITION BY kind, to_) AS share FROM sent),
walk(round, kind, host, score) AS (
  SELECT 0, kind, host, seed FROM node
  UNION ALL
  SELECT nxt, n.kind, n.host, greatest(n.seed, {DAMPING} * coalesce(g.got, 0))
  FROM node n LEFT JOIN (
    SELECT move.kind, move.to_, sum(move.share * walk.score) AS got FROM walk JOIN move ON move.kind = walk.kind AND move.host = walk.host GROUP BY ALL
  ) g ON g.kind = n.kind AND g.to_ = n.host
  CROSS JOIN (SELECT max(round) + 1 AS nxt FROM walk) t WHERE nxt <= {ROUNDS}),
final AS (SELECT host, max(score) FILTER (kind = 'trust') AS trust, max(score) FILTER (kind = 'distrust') AS distrust FROM walk WHERE round = {ROUNDS} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN f.distrust - f.trust >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN final f ON f.host = j.host
"""


OP7_SQL = _sql()
