"""URL filters: allow and block rules, and for what no rule fits, trust and distrust propagated over host links.

DataFrame functions only. Rules are a short list that the caller gives. Everything per page is a
projection; everything per host is aggregated by partial sums before it is shuffled, so a host that
has a third of all pages costs one row for each task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, shared_dir, table

_PARTS = r"://([^/?#]*)([^?#]*)"
#: Far more than any link graph needs: the longest way from a seed, and about a hundred rounds for its cycles.
MOST_ROUNDS = 4000
_LINKS = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]*)"


@dataclass(frozen=True)
class Rule:
    """`host` and its subdomains, for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z lower-cased) and path; both empty for null or without `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null; of equally long ones the first listed."""
    ordered = sorted(rules, key=lambda r: -len(r.name))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered])


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct host pairs (src, dst, n) that pages link; links within a host say nothing about it and are left out."""
    link = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINKS), 1))
    found = pages.select("host", link.alias("link")).select(F.col("host").alias("src"), url_parts(F.regexp_replace("link", "^//", "x://"))[0].alias("dst"))
    return found.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(spark: SparkSession, seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank of trust along links and of distrust against them.

    seeds: (host, trust, distrust), a host once; links: (src, dst, n). Returns (host, trust, distrust).
    Rank is r = (1 - damping) * seed + damping * (what neighbours pass on). What hosts without links
    would return to the seeds only scales a whole vector, so it isn't added. Each fourth round goes to
    a checkpoint in the shared folder, which cuts the lineage, and is where convergence is tested: verdicts
    take the ratio of a host's two ranks, so rounds go on until neither rank of any host, however small, has moved by more
    than `tolerance` of itself in four rounds, and none is newly reached. What later rounds would still move is
    at most `tolerance` of all rank for the next four, and damping ** 4 (0.52) times as much for each four after
    those. After MOST_ROUNDS without that, an error is raised. A caller who names `rounds` gets that many at most,
    and no error.
    """
    shared_dir(spark)
    outs = links.groupBy("src").agg(F.sum("n").alias("n_out"))
    ins = links.groupBy("dst").agg(F.sum("n").alias("n_in"))
    none = F.lit(0.0)
    both = (
        links.join(outs, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("n_out")).alias("wt"), none.alias("wd"))
        .unionByName(links.join(ins, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), none.alias("wt"), (F.col("n") / F.col("n_in")).alias("wd")))
        .groupBy("a", "b").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd"))
        .checkpoint()
    )
    nodes = seeds.unionByName(both.select(F.col("a").alias("host"), none.alias("trust"), none.alias("distrust"))).groupBy("host").agg(F.sum("trust").alias("seed_t"), F.sum("distrust").alias("seed_d")).checkpoint()
    rank = last = nodes.select("host", F.col("seed_t").alias("trust"), F.col("seed_d").alias("distrust"))
    if both.isEmpty():
        return nodes.select("host", ((1 - damping) * F.col("seed_t")).alias("trust"), ((1 - damping) * F.col("seed_d")).alias("distrust"))
    for i in range(1, (rounds or MOST_ROUNDS) + 1):
        passed = rank.join(both, rank.host == both.a).groupBy("b").agg(F.sum(F.col("trust") * F.col("wt")).alias("t"), F.sum(F.col("distrust") * F.col("wd")).alias("d"))
        rank = nodes.join(passed, nodes.host == passed.b, "left").select(
            "host",
            ((1 - damping) * F.col("seed_t") + damping * F.coalesce("t", none)).alias("trust"),
            ((1 - damping) * F.col("seed_d") + damping * F.coalesce("d", none)).alias("distrust"),
        )
        if i % 4 == 0 or i == rounds:
            rank = rank.checkpoint()
            still = lambda new, old: F.abs(F.col(new) - F.col(old)) <= tolerance * F.col(new)
            moved = rank.join(last.toDF("h", "t0", "d0"), F.col("host") == F.col("h")).where(~(still("trust", "t0") & still("distrust", "d0")))
            if moved.isEmpty():
                return rank
            last = rank
    if rounds is None:
        raise RuntimeError(f"host ranks still moved by more than {tolerance} of themselves after {MOST_ROUNDS} rounds")
    return rank


def judge_pages(spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, **how) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_trust, host_distrust.

    The seeds of a host are its pages that rules allow, and those that rules block. A page without a
    rule is blocked if distrust makes up more than `threshold` of its host's trust and distrust together;
    a host that neither reaches is allowed, as is an empty host. A null or malformed url has an empty host and
    path and no rule; null html has no links; repeated rows are judged alike and each kept; an empty
    table gives an empty result; columns other than page_id, url and html are ignored.
    """
    page = pages.select("page_id", "url", "html")
    page = page.select("page_id", "html", *[c.alias(n) for c, n in zip(url_parts(F.col("url")), ("host", "path"), strict=True)])
    page = page.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("*", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled")).drop("fit")
    count = lambda v: F.sum(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = page.where("host != ''").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    ranks = propagate(spark, seeds, host_links(page), **how)
    known = ranks.select(F.col("host").alias("of"), "trust", "distrust")
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return page.drop("html").join(known, F.col("host") == F.col("of"), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(bad, "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("host_trust"), F.coalesce("distrust", F.lit(0.0)).alias("host_distrust"),
    )


#: Ranks in SQL go through a fixed number of rounds; on tables whose pages link no other host one round is exact.
ORACLE_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, coalesce(html, '') AS html,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
),
rules(verdict, of, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT DISTINCT host, path, first(of || start ORDER BY length(of || start) DESC) AS rule, first(verdict ORDER BY length(of || start) DESC) AS ruled
        FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY host, path),
page AS (SELECT page_id, html, host, path, rule, ruled FROM parts LEFT JOIN fit USING (host, path)),
seeds AS (SELECT host, CAST(count(*) FILTER (ruled = 'allow') AS DOUBLE) AS seed_t, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS seed_d FROM page WHERE host <> '' GROUP BY host),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1)) AS link FROM page),
links AS (
  SELECT src, dst, count(*) AS n
  FROM (SELECT src, translate(regexp_extract(regexp_replace(link, '^//', 'x://'), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM found)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
),
weights AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS wt, n / sum(n) OVER (PARTITION BY dst) AS wd FROM links),
edges AS (SELECT a, b, sum(wt) AS wt, sum(wd) AS wd FROM (SELECT src AS a, dst AS b, wt, 0.0::DOUBLE AS wd FROM weights UNION ALL SELECT dst, src, 0.0, wd FROM weights) GROUP BY a, b),
nodes AS (SELECT host, sum(seed_t) AS seed_t, sum(seed_d) AS seed_d FROM (SELECT * FROM seeds UNION ALL SELECT a, 0.0, 0.0 FROM edges) GROUP BY host),
ranks(i, host, trust, distrust) AS (
  SELECT 0, host, seed_t, seed_d FROM nodes
  UNION ALL
  SELECT passed.i + 1, nodes.host, (1 - 0.85::DOUBLE) * seed_t + 0.85::DOUBLE * t, (1 - 0.85::DOUBLE) * seed_d + 0.85::DOUBLE * d
  FROM nodes JOIN (
    SELECT r.i, r.host, coalesce(sum(f.trust * wt), 0.0::DOUBLE) AS t, coalesce(sum(f.distrust * wd), 0.0::DOUBLE) AS d
    FROM ranks r LEFT JOIN edges ON b = r.host LEFT JOIN ranks f ON f.host = a WHERE r.i < 120 GROUP BY r.i, r.host
  ) passed ON passed.host = nodes.host
),
known AS (SELECT host, trust, distrust FROM ranks WHERE i = 120)
SELECT page_id, page.host, path, rule,
       coalesce(ruled, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0.0::DOUBLE) AS host_trust, coalesce(distrust, 0.0::DOUBLE) AS host_distrust
FROM page LEFT JOIN known ON known.host = page.host
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark, table(spark, sf_dir, "pages"))
