import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from eventlake.llm.url_filter import ORACLE_SQL, RULES, host_links, judge_pages, propagate, url_parts

SCHEMA = "page_id long, url string, html string, rule string, trust double"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1.0) for i, (u, h) in enumerate(rows)], SCHEMA)


def link(*urls):
    return "".join(f'<a class=x href="{u}">t</a>' for u in urls)


def test_parts_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/21", "http://x.com/fr/1", "http://x.com/de/1", "http://xcom/de/1", "http://notexample.org/es/", "http://org", "http://org/", None, "no scheme", "a://B?c://D/e", "://", ""]
    got = {r.page_id: r for r in judge_pages(spark, pages(spark, [(u, None) for u in urls])).collect()}
    assert [(r.host, r.path) for r in (got[0], got[7], got[9], got[10], got[11], got[12])] == [("a.example.org", "/es/x"), ("org", ""), ("", ""), ("", ""), ("b", ""), ("", "")]
    assert [got[i].rule for i in range(10)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, "org/", None, "org/", None]
    assert [got[i].verdict for i in range(7)] == ["block", "block", "allow", "allow", "block", "allow", "allow"]
    assert len(got) == len(urls) and len(RULES) == 5


def test_propagation_matches_power_iteration(spark):
    links = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "d", 1), ("e", "d", 3), ("d", "e", 1)]
    seeds = {"a": (3.0, 0.0), "d": (0.0, 2.0), "z": (1.0, 1.0)}
    got = {r.host: (r.trust, r.distrust) for r in propagate(spark, spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(links, "src string, dst string, n long"), rounds=100, tolerance=1e-12).collect()}
    names = sorted({x for link in links for x in link[:2]} | set(seeds))
    m = np.zeros((len(names),) * 2)
    for s, d, n in links:
        m[names.index(d), names.index(s)] = n
    forward = m / np.maximum(m.sum(0), 1)
    backward = m.T / np.maximum(m.T.sum(0), 1)
    for k, step in enumerate((forward, backward)):
        seed = np.array([seeds.get(n, (0, 0))[k] for n in names])
        want = 0.15 * np.linalg.solve(np.eye(len(names)) - 0.85 * step, seed)
        assert np.allclose([got[n][k] for n in names], want, atol=1e-6)


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    rows = [("http://bad.com/de/1", None)] * 3 + [("http://farm.net/1", link("http://bad.com/x", "//bad.com/y", "/here")), ("http://good.com/fr/1", link("https://fine.net/q")), ("http://fine.net/2", ""), ("http://fine.net/2", ""), ("http://alone.net/", None)]
    got = {(r.host, r.verdict) for r in judge_pages(spark, pages(spark, rows)).collect()}
    assert got == {("bad.com", "block"), ("farm.net", "block"), ("good.com", "allow"), ("fine.net", "allow"), ("alone.net", "allow")}


def test_links(spark):
    df = pages(spark, [("http://a.net/", link("http://B.net/x", "//c.net", "/d", "mailto:x@y.z", "http://a.net/self") + '<img src=https://b.net/i.png>')]).select("html", url_parts(F.col("url"))[0].alias("host"))
    assert sorted((r.src, r.dst, r.n) for r in host_links(df).collect()) == [("a.net", "b.net", 2), ("a.net", "c.net", 1)]


def test_empty_table(spark):
    assert judge_pages(spark, pages(spark, [])).collect() == []


def test_distrust_reaches_hosts_far_away(spark):
    n = 30
    seeds = spark.createDataFrame([("h0", 0.0, 1.0), ("x", 1.0, 0.0)], "host string, trust double, distrust double")
    links = [(f"h{i + 1}", f"h{i}", 1) for i in range(n)]
    got = {r.host: r.distrust for r in propagate(spark, seeds, spark.createDataFrame(links, "src string, dst string, n long")).collect()}
    assert all(np.isclose(got[f"h{i}"], 0.15 * 0.85**i, rtol=1e-5, atol=0) for i in range(n + 1))


def test_sql_gives_the_same_verdicts_on_linked_hosts(spark):
    dice = random.Random(4)
    urls = ["http://a.com/de/1", "http://b.com/fr/2", "http://x.Example.org/es/1", "http://example.org/en/12", "http://u.org/q", "://", "none", None, ""]
    urls += [f"http://h{i}.net/{i}" for i in range(30)]
    rows = [(u, dice.choice([None, "", link(*dice.choices([v for v in urls if v], k=dice.randrange(1, 5)))])) for u in urls * 2]
    table = pages(spark, rows)
    got = {r.page_id: r for r in judge_pages(spark, table).collect()}
    arrow = table.toArrow()
    want = duckdb.connect().register("pages", arrow).execute(ORACLE_SQL).fetchall()
    assert len(want) == len(got) == len(rows) and len({r[4] for r in want if r[3] is None}) == 2
    for page_id, host, path, rule, verdict, trust, distrust in want:
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert np.allclose((r.host_trust, r.host_distrust), (trust, distrust), rtol=1e-4, atol=0)
        assert r.verdict == verdict or np.isclose(trust, distrust, rtol=1e-4)


def test_very_long_html(spark):
    page = link(*[f"http://h{i % 3}.net/{i}" for i in range(30_000)]) + "<p>" + "word " * 200_000
    df = pages(spark, [("http://a.net/", page)]).select("html", F.lit("a.net").alias("host"))
    assert sorted((r.dst, r.n) for r in host_links(df).collect()) == [(f"h{i}.net", 10_000) for i in range(3)]
