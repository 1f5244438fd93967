import importlib
import os
import re
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_works_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("eventlake.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "eventlake.llm", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "q5_events_by_hour" in names and not any(n.startswith("op1") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "eventlake")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, f)).read()), f


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_flagship_query(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["event_date", "event_hour", "n"] and out.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["q3_continuity", "q13_gaps", "r2_merged_read", "l3_batch_offsets", "a12_lag", "a14_uncovered", "f1_partition_columns", "f8_extracted", "o5_size_prefix", "s2_protobuf_writes"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from eventlake.plans import suite

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = suite.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({suite.ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and rows


def test_texts_of_dates_in_far_years_match_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from pyspark.sql import functions as F

    from eventlake.plans import suite

    con = duckdb.connect()
    rows = "(-3000000, TIMESTAMP '2024-01-01 10:00:00'), (0, '9999-12-31 23:59:59'), (1, '10000-01-01 00:00:00'), (2, '0001-01-01 00:00:00'), (3, '0001-12-31 (BC) 12:00:00'), (4, '10001-01-01 (BC) 00:00:00'), (719167, '2024-01-01 00:00:00'), (719168, '2024-01-01 00:00:00'), (5999999, '2024-01-31 00:00:00'), (NULL, '2024-01-31 00:00:00')"
    con.execute(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts, 7::BIGINT AS user_id, 'click' AS event_type, 1.5::DOUBLE AS value, '{{}}' AS props FROM (VALUES {rows}) AS t(event_id, ts)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = suite.QUERIES["f1_partition_columns"](spark, str(tmp_path)).select("event_id", F.unix_date("event_date"), "event_hour", "text").collect()
    want = con.execute(f"SELECT event_id, event_date - DATE '1970-01-01', event_hour, text FROM ({suite.ORACLES['f1_partition_columns']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and any("BC" in r[3] for r in want if r[3])
    got = suite.QUERIES["q12_duplicate_keys"](spark, str(tmp_path)).collect() + suite.requests(spark, str(tmp_path)).select("event_id", "idempotency_key").collect()
    want = con.execute(suite.ORACLES["q12_duplicate_keys"]).fetchall() + con.execute(f"WITH {suite.LOG_SQL} SELECT event_id, idempotency_key FROM src").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
