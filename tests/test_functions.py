import json

import pytest
from pyspark.sql import functions as F

from eventlake.functions import scalar as S
from eventlake.functions.extract import extracted, lifted
from eventlake.schema import Extracted, TableConfig, lake_schema, valid_table_name
from eventlake.service import Gate, NotAcceptable, error_response, negotiate
from eventlake.sources import ingest


@pytest.mark.parametrize(("ms", "date", "hour"), [(951_782_399_999, "2000-02-28", 23), (951_782_400_000, "2000-02-29", 0), (1_467_331_261_007, "2016-07-01", 0), (4_102_444_799_999, "2099-12-31", 23), (-3_600_001, "1969-12-31", 22), (0, "1970-01-01", 0)])
def test_partition_columns(spark, ms, date, hour):
    r = spark.range(1).select(S.event_date(F.lit(ms)).alias("d"), S.event_hour(F.lit(ms)).alias("h")).first()
    assert (str(r.d), r.h) == (date, hour)


def test_texts_and_keys(spark):
    r = spark.range(1).select(
        S.hex_key(F.lit(42)).alias("hex"), S.metadata_version(F.lit("a/v12.metadata.json")).alias("v"), S.metadata_version(F.lit("snap-1.avro")).alias("none"), S.bucket_and_key(F.lit("s3://b/k/x")).alias("u"),
        S.parse_segment_key(S.segment_key(F.lit("t"), F.lit(99), F.lit(1), F.lit(255))).alias("k"), S.parse_segment_key(F.lit("x")).alias("no"), S.namespace_levels(F.lit(" a \x1f\x1fb")).alias("l"),
    ).first()
    assert r.hex == "000000000000002a" and r.v == 12 and r.none is None and tuple(r.u) == ("b", "k/x") and tuple(r.k) == ("t", 99, 1, 255) and r.no is None and r.l == ["a", "b"]


def test_names(spark):
    names = {"events": True, "a" * 128: True, "a" * 129: False, "": False, "9a": False, "events\n": False, "a.b": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", valid_table_name(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in got} == names


CASES = [
    ('{"station":"north","level":-7,"note":{"by":"ann"}}', [("station", "Utf8"), ("level", "Int64")], ["north", -7], {"note": {"by": "ann"}}),
    ('{"station":"north"}', [("station", "Utf8"), ("depth", "Int64")], ["north", None], None),
    ('{"level":"seven"}', [("level", "Int64")], [None], None),
    ('{"probe":{"air":{"ppm":415}}}', [("probe.air.ppm", "Int64")], [415], None),
    ('{"open":false}', [("open", "Boolean")], [False], None),
    ('{"depth":-0.125}', [("depth", "Float64")], [-0.125], None),
    ('{"ticks":-2147483649}', [("ticks", "Int32")], [None], None),
    ('{"ticks":-2147483648}', [("ticks", "Int32")], [-2147483648], None),
    ('{"code":9007}', [("code", "Utf8")], ["9007"], None),
    ('{"probe":{"air":{"ppm":415,"ok":true}},"at":[1,2]}', [("probe.air.ppm", "Int64")], [415], {"probe": {"air": {"ok": True}}, "at": [1, 2]}),
    ('{"probe":{"air":{"ppm":415}},"at":null}', [("probe.air.ppm", "Int64")], [415], {"at": None}),
    ('{"probe":3}', [("probe.air", "Int64")], [None], {"probe": 3}),
    ('{"v":8.0}', [("v", "Int64")], [None], None),
    ('{"v":false}', [("v", "Int64")], [None], None),
    ('{"v":{"x":1}}', [("v", "Utf8")], [None], None),
    ('{"v":"xyz"}', [("v", "Binary")], [b"xyz"], None),
    ('["a"]', [("v", "Utf8")], [None], ["a"]),
]


@pytest.mark.parametrize(("payload", "fields", "values", "rest"), CASES)
def test_extraction(spark, payload, fields, values, rest):
    config = TableConfig(tuple(Extracted(f"f{i}", p, k) for i, (p, k) in enumerate(fields)), "json")
    r = extracted(spark.createDataFrame([(7, bytearray(payload.encode()), "z")], "sequence long, payload binary, x string"), config).first()
    assert list(r[1 : 1 + len(values)]) == values and r[0] == 7 and r[-1] == "z"
    assert (None if r["_payload_overflow"] is None else json.loads(bytes(r["_payload_overflow"]))) == rest


def test_bad_payloads(spark):
    df = spark.createDataFrame([(bytearray(b),) for b in (b"not json", b'{"a":1} x', b'{"a":NaN}', b"\xff")], "payload binary")
    config = TableConfig((Extracted("a", "a", "Utf8"),), "json")
    got = extracted(df, config).collect()
    assert [r.a for r in got] == [None] * 4 and bytes(got[0]["_payload_overflow"]) == b"not json"
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        extracted(df.coalesce(1), config, "failfast").collect()
    assert extracted(df, TableConfig((Extracted("a", "a", "Utf8"),), "binary")).first().a is None


def test_lifted_agrees_with_extraction(spark):
    rows = ['{"v":42}', '{"v":"42"}', '{"v":42.0}', '{"v":true}', '{"v":3000000000}', '{}', '{"v":"NaN"}', '{"v":1e3}', "no"]
    df = spark.createDataFrame([(bytearray(r.encode()),) for r in rows], "payload binary")
    for kind in ("Int32", "Int64", "Float64", "Boolean"):
        f = Extracted("v", "v", kind)
        assert [r[0] for r in df.select(lifted(F.col("payload"), f)).collect()] == [r[0] for r in extracted(df, TableConfig((f,), "json")).collect()], kind


def test_configurations():
    assert TableConfig.parse("{nope") is None and TableConfig.parse('{"fields":[{"name":"a","type":"Int64"}],"payload_format":"json"}').fields[0].path == "a"
    with pytest.raises(ValueError):
        TableConfig((Extracted("sequence", "s", "Int64"),))
    names = lake_schema(TableConfig((Extracted("a", "a", "Int64", False),), "json")).fieldNames()
    assert names == ["sequence", "topic", "partition", "timestamp_ms", "idempotency_key", "a", "_payload_overflow", "event_date", "event_hour"]


def test_json_requests(spark):
    df = spark.createDataFrame([(1, '{"payload":"p","partition":3,"timestamp_ms":5,"idempotency_key":"k"}'), (2, '{"payload":"é"}'), (3, "{"), (4, '{"partition":1}')], "id long, body string")
    got = {r.id: r for r in ingest.json_writes(df, F.lit(99)).collect()}
    assert set(got) == {1, 2} and (got[2].partition, got[2].timestamp_ms, bytes(got[2].payload), got[1].idempotency_key) == (0, 99, "é".encode(), "k")
    assert sorted(r.id for r in ingest.rejected(df).collect()) == [3, 4]
    bulk = spark.createDataFrame([(1, '{"records":[{"payload":"a"},{"payload":"b","partition":2}]}'), (2, '{"records":[]}')], "id long, body string")
    assert [(r.id, r.item, bytes(r.payload), r.partition) for r in ingest.json_bulk(bulk, F.lit(1)).collect()] == [(1, 0, b"a", 0), (1, 1, b"b", 2)]


def test_malformed_messages():
    assert ingest.decoded(b"\x0a\x05ab", False) is None and ingest.decoded(b"\x08", False) is None and ingest.decoded(b"", False)[0]["payload"] == b""
    assert ingest.decoded(b"\xff" * 12, False) is None


def test_negotiation():
    assert negotiate(None) == negotiate("*/*") == "application/json"
    assert negotiate("text/html, application/vnd.apache.arrow.stream;q=0.9, application/json;q=0.5") == "application/vnd.apache.arrow.stream"
    with pytest.raises(NotAcceptable):
        negotiate("text/html")
    assert error_response(NotAcceptable("x"))[0] == 406 and error_response(RuntimeError("x"))[0] == 500


def test_gate():
    gate = Gate(most_writes=2, most_bytes=100)
    assert gate.enter(60) and not gate.enter(50) and gate.enter(40) and not gate.enter(0) and not gate.ready()
    gate.leave(60)
    assert gate.enter(1) and gate.refused == 2 and gate.ready()


def test_bounds_are_big_endian(spark):
    import datetime

    values = [(0, 0, datetime.date(1970, 1, 1), "a"), (-1, -2, datetime.date(1969, 12, 31), ""), (2**63 - 1, 2**31 - 1, datetime.date(2024, 2, 29), "\u00e9"), (-(2**63), -(2**31), datetime.date(1900, 1, 1), "z"), (None, None, None, None)]
    df = spark.createDataFrame(values, "l long, i int, d date, s string")
    got = df.select(*[S.bound_bytes(F.col(c), k).alias(c) for c, k in (("l", "long"), ("i", "int"), ("d", "date"), ("s", "string"))]).collect()
    days = lambda d: (d - datetime.date(1970, 1, 1)).days
    want = [tuple(None if v is None else v.encode() if isinstance(v, str) else (days(v) if size == 4 and isinstance(v, datetime.date) else v).to_bytes(size, "big", signed=True) for v, size in zip(row, (8, 4, 4, 0), strict=True)) for row in values]
    assert [tuple(None if v is None else bytes(v) for v in r) for r in got] == want


def test_failing_stores_are_tried_again():
    from eventlake.sources import files

    waits, left = [], [3]

    def call(x):
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("Connect reset")
        return x

    assert files.retried(call, waits.append)(5) == 5 and len(waits) == 3 and all(0.05 * 2**i <= w <= 0.1 * 2**i for i, w in enumerate(waits))
    for error, tries in ((OSError("FileNotFoundException"), 1), (ValueError("x"), 1), (OSError("timed out"), 5)):
        seen = []

        def fails(error=error, seen=seen):
            seen.append(1)
            raise error

        with pytest.raises(type(error)):
            files.retried(fails, lambda _: None)()
        assert len(seen) == tries
