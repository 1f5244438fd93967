import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventlake.operators import checks as C
from eventlake.operators import log as L
from eventlake.operators import read as R

SCHEMA = "arrival long, topic string, partition int, payload string, timestamp_ms long, idempotency_key string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.encode("payload", "UTF-8"))


def rows(n=400, seed=0):
    dice = random.Random(seed)
    return [(i, dice.choice("ab"), dice.choice([0, 1, 9, 10, 99]), f"p{i}", dice.randrange(10_000), dice.choice([None, f"k{dice.randrange(40)}"])) for i in range(n)]


def loop(all_rows):
    """What a log would do, one write after the other."""
    last, keys, out = defaultdict(int), {}, {}
    for arrival, topic, partition, _, _, key in all_rows:
        at = (topic, partition)
        if key is not None and (at, key) in keys:
            out[arrival] = keys[at, key]
            continue
        last[at] += 1
        out[arrival] = last[at]
        if key is not None:
            keys[at, key] = last[at]
    return out, dict(last)


@pytest.mark.parametrize("width", [7, 65_536])
def test_sequences_and_offsets_match_a_loop(spark, width):
    data = rows()
    df = batch(spark, data)
    want, last = loop(data)
    added = L.with_sequence(L.first_of_key(df, "arrival"), "arrival", width=width)
    got = {r.arrival: r.sequence for r in L.offsets_of_batch(df, added, "arrival").collect()}
    assert got == want
    assert {(r.topic, r.partition): r.high for r in L.high_marks(added).collect()} == last


def test_batches_equal_one_batch(spark):
    data = rows(seed=1)
    want, _ = loop(data)
    done = None
    for a, b in ((0, 3), (3, 170), (170, 400)):
        new = L.write_batch(batch(spark, data[a:b]), "arrival", done, None if done is None else L.high_marks(done))
        done = new if done is None else done.unionByName(new)
    assert {r.arrival: r.sequence for r in done.select("arrival", "sequence").collect()}.items() <= want.items()


def test_reads(spark):
    data = [(i, "t", p, f"x{i}", ts, None) for i, (p, ts) in enumerate([(0, 1000), (0, 2000), (0, 3000), (9, 1500), (9, 2000)])]
    log = L.write_batch(batch(spark, data), "arrival")
    seqs = lambda df: [(r.partition, r.sequence) for r in df.collect()]
    assert seqs(R.time_range(log, "t", 0, 1500, 2500, 10)) == [(0, 2)]
    assert seqs(R.merged(log, "t", 1500, 10)) == [(9, 1), (0, 2), (9, 2), (0, 3)]
    assert seqs(R.offset_range(log, "t", 9, 1, 0)) == [] and seqs(R.offset_range(log, "t", 9, 5, 10)) == [] and seqs(R.offset_range(log, "none", 0, 0, 9)) == []
    assert [r.has_more for r in R.page(log, "t", None, 4).collect()] == [True] * 4 and [r.has_more for r in R.page(log, "t", None, 5).collect()] == [False] * 5
    flush = L.high_marks(log).select("topic", "partition", F.lit(1).alias("flush"))
    assert sorted(seqs(L.uncommitted(log, flush))) == [(0, 2), (0, 3), (9, 2)]


def test_projection():
    assert R.parse_fields(" payload,, sequence ") == ["sequence", "payload"] and R.parse_fields(None) == []
    with pytest.raises(ValueError, match="valid fields"):
        R.parse_fields("payload,nope")


def test_arrow_and_json_output(spark):
    import io

    import pyarrow as pa

    log = L.write_batch(batch(spark, [(0, "t", 0, "é", 5, None)]), "arrival").withColumn("payload", F.unhex(F.lit("C3A9FF")))
    table = pa.ipc.open_stream(io.BytesIO(R.arrow_stream(log))).read_all()
    assert table.column_names == ["sequence", "topic", "partition", "timestamp_ms", "payload", "idempotency_key"] and table["payload"][0].as_py() == b"\xc3\xa9\xff"
    assert pa.ipc.open_stream(io.BytesIO(R.arrow_stream(log.limit(0), "payload"))).read_all().schema.names == ["payload"]
    assert log.select(R.as_json(log, "payload,idempotency_key").alias("j")).first().j == '{"payload":"é�","idempotency_key":null}'


def test_gaps_and_coverage(spark):
    dice = random.Random(3)
    for width in (3, 1000):
        have = sorted(dice.sample(range(1, 200), 120))
        log = spark.createDataFrame([("t", 0, s) for s in have] + [("t", 1, 5)], "topic string, partition int, sequence long")
        want = {(a, b) for a, b in zip(have, have[1:], strict=False) if b - a > 1}
        assert {(r.after, r.sequence) for r in C.gaps(log, width).collect()} == want
    files = spark.createDataFrame([("t", 0, 1, 10), ("t", 0, 5, 6), ("t", 0, 9, 20), ("t", 0, 31, 40)], "topic string, partition int, sequence_min long, sequence_max long")
    assert sorted((r["first"], r["last"]) for r in C.uncovered(files, 1, 45).collect()) == [(21, 30), (41, 45)]


def test_marks(spark):
    mk = lambda n, *v: spark.createDataFrame([("t", p, x) for p, x in v], f"topic string, partition int, {n} long")
    assert {r.partition: r.flush for r in L.raise_marks(mk("flush", (0, 5)), mk("flush", (0, 3), (1, 7)), "flush").collect()} == {0: 5, 1: 7}
    assert [r.width for r in L.cleanup_width(mk("flush", (0, 5)), mk("cleanup", (0, 5))).collect()] == [0]
    lag = {r.partition: (r.committed, r.lag) for r in L.lag(mk("high", (0, 9), (1, 4)), mk("committed", (0, 12), (2, 1))).collect()}
    assert lag == {0: (12, 0), 1: (None, 4)}


def test_folds_over_ranges_match_whole_partitions(spark):
    import random

    from eventlake.operators import checks as C

    dice = random.Random(3)
    rows = [("t", p, i, dice.randrange(100), dice.choice([None, 5, 9, 40])) for p in (0, 1, 2) for i in range(1, 60 if p else 200)]
    df = spark.createDataFrame(rows, "topic string, partition int, sequence long, v int, size int").withColumn("range", F.lit(1)).withColumn("row", F.lit(2)).withColumn("before", F.lit(3))
    for target in (0, 50, 10**6):
        want = set()
        for p in (0, 1, 2):
            total = 0
            for _, q, i, _, size in rows:
                if q == p:
                    total += size or 0
                    if total <= target or i == 1:
                        want.add((p, i))
        got = L.size_prefix(df, F.col("size"), target, width=16)
        assert got.columns == df.columns and {(r.partition, r.sequence) for r in got.collect()} == want
    got = L.count_prefix(df, 37, width=16)
    assert got.columns == df.columns and sorted((r.partition, r.sequence) for r in got.collect()) == [(p, i) for p in (0, 1, 2) for i in range(1, 38)]
    want = {(p, i, max(top)) for _, p, i, v, _ in rows if (top := [w for _, q, j, w, _ in rows if q == p and j < i]) and v < max(top)}
    assert {(r.partition, r.sequence, r.highest_before) for r in C.out_of_order(df, "sequence", "v", width=16).collect()} == want
    assert L.with_sequence(df.drop("sequence").withColumn("at", F.monotonically_increasing_id()), "at", width=16).columns[-1] == "sequence"


def test_exact_ranks(spark):
    import random

    from eventlake.operators import checks as C

    dice = random.Random(4)
    values = {"a": [dice.gauss(0, 1) for _ in range(5000)], "b": [1.0] * 700 + [2.0], "c": [3.0], "d": [None], "e": [float(i % 3) for i in range(100)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "g string, x double").repartition(5)
    got = {r.g: (r.p0, r.p50, r.p99, r.p100) for r in C.nearest_ranks(df, ["g"], "x", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    rank = lambda vs, p: sorted(vs)[min(int(len(vs) * p), len(vs) - 1)]
    assert got == {k: (None,) * 4 if vs == [None] else tuple(rank(vs, p) for p in (0.0, 0.5, 0.99, 1.0)) for k, vs in values.items()}


def test_first_of_key_is_limited_before_one_shuffle(spark):
    import contextlib
    import io

    rows = [(i, "click", i % 2, None if i % 5 == 4 else "hot" if i % 3 else f"k{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "arrival long, topic string, partition int, idempotency_key string").repartition(4)
    first = {}
    for i, topic, partition, key in rows:
        first.setdefault((topic, partition, key), i)
    kept = L.first_of_key(df, "arrival")
    assert sorted(r.arrival for r in kept.collect()) == sorted(i for i, *k in rows if k[2] is None or first[tuple(k)] == i)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        L.first_of_key(df.where("idempotency_key is not null"), "arrival").explain()
    assert "Join" not in shown.getvalue() and "Partial" in shown.getvalue().split("WindowGroupLimit", 1)[1]
