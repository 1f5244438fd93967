import hashlib
import re

from corpus import awkward, documents
from pyspark.sql import functions as F

from eventlake.llm.exact_dedup import StreamingDeduper, dedup_groups, dedup_rows


def brute(rows):
    body = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    groups = {}
    for i, b in enumerate(body):
        groups.setdefault(b, []).append(i)
    out = []
    for b, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        out += [(rows[i][0], rows[best][0], len(members), hashlib.sha256(b.encode()).hexdigest()) for i in members]
    return out


KEY = lambda r: tuple((v is None, v) if not isinstance(v, str) else v for v in r)


def test_matches_brute_force(spark):
    rows = awkward(0)
    got = dedup_groups(spark, documents(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(brute(rows), key=str)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})  # one of repeated rows


def test_state_outlives_a_run(spark, tmp_path):
    rows = awkward(1)
    first = StreamingDeduper(spark, str(tmp_path / "d"), files_per_batch=2)
    first.ingest(documents(spark, rows[:40]).repartition(3))
    later = StreamingDeduper(spark, str(tmp_path / "d"))
    later.ingest(documents(spark, rows[40:]))
    got = later.groups().collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=str) == sorted(brute(rows), key=str)


def test_full_bytes_tell_colliding_digests_apart(spark):
    rows = awkward(2)
    weak = lambda body: F.substring(F.sha2(body.cast("binary"), 256), 1, 1)
    got = dedup_groups(spark, documents(spark, rows), digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted((r[:3] for r in brute(rows)), key=str)


def test_rows_keep_their_columns(spark):
    docs = documents(spark, [(2, "a b"), (1, "ab"), (3, "a b"), (4, None)])
    got = dedup_rows(spark, docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 4]


def test_empty_table(spark):
    assert dedup_groups(spark, documents(spark, [])).collect() == [] and dedup_rows(spark, documents(spark, [])).collect() == []
