import hashlib

import numpy as np
from corpus import awkward, documents

from eventlake.llm.sketch import Sketch, saturating_sum
from eventlake.llm.substring_dedup import remove_repeats


def brute(rows, size):
    """Documents in (doc_id, text) order; missing ids first, repeated rows once. The order of texts that share an id is the operator's own, so ids here are unique per text."""
    seen, out = set(), {}
    for doc_id, text in sorted({(d if d is not None else -1, t) for d, t in rows}, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if w in seen:
                gone[i : i + size] = True
            seen.add(w)
        out[doc_id, text] = (len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def unique_ids(rows):
    text = {}
    return [(d, t) for d, t in rows if text.setdefault(d, t) == t]


def test_matches_brute_force(spark):
    for seed, size in ((0, 20), (1, 5), (2, 9)):
        rows = unique_ids(awkward(seed))
        got = remove_repeats(spark, documents(spark, rows).repartition(5), size, sketch_bits=14).collect()
        want = brute(rows, size)
        text = dict(rows)
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_removed, bytes(r.kept)) == want[r.doc_id if r.doc_id is not None else -1, text[r.doc_id]], r.doc_id


def test_rows_sharing_an_id(spark):
    got = remove_repeats(spark, documents(spark, awkward(3)), 5, sketch_bits=14).where("doc_id = 7").collect()
    assert len(got) == 3 and {r.n_words for r in got} == {30, 31}


def test_full_sketch_loses_nothing(spark):
    rows = unique_ids(awkward(4))
    a, b = (sorted((r.doc_id or -1, r.n_removed, bytes(r.kept)) for r in remove_repeats(spark, documents(spark, rows), 6, sketch_bits=n).collect()) for n in (10, 20))
    assert a == b


def test_empty_table(spark):
    assert remove_repeats(spark, documents(spark, [])).collect() == []


def test_sketch_counts_and_merges():
    dice = np.random.default_rng(0)
    keys = dice.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = Sketch(14), Sketch(14)
    a.add(keys[:2000])
    b.add(keys[1500:])
    whole = Sketch(14)
    whole.add(keys[:2000])
    whole.add(keys[1500:])
    for r in range(2):
        assert (saturating_sum(a.rows[r].view(np.uint64), b.rows[r].view(np.uint64)) == whole.rows[r].view(np.uint64)).all()
    assert whole.repeated(keys[1500:2000]).all()
    alone = Sketch(20)
    alone.add(keys)
    assert alone.repeated(keys).mean() < 0.01


def test_digest_of_kept_text(spark):
    from pyspark.sql import functions as F

    r = remove_repeats(spark, documents(spark, [(1, " a\tb ")]), sketch_bits=10).select(F.sha2("kept", 256).alias("s")).first()
    assert r.s == hashlib.sha256(b"a b").hexdigest()
