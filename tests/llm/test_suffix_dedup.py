from collections import Counter

from corpus import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from eventlake.llm.suffix_dedup import remove_repeats
from eventlake.llm.suffix_groups import suffix_array


@given(st.lists(st.integers(1, 3), max_size=40))
@settings(max_examples=500, deadline=None)
def test_sorts_suffixes(body):
    text = [*body, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def compare(spark, rows, size, **how):
    got = remove_repeats(spark, documents(spark, rows).repartition(5), size, **how).collect()
    want = brute([t for _, t in rows], size)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    a = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key)
    b = sorted(((d, *w) for (d, _), w in zip(rows, want, strict=True)), key=key)
    assert a == b


def test_matches_brute_force(spark):
    compare(spark, awkward(0), 100, sketch_bits=14)
    compare(spark, awkward(1), 30, core=20, sketch_bits=14)


def test_many_units_of_one_anchor(spark):
    compare(spark, awkward(2, n=120), 60, core=40, most_units=1, sketch_bits=12)


def test_empty_table(spark):
    assert remove_repeats(spark, documents(spark, [])).collect() == []
