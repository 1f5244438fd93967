import random

import numpy as np
from corpus import awkward, documents

from eventlake.llm.components import components
from eventlake.llm.jaccard_join import fewest_apart, one_of_each, similar_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def brute(rows, size=5):
    sets = [shingles(t, size) for _, t in rows]
    ids = [-1 if d is None else d for d, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 10**9), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def near_copies(seed):
    """Chains of edits, so that groups hang together by links between neighbours only, next to groups just below the threshold."""
    dice = random.Random(seed)
    word = lambda: f"W{dice.randrange(5000)}"
    out, n = [], 0
    for _ in range(12):
        words = [word() for _ in range(dice.choice([3, 6, 30, 60, 200]))]
        for _ in range(dice.randrange(1, 9)):
            out.append((n := n + 1, " ".join(words)))
            words = [word() if dice.random() < 0.02 else w for w in words]
            if dice.random() < 0.3:
                words = words[: max(1, int(len(words) * 0.85))]
    dice.shuffle(out)
    return out


def test_matches_brute_force(spark):
    rows = awkward(0) + [(10000 + i, t) for i, t in near_copies(1)]
    got = similar_groups(spark, documents(spark, rows).repartition(5), sketch_bits=16).collect()
    val = lambda v: -1 if v is None else v
    assert sorted((val(r.doc_id), r.n_shingles, val(r.component_id)) for r in got) == brute(rows)


def test_saturated_sketch_loses_nothing(spark):
    rows = near_copies(2) + [(5000 + i, t) for i, t in near_copies(3)]
    got = similar_groups(spark, documents(spark, rows), sketch_bits=10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_one_of_each(spark):
    docs = documents(spark, [(3, "a b c d e f"), (1, "A b c d e f"), (2, "x y"), (4, None), (5, ""), (None, "a b c d e f")])
    assert sorted(r.doc_id or 0 for r in one_of_each(spark, docs, sketch_bits=10).collect()) == [0, 1, 2, 4, 5]


def test_a_common_line_and_a_large_group(spark):
    dice = random.Random(4)
    line, base = " ".join(f"L{i}" for i in range(30)), [f"b{i}" for i in range(60)]
    rows = [(i, f"{line} " + " ".join(f"u{dice.randrange(10**6)}" for _ in range(4))) for i in range(40)]
    for i in range(60):
        words = list(base)
        for at in dice.sample(range(60), dice.randrange(0, 3)):
            words[at] = f"x{dice.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    got = similar_groups(spark, documents(spark, rows).repartition(4), sketch_bits=14).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_suffix_filter_never_overestimates():
    dice = np.random.default_rng(5)
    for _ in range(300):
        x, y = (np.unique(dice.integers(0, 60, dice.integers(0, 40))) for _ in range(2))
        apart = len(np.setxor1d(x, y))
        assert all(fewest_apart(x, y, depth) <= apart for depth in range(5))
        assert fewest_apart(x, y, 10) == apart


def test_one_of_each_with_shared_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0), (2, "a b c d e f", 1), (2, "g h i j k l", 2), (1, "a b c d e f", 3)], "doc_id long, text string, gone_id int").withColumnRenamed("gone_id", "GONE_ID")
    docs = docs.withColumn("gone_mark", docs.text)
    assert sorted(r.GONE_ID for r in one_of_each(spark, docs, sketch_bits=10).collect()) == [0, 2, 3]


def test_empty_table(spark):
    assert similar_groups(spark, documents(spark, []), sketch_bits=10).collect() == []


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a int, b int")
    got = {r.node: r.component for r in components(spark, path).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
