import random
import re

import duckdb
from corpus import documents
from pyspark.sql import functions as F

from eventlake.llm.decontamination import ORACLE_SQL, UNITS, clean_rows, contaminated

ITEMS = [
    (1, "Tom buys 3 apples and Anna buys 5 pears so how many kg of fruit does Tom carry home for 7 days"),
    (2, "the quick brown fox jumps over the lazy dog near the old stone bridge today"),
    (3, "too short here"),
    (4, None),
    (None, "an item without an id that has more than enough words"),
    (2, "the quick brown fox jumps over the lazy dog near the old stone bridge today"),
]
BLANK, PUNCT = re.compile("[\x20\x09-\x0d]+"), "\"'`´’‘“”«»()[]{}<>.,;:!?…*_~#|/\\=&"


def words(text):
    return [w for w in (x.strip(PUNCT) for x in BLANK.split(text or "")) if w]


def canon(w):
    if re.fullmatch(r"[+-]?[$€£]?\d[\d.,:/]*%?", w):
        return "<n>"
    if len(w) > 1 and w[0].isupper() and w[1:].isalpha() and w[1:].islower():
        return "<name>"
    return "<unit>" if w.lower() in UNITS else w.lower()


def brute(docs, items, size=5, share=0.8):
    out = set()
    slots = {"<n>", "<name>", "<unit>"}
    for item, text in {i for i in items if i[0] is not None}:
        theirs = words(text)
        ct = [canon(w) for w in theirs]
        want = {i for i in range(len(ct) - size + 1) if set(ct[i : i + size]) - slots}
        for doc, body in docs:
            if doc is None or not want:
                continue
            ours = words(body)
            co = [canon(w) for w in ours]
            found = set()
            for shift in range(-len(ct), len(co)):
                hits = {i for i in want if 0 <= i + shift and co[i + shift : i + shift + size] == ct[i : i + size]}
                pairs = {(theirs[i + k], ours[i + k + shift]) for i in hits for k in range(size) if ct[i + k] in slots}
                if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs):
                    found |= hits
            if len(found) >= share * len(want):
                out.add((doc, item, len(want), len(found)))
    return out


def corpus():
    a, b = ITEMS[0][1], ITEMS[1][1]
    renamed = a.replace("Tom", "Paul").replace("Anna", "Maria").replace("3", "12").replace("5", "40").replace("7", "9").replace("kg", "tons")
    muddled = renamed.replace("Paul carry", "Maria carry")
    noise = lambda s: " ".join(random.Random(s).choices(["oak", "elm", "Fir", "ash", "2", "pine"], k=60))
    return [
        (1, f"{noise(1)} {a}. {noise(2)}"), (2, f"{noise(3)}\n{renamed}!\t{noise(4)}"), (3, f"{noise(5)} {muddled} {noise(6)}"), (4, noise(7)), (5, None), (6, ""), (None, a),
        (7, b.upper()), (8, " ".join(b.split()[:9])), (9, b.replace("lazy", "sleepy")), (10, f"{a} {b}"), (10, f"{a} {b}"), (11, "3 4 5 6 7 8 9 10 Tom Anna Bob"), (12, "x " * 20000 + b), (13, b + " " + b),
    ]


def test_matches_brute_force(spark):
    docs, items = corpus(), ITEMS
    table = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, words string, pos int")
    want = brute(docs, items)
    for most in (500_000, 0):
        got = contaminated(spark, documents(spark, docs).repartition(3), table, most_broadcast=most).collect()
        assert {(r.doc_id, r.item_id, r.n_windows, r.n_found) for r in got} == want and len(got) == len(want)
    found = {(d, i) for d, i, _, _ in want}
    assert {(1, 1), (2, 1), (7, 2), (10, 1), (10, 2), (12, 2), (13, 2)} == found


def test_clean_rows(spark):
    docs = documents(spark, corpus())
    table = spark.createDataFrame([i for i in ITEMS], "item_id long, text string")
    left = clean_rows(spark, docs, table)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 4, 5, 6, 8, 9, 11]


def test_clean_rows_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], 7), (2, "clean", 8), (None, ITEMS[1][1], 9)], "doc_id long, text string, gone_id int").withColumn("_gone", F.lit(1)).withColumn("words", F.col("text"))
    left = clean_rows(spark, docs, spark.createDataFrame(ITEMS[1:2], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r["gone_id"] for r in left.collect()) == [8, 9]


def test_empty_tables(spark):
    table = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(spark, documents(spark, corpus()), table).collect() == []
    assert contaminated(spark, documents(spark, []), spark.createDataFrame(ITEMS[:1], "item_id long, text string")).collect() == []


def test_changed_case_is_found(spark):
    item = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = contaminated(spark, documents(spark, [(1, ITEMS[0][1].lower()), (2, "x " + ITEMS[0][1].upper()), (3, ITEMS[0][1].title())]), item).collect()
    assert {(r.doc_id, r.item_id, r.coverage) for r in got} == {(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)}


def test_one_odd_value_costs_its_windows_only(spark):
    long = "Tom buys 3 apples at the market and then " + " ".join(f"word{chr(97 + i)}" for i in range(26)) + " before he sells 5 of them while at last Tom pays 3 coins for bread and goes slowly home by the old road"
    items = spark.createDataFrame([(1, long)], "item_id long, text string")
    renamed = long.replace("Tom", "Paul").replace("3", "12").replace("5", "40")
    docs = [(1, long.replace("Tom pays", "Bob pays")), (2, long.replace("pays 3", "pays 4")), (3, renamed.replace("40", "12")), (4, renamed.replace("Paul pays", "Bob pays")), (5, renamed)]
    got = {r.doc_id: r.n_windows - r.n_found for r in contaminated(spark, documents(spark, docs), items).collect()}
    assert got == {1: 5, 2: 5, 3: 0, 4: 5, 5: 0}


def test_short_and_placeholder_items_are_found(spark):
    items = spark.createDataFrame([(1, "Tom eats 3 pears"), (2, "Tom Anna Bob Maria Paul Eve"), (3, "7 12 9"), (4, "plain words"), (5, " .")], "item_id long, text string")
    docs = [(1, "then tom eats 3 pears"), (2, "x Tom Anna Bob Maria Paul Eve y"), (3, "Eve Tom Anna Bob Maria Paul"), (4, "is 7, 12, 9"), (5, "is 7 12 8"), (6, "Plain words"), (7, "words plain"), (8, "Eve eats 4 pears"), (9, None), (10, "x")]
    got = contaminated(spark, documents(spark, docs), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (4, 3), (6, 4), (8, 1)] and {r.coverage for r in got} == {1.0}


def test_sql_gives_the_same_rows(spark):
    dice = random.Random(8)
    vocabulary = ["Ann", "Bob", "Cleo", "2", "3", "7.5", "kg", "Miles", "oak", "ELM", "ash", "buys", "of", "«Éva»", "--", "ten,"]
    items = [*ITEMS, (5, "Ann Bob 3"), (6, "Ann Bob 3 kg 7 Cleo Eva"), (7, "oak"), (8, ""), (8, "--")]
    items += [(10 + i, " ".join(dice.choices(vocabulary, k=dice.randrange(3, 25)))) for i in range(15)]
    docs = corpus()
    for i in range(150):
        body = (dice.choice(items)[1] or "").split()
        for _ in range(dice.randrange(4)):
            if body:
                body[dice.randrange(len(body))] = dice.choice(vocabulary)
        text = " ".join([*dice.choices(vocabulary, k=dice.randrange(5)), *body, *dice.choices(vocabulary, k=dice.randrange(5))])
        docs.append((100 + i, dice.choice([str, str.lower, str.upper])(text)))
    table = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, docs)
    con = duckdb.connect()
    con.register("documents", df.toArrow()).register("benchmark", table.toArrow())
    want = con.execute(ORACLE_SQL).fetchall()
    got = contaminated(spark, df, table).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60
