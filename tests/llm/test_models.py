import random

import numpy as np
from corpus import documents
from pyspark.sql import functions as F

from eventlake.llm import language_id, toxicity

WORDS = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["größe", "straße", "müßig"], "cc": ["日本", "東京", "大阪"]}


def labelled(spark, n=240):
    dice = random.Random(1)
    rows = [(i, " ".join(dice.choices(WORDS[k], k=dice.randrange(3, 30))), k if i % 9 else None, "s", None) for i, k in ((i, "aabbcc"[i % 3 * 2 :][:2]) for i in range(n))]
    rows += [(9001, None, "aa", "s", None), (9002, "", "aa", "s", None), (9003, "123 !!", "bb", "s", None), (None, "lorem ipsum", None, "s", None), (9004, "lorem " * 30000, None, "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


def test_learns_languages(spark):
    docs = labelled(spark)
    model = language_id.train(docs)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "aabbcc"[i % 3 * 2 :][:2] and 0.5 < got[i].score <= 1 for i in range(240))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert got[None].lang_pred == got[9004].lang_pred == "aa"
    kept = language_id.accepted_rows(docs, model)
    assert kept.columns == docs.columns and kept.count() == 242


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    model = language_id.train(docs)
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"und"}
    assert language_id.accepted_rows(docs, model).count() == 2
    assert language_id.predict(documents(spark, []), model).collect() == []


def test_elastic_net_makes_weights_sparse():
    learner, dice = language_id.Ftrl(2, l1=1.0), np.random.default_rng(0)
    for _ in range(300):
        label = int(dice.integers(2))
        learner.step(np.array([label, 2 + int(dice.integers(50))]), np.ones(2), label)
    w = learner.weights(slice(0, 60))
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and (w[2:] == 0).mean() > 0.5


def toxic_docs(n=400):
    dice = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        sentences = [dice.choices(plain, k=8) for _ in range(dice.randrange(1, 12))]
        if i % 4 == 0:
            dice.choice(sentences)[3] = dice.choice(["vileword", "stinkend", "stinker"])
        out.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(i % 4 == 0)))
    return out


def test_learns_from_document_labels_and_finds_sentences(spark):
    rows = toxic_docs()
    docs = documents(spark, [r[:2] for r in rows] + [(9001, None), (9002, ""), (9003, "..."), (9004, "word1 " * 50000 + ". vileword stinker"), (None, "vileword word1")])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows[:300]] + [(None, 1, 0), (5, None, 0), (9001, 0, 0), (7, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = rows[300:]
    assert sum(got[i].predicted == y for i, _, y in unseen) >= 0.95 * len(unseen)
    assert got[9001].score == got[9002].score == got[9003].score == 0.0 and got[9004].predicted == 1 and got[None].predicted == 1
    hits = toxicity.offending_sentences(docs.where("doc_id = 0"), model).collect()
    guilty = [k for k, s in enumerate(rows[0][1].split(".")) if any(w in s for w in ("vileword", "stink"))]
    assert [r.sentence for r in hits] == guilty == [got[0].worst_sentence] and got[1].worst_sentence is None


def test_noisy_or_is_one_minus_the_product():
    model = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.SIZE), -1.0)
    _, z = model.sentences("one two. three! four five\nsix")
    assert len(z) == 4 and np.isclose(model.score("one two. three! four five\nsix")[0], 1 - np.prod(1 - 1 / (1 + np.exp(-z))))


def test_one_label_only(spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(documents(spark, [(1, "x")]), toxicity.train(documents(spark, [(1, "x")]), labels)).collect()] == [0]


def test_learns_rare_languages(spark):
    common = [(i, f"lorem ipsum dolor {'sit ' * (i % 7)}", "aa") for i in range(300)] + [(None, f"größe straße {'x' * i}", "bb") for i in range(60)]
    docs = spark.createDataFrame(common + [(9000, "日本 東京", "cc"), (9001, "日本 大阪 東京", "cc"), (9002, "12", "dd")], "doc_id long, text string, lang string")
    model = language_id.train(docs, sample_rows=20)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs.where("lang != 'bb'"), model).collect()}
    assert got[9000] == got[9001] == "cc" and got[5] == "aa"


def test_letters_are_letters():
    assert not any(map(language_id.has_letter, ["\u00b2\u00bd \u2167 12", "", None, "_-_ 4"])) and language_id.has_letter("12 \u00e9")


def test_columns_may_have_any_name(spark):
    docs = labelled(spark).withColumn("_read", F.lit(3)).withColumn("_", F.lit(4))
    model = language_id.train(docs)
    assert language_id.accepted_rows(docs, model).columns == docs.columns
    assert language_id.predict(docs, model, ("doc_id", "_read", "_")).where("_read = 3 and _ = 4").count() == docs.count()


def test_steps_match_the_rule_coordinate_by_coordinate():
    learner, dice = language_id.Ftrl(3, l1=0.05, l2=0.1), np.random.default_rng(3)
    z, n, size = {}, {}, language_id.SIZE

    def weight(i, k):
        held = z.get((i, k), 0.0)
        return 0.0 if abs(held) <= 0.05 else -(held - np.sign(held) * 0.05) / ((1.0 + n[i, k] ** 0.5) / 0.5 + 0.1)

    for _ in range(40):
        at, x, label = np.sort(dice.choice(12, 4, replace=False)), dice.random(4), int(dice.integers(3))
        both = [*zip(at.tolist(), x.tolist(), strict=True), (size, 1.0)]
        scores = [sum(v * weight(i, k) for i, v in both) for k in range(3)]
        p = np.exp(scores) / np.exp(scores).sum()
        for i, v in both:
            for k in range(3):
                g, w, before = v * (p[k] - (k == label)), weight(i, k), n.get((i, k), 0.0)
                z[i, k] = z.get((i, k), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / 0.5 * w
                n[i, k] = before + g * g
        learner.step(at, x, label)
    assert np.allclose(learner.weights(np.arange(12)), [[weight(i, k) if (i, k) in n else 0.0 for k in range(3)] for i in range(12)])


def test_first_step_follows_the_numerical_gradient():
    at, of = np.array([3, 4, 5, 6]), np.array([0, 0, 1, 2])
    for label in (0, 1):
        def loss(w, label=label):
            z = np.array([w[0] + w[1], w[2], w[3]]) - 5
            clean = np.prod(1 / (1 + np.exp(z)))
            return -np.log(1 - clean if label else clean)

        slope = np.array([(loss(np.eye(4)[i] * 1e-5) - loss(np.eye(4)[i] * -1e-5)) / 2e-5 for i in range(4)])
        got = toxicity.fit([(at, of)], np.array([label]), epochs=1, l2=0.0, min_bags=1).weights[at]
        assert np.allclose(got, -0.1 * slope / np.sqrt(1e-2 + slope**2), atol=1e-4)


def test_shared_ids_and_ideographic_sentences(spark):
    rows = toxic_docs(60)
    docs = documents(spark, [r[:2] for r in rows for _ in range(3)] + [(0, f"word{i}") for i in range(50)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).weights.any()
    assert len(toxicity.Model(np.zeros(toxicity.SIZE), 0.0).sentences("\u65e5\u672c\u3002\u6771\u4eac\uff01\u5927\u962a \u2603")[0]) == 3
