"""Small document tables with the awkward cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, digest string, start int"


def documents(spark, rows):
    """rows: (doc_id, text). The other columns hold nulls and names that clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "s", None, 1, "x", None) for i, t in rows], SCHEMA)


def awkward(seed=0, n=60, words=40):
    """Documents with shared passages, copies, near copies, blanks of all kinds, nulls, repeats and periodic text."""
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "日本", "x" * 300]
    passage = [" ".join(dice.choice(vocabulary) for _ in range(30)) for _ in range(4)]
    out = []
    for i in range(n):
        own = [dice.choice(vocabulary) for _ in range(dice.randrange(words))]
        cut = dice.randrange(len(own) + 1)
        text = dice.choice([" ", "\n", "\t ", "\x0b", "\r\n"]).join(own[:cut]) + " " + (dice.choice(passage) if dice.random() < 0.5 else "") + " " + " ".join(own[cut:])
        out.append((i * 3 % n, text))
    out += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a " * 70), (1004, "a b " * 40), (None, passage[0]), (None, passage[0]), (7, passage[1]), (7, passage[1]), (7, passage[2] + " end")]
    out += [(2000 + i, out[3][1]) for i in range(5)] + [(2100 + i, out[5][1].replace("w1", "v1")) for i in range(5)]
    out += [(3000, " ".join(dice.choice(vocabulary) for _ in range(6000)) + passage[3])]
    dice.shuffle(out)
    return out
