"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training texts. The weights are fitted on the driver, by
follow-the-regularised-leader steps with elastic-net penalties, on a bounded sample of the rows of each language
(`sample_rows`); a fifth of that sample is kept aside to fit the temperature. Languages are counted over all
training rows, so a rare one is learned too. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, release, send, shrinking, small_batches, table

BITS = 16
SIZE = 1 << BITS
ORDERS = 3
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _codes(text: str) -> np.ndarray:
    """Lower-case code points; runs of digits, punctuation and blanks become one blank."""
    low = re.sub(r"[\W\d_]+", " ", f" {text} ").lower()
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the text's character 1- to 3-grams that occur, ascending, and how often."""
    code, grams = _codes(text), []
    for n in range(1, min(ORDERS, len(code)) + 1):
        mixed = np.full(len(code) - n + 1, n, dtype=np.uint32)
        for i in range(n):
            mixed = (mixed ^ code[i : len(code) - n + 1 + i]) * _MIX[i]
            mixed ^= mixed >> np.uint32(15)
        grams.append(mixed >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(grams), minlength=SIZE)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by Unicode: digits, fractions and number signs are none."""
    return any(map(str.isalpha, text or ""))


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = ngram_counts(text)
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Ftrl:
    """Follow-the-regularised-leader, one learning rate for each coordinate, L1 and L2 penalties."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros((SIZE + 1, self.classes)), np.zeros((SIZE + 1, self.classes))  # the last row is the bias

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, SIZE), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        more = g * g
        self.z[at] += g - (np.sqrt(self.n[at] + more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += more


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; und and 0 without a letter or a trained model."""
        if not self.langs or not has_letter(text):
            return "und", 0.0
        at, x = tfidf(text, self.idf)
        p = softmax((x @ self.weights[at] + self.weights[SIZE]) / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each bucket; and for each language, with a null bucket, its rows and the least key among them."""
    df, langs = np.zeros(SIZE, dtype=np.int64), {}
    for batch in batches:
        for text, lang, key in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("key").to_pylist(), strict=True):
            if has_letter(t := text.as_py()):
                df[ngram_counts(t)[0]] += 1
                n, least = langs.get(lang, (0, key))
                langs[lang] = n + 1, min(least, key)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({
        "bucket": pa.array([*at.tolist(), *[None] * len(langs)], pa.int32()), "lang": pa.array([*[None] * len(at), *langs], pa.string()),
        "n": pa.array([*df[at].tolist(), *(n for n, _ in langs.values())], pa.int64()), "least": pa.array([*[None] * len(at), *(k for _, k in langs.values())], pa.int64()),
    })


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()  # a repeated row counts once
    for batch in batches:
        rows = []
        for k, lang, t in zip(*(batch.column(c).to_pylist() for c in ("key", "lang", "text")), strict=True):
            if (lang, k) not in seen and has_letter(t):
                seen.add((lang, k))
                rows.append((k, lang, *ngram_counts(t)))
        yield pa.RecordBatch.from_pydict({
            "key": pa.array([r[0] for r in rows], pa.int64()), "lang": pa.array([r[1] for r in rows], pa.string()),
            "at": pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())), "n": pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())),
        })


def train(docs: DataFrame, sample_rows: int = 2000, epochs: int = 4, **penalties) -> Model:
    """Learns from `docs` (doc_id, text, lang), rows with a null lang or no letters aside.

    sample_rows bounds the rows of each language that reach the driver; of more, those with the smallest hash of
    doc_id and text are taken, repeated rows once. Languages and document frequencies are counted over all rows, so every
    language with a usable row is learned. Without usable rows the model says und.
    """
    key = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 40))
    known = docs.where("lang is not null and text is not null").select("text", "lang", key.alias("key"))
    spark = docs.sparkSession
    with small_batches(spark):
        counts = known.mapInArrow(shrinking(_frequency_batches), "bucket int, lang string, n long, least long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"), F.min("least").alias("least")).collect()
    sizes = {r.lang: r for r in counts if r.bucket is None}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(SIZE), np.zeros((SIZE + 1, 0)), 1.0)
    df, total = np.zeros(SIZE), sum(r.n for r in sizes.values())
    for r in counts:
        if r.bucket is not None:
            df[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    below = spark.createDataFrame([(k, max(int((1 << 40) * min(1.0, sample_rows / r.n)), r.least + 1)) for k, r in sizes.items()], "lang string, below long")
    picked = known.join(F.broadcast(below), "lang").where("key < below").select("key", "lang", "text")  # one small row for each language
    with small_batches(spark):
        rows = picked.mapInArrow(shrinking(_sample_batches), "key long, lang string, at array<int>, n array<int>").toArrow()
    keys, named = rows["key"].to_pylist(), rows["lang"].to_pylist()
    order, rank, taken = [], [], {}
    for i in sorted(range(len(keys)), key=lambda i: (named[i], keys[i])):
        n, before = taken.get(named[i], (0, None))
        if n < sample_rows and keys[i] != before:
            taken[named[i]] = n + 1, keys[i]
            order.append(i), rank.append(n)
    labels = [named[i] for i in order]

    def vector(i) -> tuple[np.ndarray, np.ndarray]:
        at, n = (np.asarray(rows[c][int(i)].values) for c in ("at", "n"))
        x = (1 + np.log(n)) * idf[at]
        return at, x / np.sqrt(x @ x)

    xs, ys = [vector(i) for i in order], [langs.index(x) for x in labels]
    aside = [i for i, n in enumerate(rank) if n % 5 == 4]
    fit = [i for i, n in enumerate(rank) if n % 5 != 4]
    learner, dice = Ftrl(len(langs), **penalties), np.random.default_rng(7)
    for _ in range(epochs):
        for i in dice.permutation(fit):
            learner.step(*xs[i], ys[i])
    w = learner.weights(slice(None))
    logits = np.array([x @ w[at] + w[SIZE] for at, x in (xs[i] for i in aside)]).reshape(len(aside), len(langs))
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(aside)), [ys[i] for i in aside]], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 5, 60), key=loss) if aside else 1.0
    del rows, xs, learner
    release()
    return Model(langs, idf, w, float(temperature))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of `docs`, then lang_pred and score, for every whole text.

    Null, empty and letterless texts give und and 0. Equal texts get equal answers; of a tie the language
    first in the alphabet. Other columns of `docs` take no part.
    """
    sent = send(docs.sparkSession, model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch in it:
            got = [own.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=names)

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_" + max(["read", *keep], key=len)))  # a name that is no other column's
    names = [*keep, "lang_pred", "score"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(shrinking(batches), f"{kinds}, lang_pred string, score double")


def accepted_rows(docs: DataFrame, model: Model, least_score: float = 0.5, langs: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of `docs`, with all columns, whose text is in one of `langs` (any learned language if None) with at least `least_score`.

    Texts that get und are rejected. A model that has learned no language rejects nothing.
    """
    if not model.langs:
        return docs
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("text"))
    judged = predict(plain, model, tuple(plain.columns[:-1]))
    good = judged.where(F.col("lang_pred").isin(list(langs or model.langs)) & (F.col("score") >= least_score))
    return good.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
