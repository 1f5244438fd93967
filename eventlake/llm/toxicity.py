"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of the summed weights of its hashed
words and word stems; the document's is their noisy-or, 1 - prod(1 - score). Weights are learnt from
document labels alone, on a bounded sample of labelled rows, and then locate the sentences that offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, send, small_batches, table

BITS = 18
SIZE = 1 << BITS
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
#: Full stops, exclamation and question marks, also the ideographic ones, and line ends.
_STOPS = np.array([ord(c) for c in ".!?\n\u3002\uff01\uff1f"])
_ODD, _STEP = np.uint32(0x9E3779B1), np.uint32(0x01000193)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words and of the first 4 and 5 letters of longer ones, and each one's sentence number.

    Sentences end at `.`, `!`, `?`, their ideographic forms or a line end; words are runs of letters, lower-cased. Repeats of a
    bucket in a sentence count once. A text without words has none.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _LETTER[code]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sentence = np.cumsum(np.isin(code, _STOPS))[begin]
    size = end - begin
    hashed, out, of = np.full(len(begin), 0x811C9DC5, np.uint32), [], []
    live = np.arange(len(begin))
    for i in range(int(size.max())):
        live = live[size[live] > i]
        hashed[live] = (hashed[live] ^ code[begin[live] + i]) * _STEP
        if i in (3, 4):
            longer = live[size[live] > i + 1]
            out.append(_bucket(hashed[longer], i)), of.append(sentence[longer])
    out.append(_bucket(hashed, 0)), of.append(sentence)
    both = np.unique((np.concatenate(of).astype(np.int64) << BITS) | np.concatenate(out))
    return both & (SIZE - 1), both >> BITS


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15)) ^ np.uint32(kind * 0x3D4D51CB)) * _ODD
    return ((h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the sentences that have words, and the log-odds of each."""
        at, of = features(text or "")
        numbers, inverse = np.unique(of, return_inverse=True)
        return numbers, np.bincount(inverse, self.weights[at], minlength=len(numbers)) + self.bias

    def score(self, text: str | None) -> tuple[float, int | None]:
        """Noisy-or over the sentences, and the number of the one that offends most; without words 0 and none."""
        numbers, z = self.sentences(text)
        return float(-np.expm1(-np.logaddexp(0, z).sum())), int(numbers[z.argmax()]) if len(z) else None


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, l2: float = 1e-3, min_bags: int = 5, seed: int = 7) -> Model:
    """Adaptive gradient steps on the noisy-or likelihood of document labels; buckets of fewer than `min_bags` bags get no weight."""
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(at) for at, _ in bags)]), minlength=SIZE)
    bags = [(at[often], of[often]) for at, of in bags for often in [seen[at] >= min_bags]]
    w, squares, bias, bias_sq = np.zeros(SIZE), np.full(SIZE, 1e-2), -5.0, 1e-2
    dice = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in dice.permutation(len(bags)):
            at, of = bags[i]
            if not len(at):
                continue
            numbers, inverse = np.unique(of, return_inverse=True)
            z = np.bincount(inverse, w[at], minlength=len(numbers)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(-np.logaddexp(0, z).sum())  # chance that no sentence offends
            g = p if not labels[i] else -p * clean / max(1 - clean, 1e-9)
            step = g[inverse] + l2 * w[at]
            squares[at] += step * step
            np.subtract.at(w, at, rate * step / np.sqrt(squares[at]))
            bias_sq += (all_of := g.sum()) * all_of
            bias -= 0.05 * all_of / np.sqrt(bias_sq)
    return Model(w, bias)


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [features(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([
            batch.column("key"), batch.column("label"), pa.array([b[0].astype(np.int32) for b in bags], pa.list_(pa.int32())), pa.array([b[1].astype(np.int32) for b in bags], pa.list_(pa.int32())),
        ], names=["key", "label", "at", "of"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 5000, **how) -> Model:
    """Learns from documents (doc_id, text) and labels (doc_id, toxic); rows with a null in any of these are left out.

    sample_rows bounds the documents of each label that reach the driver; of more, those with the smallest hash
    of their doc_id are taken. Repeated label rows count as one, the higher label first; of rows that share a doc_id the
    text first in order is learned from. Without usable rows,
    or with one label only, everything scores near 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    key = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40))
    share = [F.when(F.col("label") == k, F.lit(int((1 << 40) * min(1.0, sample_rows / n)))) for k, n in counts.items()]
    if len(share) < 2:
        return Model(np.zeros(SIZE), -8.0)
    picked = known.withColumn("key", key).where(F.col("key") < F.coalesce(*share))
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("key", "label", "text")  # bounded by sample_rows
    found = found.groupBy("key", "label").agg(F.min("text").alias("text"))
    with small_batches(docs.sparkSession):
        rows = found.mapInArrow(_bag_batches, "key long, label int, at array<int>, of array<int>").toArrow().sort_by([("label", "ascending"), ("key", "ascending")])
    bags = [(np.asarray(rows["at"][i].values), np.asarray(rows["of"][i].values)) for i in range(len(rows))]
    return fit(bags, rows["label"].to_numpy(), **how)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted and worst_sentence for every whole text; null, empty and wordless texts score 0.

    worst_sentence is, of a text that reaches the threshold, the number of the sentence that offends most (its count of sentence ends before it), else null.
    """
    sent = send(docs.sparkSession, model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch in it:
            got = [own.score(t.as_py()) for t in batch.column("text")]
            worst = [w if p >= threshold else None for p, w in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([p for p, _ in got], pa.float64()), pa.array([int(p >= threshold) for p, _ in got], pa.int32()), pa.array(worst, pa.int64())],
                names=["doc_id", "score", "predicted", "worst_sentence"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, score double, predicted int, worst_sentence long")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, sentence (0-based count of sentence ends before it), score, for sentences that reach the threshold."""
    sent = send(docs.sparkSession, model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch in it:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                numbers, z = own.sentences(text)
                p = 1 / (1 + np.exp(-z))
                rows += [(doc_id, int(n), float(x)) for n, x in zip(numbers, p, strict=True) if x >= threshold]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "sentence": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, sentence long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst_sentence")
