"""Substring deduplication on word windows with a count-min prefilter.

First pass: each partition counts anchors in a sketch, and the sketches are merged. The anchor of a window
is the one of its 8-word grams with the least hash; equal windows have equal anchors, so the estimate of
an anchor is at least the count of each of its windows. Second pass: only windows whose estimate is two or
more are grouped, exactly, by 96 bits of hash. The sketch can overestimate, which costs time, and never
underestimates, so no repeated window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import U, WordHasher, anchors, raw_text
from .shared import NO_ID, table, text_slices
from .sketch import Sketch, build

_GRAM = 8
#: Windows that a task holds at a time before it groups them and passes them on.
_HELD = 500_000
_ROWS = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc_id", pa.int64()), ("spot", pa.int64()), ("run", pa.int32())])


def _windows(batch: pa.RecordBatch, hasher: WordHasher, size: int):
    """For slices of a batch: first row, word hashes, each word's text, window starts, and their anchors' places and hashes."""
    gram = min(_GRAM, size)
    data, offsets = raw_text(batch.column("text"))
    for begin, end in text_slices(batch, "text"):
        part = offsets[begin : end + 1]
        words, text = hasher.words(data[part[0] : part[-1]], part)
        if len(words) < size:
            continue
        starts = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :])
        if len(starts):
            place, key = anchors(hasher.lane(words, 0).all_of(gram), size - gram + 1)
            yield begin, words, text, starts, place[starts], key[starts]


def _candidates(size: int, sent):
    """Of each task's windows that may repeat: the first of each (run 0), and as runs of starts those that come after it."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, spot = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((spot, doc, h2, h1))
        h1, h2, doc, spot = h1[order], h2[order], doc[order], spot[order]
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        after = (doc != doc[first]) | (spot != spot[first])
        order = np.lexsort((spot[after], doc[after]))
        later_doc, later = doc[after][order], spot[after][order]
        once = np.ones(len(later), dtype=bool)
        once[1:] = (later[1:] != later[:-1]) | (later_doc[1:] != later_doc[:-1])
        later_doc, later = later_doc[once], later[once]
        head = np.ones(len(later), dtype=bool)
        head[1:] = (later[1:] != later[:-1] + 1) | (later_doc[1:] != later_doc[:-1])
        heads = np.flatnonzero(head)
        run = np.diff(np.append(heads, len(later))).astype(np.int32)
        anyhow = (later[heads] + later_doc[heads]) * np.int64(-7046029254386353131)  # runs are dealt out evenly
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (
            (h1[new], anyhow), (h2[new], np.zeros(len(heads), np.int32)), (doc[new], later_doc[heads]), (spot[new], later[heads]), (np.zeros(int(new.sum()), np.int32), run),
        )], schema=_ROWS)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch, held, n = WordHasher(), sent(), [], 0
        for batch in it:
            doc_ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for begin, words, text, starts, _, key in _windows(batch, hasher, size):
                often = sketch.repeated(key)
                starts = starts[often]
                if not len(starts):
                    continue
                first = np.searchsorted(text, text[starts])  # each text's first word
                h1, h2 = (hasher.lane(words, i).of(starts, starts + size) for i in (0, 1))
                row = begin + text[starts]
                held.append((h1.view(np.int64), (h2 >> U(32)).astype(np.uint32).view(np.int32), doc_ids[row], (marks[row] << 32) | (starts - first)))
                n += len(starts)
                if n >= _HELD:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return batches


def repeated_windows(spark: SparkSession, docs: DataFrame, size: int = 20, sketch_bits: int = 26) -> DataFrame:
    """(doc_id, spot, run): `run` windows that also start earlier, from the word on that the low 32 bits of spot number; its high bits are mark.

    docs: doc_id, mark (long, of 31 bits), text; none null but text.
    """
    gram = min(_GRAM, size)

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        hasher = WordHasher()
        for batch in it:
            for _, _, _, _, place, key in _windows(batch, hasher, size):
                once = np.ones(len(place), dtype=bool)
                once[1:] = place[1:] != place[:-1]
                yield key[once]

    assert gram > 0
    sent = build(docs.select("text"), keys, lambda: Sketch(sketch_bits), 4 * spark.sparkContext.defaultParallelism)  # 2^sketch_bits / 2 bytes at any size of the input
    found = docs.mapInArrow(_candidates(size, sent), "h1 long, h2 int, doc_id long, spot long, run int")
    rank = F.rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "spot"))
    return found.withColumn("rank", rank).where("run > 0 or rank > 1").select("doc_id", "spot", F.greatest("run", F.lit(1)).alias("run"))


def _cut(size: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.large_binary())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for begin, end in text_slices(batch, "text"):
                part, out = batch.slice(begin, end - begin), []
                for text, runs in zip(part.column("text"), part.column("runs"), strict=True):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    kept = words
                    if runs.is_valid:
                        packed = runs.values.to_numpy()
                        start, run = packed >> 32, packed & 0xFFFFFFFF
                        turn = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + run + size - 1, minlength=len(words) + 1)
                        kept = list(compress(words, np.cumsum(turn)[: len(words)] == 0))
                    out.append((len(words), len(words) - len(kept), b" ".join(kept)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in out], kind.types[i + 1]) for i in range(3))], schema=kind).cast(pa.schema([*list(kind)[:3], ("kept", pa.binary())]))

    return batches


def remove_repeats(spark: SparkSession, docs: DataFrame, size: int = 20, sketch_bits: int = 26) -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 bytes) for each row of `docs` (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Each word is removed that is covered by a window of `size` words whose
    words also start earlier: at a smaller doc_id, or earlier in the same document. Windows never cross
    documents. Null and empty texts have no words; texts with fewer words than a window stay whole. A
    missing doc_id comes before any other. Rows that share a doc_id are ordered by a hash of their text;
    repeated rows (same doc_id and text) count as one document and get the same answer. Texts are read
    whole. An empty table gives an empty result; other columns don't matter.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("mark"), "text")
    found = repeated_windows(spark, rows, size, sketch_bits)
    packed = F.shiftleft("spot", 32).bitwiseOR(F.col("run").cast("long"))
    runs = found.groupBy("doc_id", F.shiftright("spot", 32).alias("mark")).agg(F.collect_list(packed).alias("runs"))
    both = rows.join(runs, ["doc_id", "mark"], "left").select("doc_id", "text", "runs")
    return both.mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept binary").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS turn FROM win) WHERE turn > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS p FROM again)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (
  SELECT w.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS body
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
