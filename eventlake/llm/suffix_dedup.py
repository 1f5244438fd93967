"""Suffix-array deduplication of byte strings.

A string of `size` bytes is repeated if it also starts anywhere else. Each such window has an anchor: of its
grams of `core` bytes the one with the least hash. Equal windows have equal anchors at the same place, so only
places with the same anchor need to be compared. The windows of one anchor make a unit: the anchor's core
with what stands on its left and right.

1. Anchors are counted in a merged count-min sketch, which never underestimates; those seen once are dropped.
2. Each task writes the units of the others by hash, the local copies of a unit as one row with a count. Units
   seen twice as a whole are repeated.
3. Anchors that have several different units go into a second sketch, by which a third pass picks their bytes.
   The units of an anchor are joined, with the core as one symbol, and their suffixes sorted by Lyndon
   groups (suffix_groups); equal windows are then neighbours.
4. An anchor with more than `most_units` different units (a line that many documents share) isn't brought
   together in one task: its windows are grouped exactly by 128 bits of hash, local copies first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import Powers, Sums, U, anchors, mix, raw_text
from .shared import NO_ID, table, text_slices, written
from .sketch import Sketch, build
from .suffix_groups import suffix_array

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: Units, and windows, that a task holds at a time before it brings copies together.
_HELD_UNITS, _HELD_WINDOWS = 200_000, 1_000_000
_RUN = pa.schema([("doc_id", pa.int64()), ("spot", pa.int64()), ("run", pa.int32())])
_RUN_SQL = "doc_id long, spot long, run int"
_UNIT = pa.schema([("h", pa.int64()), ("u", pa.int64()), *_RUN, ("n", pa.int32())])
_UNIT_SQL = f"h long, u long, {_RUN_SQL}, n int"


class _Reader:
    """Finds windows and anchors in slices of a batch."""

    def __init__(self, size: int, core: int):
        self.size, self.core, self.powers = size, core, [Powers(b) for b in _BASES]

    def slices(self, batch: pa.RecordBatch):
        """First row, bytes, each text's begin, window starts, their anchors' places and 32 bits of hash, and the prefix sums."""
        data, offsets = raw_text(batch.column("text"))
        for begin, end in text_slices(batch, "text"):
            at = offsets[begin : end + 1] - offsets[begin]
            body = data[offsets[begin] : offsets[end]]
            if len(body) < self.size:
                continue
            inside = np.zeros(len(body) + 1, dtype=np.int8)
            long = at[1:] - at[:-1] >= self.size
            np.add.at(inside, at[:-1][long], 1)
            np.add.at(inside, at[1:][long] - self.size + 1, -1)
            starts = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
            if len(starts):
                sums = Sums(body.astype(U) + U(1), self.powers[0])
                place, key = anchors(sums.all_of(self.core), self.size - self.core + 1)
                yield begin, body, at, starts, place[starts], key[starts], sums


def _heads(place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    return np.flatnonzero(new)


def _units(size: int, core: int, sent, by_anchor: bool):
    """The units whose anchor the sketch shows to be repeated: by its 32 bits, or else by its h, and then with their bytes.

    Of the copies of a unit that a task holds the first has their number as n, the others 0; only the first goes on with its bytes.
    """

    def flush(held: list[tuple], bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, u, doc, spot, run, left = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((u, h))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (u[order][1:] != u[order][:-1])
        at = np.flatnonzero(new)
        n = np.zeros(len(order), dtype=np.int32)
        n[order[at]] = np.diff(np.append(at, len(order)))
        rows = [pa.array(x) for x in (h, u, doc, spot, run, n)]
        if by_anchor:
            yield pa.RecordBatch.from_arrays(rows, schema=_UNIT)
        else:
            yield pa.RecordBatch.from_arrays([*rows, pa.array(left), pa.array(bodies, pa.binary())], schema=pa.schema([*_UNIT, ("left", pa.int32()), ("body", pa.binary())])).filter(pa.array(n > 0))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sketch, held, bodies, count = _Reader(size, core), sent(), [], [], 0
        for batch in it:
            docs, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for begin, data, at, starts, place, key, sums in reader.slices(batch):
                heads = _heads(place, starts)
                a = place[heads]
                h = mix(Sums(data.astype(U) + U(1), reader.powers[1]).of(a, a + core))
                often = sketch.repeated(key[heads] if by_anchor else h)
                s, e, a, h = starts[heads][often], starts[np.append(heads[1:], len(starts)) - 1][often], a[often], h[often]
                if not len(s):
                    continue
                u = mix(sums.of(s, e + size) + mix(((a - s).astype(U) << U(32)) | (e - s).astype(U)))
                row = np.searchsorted(at, s, side="right") - 1
                held.append((h.view(np.int64), u.view(np.int64), docs[begin + row], (marks[begin + row] << 32) | (s - at[row]), (e - s + 1).astype(np.int32), (a - s).astype(np.int32)))
                if not by_anchor:
                    raw = data.tobytes()
                    bodies += [raw[i:j] + raw[j + core : k + size] for i, j, k in zip(s.tolist(), a.tolist(), e.tolist(), strict=True)]
                count += len(s)
                if count >= _HELD_UNITS:
                    yield from flush(held, bodies)
                    held, bodies, count = [], [], 0
        if held:
            yield from flush(held, bodies)

    return batches


def repeated_starts(units: list[tuple[bytes, int, int]], span: int) -> list[list[int]]:
    """For each unit (its bytes without the core, how many are left of it, how many windows it has) the windows that another place holds too.

    A window is `span` bytes beside its core. All units share the core; equal units must not be given twice.
    """
    text: list[int] = []
    where: list[tuple[int, int]] = []
    for i, (body, left, windows) in enumerate(units):
        where += [(i, k) if k < windows else (-1, 0) for k in range(len(body) + 2)]
        text += [b + 3 for b in body[:left]]
        text.append(2)
        text += [b + 3 for b in body[left:]]
        text.append(1)
    where.append((-1, 0))
    text.append(0)
    out: list[list[int]] = [[] for _ in units]
    before, held = None, (-1, 0)
    for s in suffix_array(text):
        i, k = where[s]
        if i < 0:
            continue
        window = text[s : s + span + 1]
        if window == before:
            if held is not None:
                out[held[0]].append(held[1])
                held = None
            out[i].append(k)
        else:
            before, held = window, (i, k)
    return out


def _runs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RUN, strict=True)], schema=_RUN)


def _sorted_buckets(span: int):
    """Rows come sorted by h and u, all of an anchor in one task."""

    def solve(bucket: dict[int, list]) -> list[tuple[int, int, int]]:
        if len(bucket) < 2:
            return []
        found = repeated_starts([(body, left, run) for _, body, left, run, _, _ in bucket.values()], span)
        return [(doc, spot + k, 1) for (n, _, _, _, doc, spot), hits in zip(bucket.values(), found, strict=True) if n == 1 for k in hits]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bucket, out = None, {}, []
        for batch in it:
            for h, u, doc, spot, run, n, left, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != of:
                    out += solve(bucket)
                    of, bucket = h, {}
                if u in bucket:
                    bucket[u][0] += n
                else:
                    bucket[u] = [n, body, left, run, doc, spot]
                if len(out) > 50_000:
                    yield _runs(out)
                    out = []
        yield _runs(out + solve(bucket))

    return batches


def _window_rows(span: int):
    """The windows of each unit by hash: the first copy that a task holds (n: copies), and runs (n = 0) of copies."""
    kind = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), *_RUN, ("n", pa.int32())])

    def flush(held) -> Iterator[pa.RecordBatch]:
        w1, w2, doc, spot, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((w2, w1))
        w1, w2, doc, spot, n = (x[order] for x in (w1, w2, doc, spot, n))
        new = np.ones(len(w1), dtype=bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        total = np.add.reduceat(n, np.flatnonzero(new))
        n = np.zeros(len(w1), dtype=np.int32)
        n[new] = np.minimum(total, 2**30)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, doc, spot, np.ones(len(w1), np.int32), n)], schema=kind)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, count = [Powers(b) for b in _BASES[1:]], [], 0
        for batch in it:
            for h, doc, spot, run, n, left, body in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "spot", "run", "n", "left", "body")), strict=True):
                code = np.frombuffer(body, dtype=np.uint8).astype(U) + U(1)
                place = mix(np.arange(left, left - run, -1).astype(np.int64).astype(U))  # of the core within the window
                lanes = [mix(Sums(code, p).all_of(span)[:run] + place + U(h & (2**64 - 1))).view(np.int64) for p in powers]
                held.append((*lanes, np.full(run, doc), spot + np.arange(run), np.full(run, n, dtype=np.int64)))
                count += run
                if count >= _HELD_WINDOWS:
                    yield from flush(held)
                    held, count = [], 0
        if held:
            yield from flush(held)

    return batches


def repeated_runs(spark: SparkSession, docs: DataFrame, size: int = 400, core: int | None = None, most_units: int = 2000, sketch_bits: int = 26) -> DataFrame:
    """(doc_id, spot, run): `run` windows of `size` bytes that also start elsewhere, from the byte on that the low 32 bits of spot number; its high bits are mark.

    docs: doc_id, mark (long, of 31 bits), text; none null but text.
    """
    core = core or size * 16 // 25
    span = size - core

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        reader = _Reader(size, core)
        for batch in it:
            for _, _, _, starts, place, key, _ in reader.slices(batch):
                yield key[_heads(place, starts)]

    def twice(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in it:
            yield np.repeat(batch.column("h").to_numpy().view(U), 2)

    tasks, empty = 4 * spark.sparkContext.defaultParallelism, lambda: Sketch(sketch_bits)
    seen = build(docs.select("text"), keys, empty, tasks)  # 2^sketch_bits / 2 bytes at any size of the input
    units = written(spark, docs.mapInArrow(_units(size, core, seen, True), _UNIT_SQL), "units")
    own = units.where("n > 0")
    several = written(spark, own.select("h", "u").distinct().groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "several")
    whole = own.withColumn("total", F.sum("n").over(Window.partitionBy("h", "u"))).where("total > 1").select(*_RUN.names)
    copies = units.where("n = 0").select(*_RUN.names)
    open_ = build(several.select("h"), twice, lambda: Sketch(max(10, sketch_bits - 2)), tasks)
    shared = docs.mapInArrow(_units(size, core, open_, False), f"{_UNIT_SQL}, left int, body binary").join(several, "h")
    shared = written(spark, shared.select("m", *_UNIT.names, "left", "body"), "shared")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as a number: by size alone too few tasks would sort
    few = shared.where(F.col("m") <= most_units).drop("m").repartition(n_parts, "h").sortWithinPartitions("h", "u").mapInArrow(_sorted_buckets(span), _RUN_SQL)
    many = shared.where(F.col("m") > most_units).drop("m").mapInArrow(_window_rows(span), f"w1 long, w2 long, {_RUN_SQL}, n int")
    many = many.withColumn("total", F.sum("n").over(Window.partitionBy("w1", "w2")))  # a task has one row of n > 0 for each window
    again = many.where("n = 0 or total > 1").select(*_RUN.names)
    return whole.unionByName(copies).unionByName(few).unionByName(again)


def _cut(size: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for begin, end in text_slices(batch, "text"):
                part, out = batch.slice(begin, end - begin), []
                for text, starts, runs in zip(part.column("text"), part.column("starts"), part.column("runs"), strict=True):
                    body = text.as_buffer().to_pybytes() if text.is_valid else b""
                    if not starts.is_valid:
                        out.append((len(body), 0, 0, body))
                        continue
                    start, run = starts.values.to_numpy(), runs.values.to_numpy()
                    turn = np.bincount(start, minlength=len(body) + 1) - np.bincount(start + run + size - 1, minlength=len(body) + 1)
                    gone = np.cumsum(turn)[: len(body)] > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((len(body), int(gone.sum()), spans, np.frombuffer(body, np.uint8)[~gone].tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in out], kind.types[i + 1]) for i in range(4))], schema=kind)

    return batches


def remove_repeats(spark: SparkSession, docs: DataFrame, size: int = 400, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for each row of `docs` (doc_id, text).

    Each byte of a text's UTF-8 form is removed that is covered by a string of `size` bytes that also starts anywhere
    else, in the same document or another; strings never cross documents. Null and empty texts have no
    bytes; shorter texts stay whole. A missing doc_id is an id like any other. Each row is a document, so of
    repeated rows and rows that share an id each counts as another place. Texts are read whole. An empty table gives
    an empty result; other columns don't matter.
    """
    # rows that share an id and a text get the same cuts: the runs of either hold for both
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("mark"), "text")
    found = repeated_runs(spark, rows, size, **how)
    packed = F.struct((F.col("spot").bitwiseAND(F.lit(2**32 - 1))).alias("start"), "run")
    runs = found.groupBy("doc_id", F.shiftright("spot", 32).alias("mark")).agg(F.collect_list(packed).alias("r")).select("doc_id", "mark", F.col("r.start").alias("starts"), F.col("r.run").alias("runs"))
    both = rows.join(runs, ["doc_id", "mark"], "left").select("doc_id", "text", "starts", "runs")
    return both.mapInArrow(_cut(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT r, CAST(s AS BIGINT) AS s, md5_number(hex(b[s:s + 399])) AS h FROM docs, unnest(range(1, n - 398)) AS t(s)),
repeated AS (SELECT r, s FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM repeated),
numbered AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS run FROM marked),
runs AS (SELECT r, min(s) AS low, max(s) + 399 AS high FROM numbered GROUP BY r, run),
placed AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM runs),
pieces AS (
  SELECT r, string_agg(CASE WHEN low > before + 1 THEN hex(b[before + 1:low - 1]) ELSE '' END, '' ORDER BY low) AS head, max(high) AS last, sum(high - low + 1) AS n_removed, count(*) AS n_spans
  FROM placed JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || CASE WHEN n > coalesce(last, 0) THEN hex(b[coalesce(last, 0) + 1:n]) ELSE '' END)) AS kept_sha256
FROM docs LEFT JOIN pieces USING (r)
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
