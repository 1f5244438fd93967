"""Near-duplicate groups: an exact Jaccard join on word shingles.

1. Document frequencies of all shingles go to a merged sketch. A shingle that it shows once has no partner;
   a document with too few others can't reach the threshold and is done.
2. Documents with equal sets become one class.
3. A class is posted under its prefix: its rarest shingles, as many as must hold one that it shares with any
   partner. Postings carry the set's size and the shingle's position for the length and positional filters.
4. A star join pairs each class with one other of its prefix, the one with the fewest shingles of its own: of a
   group of near copies that is the text they were made from, so one pair a class gathers most of the group.
5. All other pairs of postings that aren't known to be connected follow, so no link between components is
   lost, and a group of copies doesn't yield all its pairs.
6. Pairs are made distinct, pass a bitmap of each set's hashes (bits that only one of two sets has bound what they
   share) and the suffix filter, and are verified once on the full sets. Connected components give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .hashing import U, WordHasher, mix, raw_text
from .shared import NO_ID, bucketed, discard, fresh, shrinking, table, text_slices, written
from .sketch import RaritySketch, build

#: Longs of a set's bitmap.
_LONGS = 8
_BITS = [f"b{i}" for i in range(_LONGS)]


def shingle_sets(batch: pa.RecordBatch, hasher: WordHasher, size: int):
    """For slices of a batch: first row, row count, the distinct shingles' hashes by row and then value, and each one's row in the slice."""
    data, offsets = raw_text(batch.column("text"))
    for begin, end in text_slices(batch, "text"):
        at = offsets[begin : end + 1]
        words, row = hasher.words(data[at[0] : at[-1]], at, lower=True)
        n = np.bincount(row, minlength=end - begin)
        sums = hasher.lane(words, 0)
        starts = np.flatnonzero(row[: max(0, len(row) - size + 1)] == row[size - 1 :])
        short = np.flatnonzero((n > 0) & (n < size))
        first = np.searchsorted(row, short)
        h = np.concatenate([mix(sums.of(starts, starts + size) + U(size)), mix(sums.of(first, first + n[short]) + n[short].astype(U))])
        row = np.concatenate([row[starts], short])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield begin, end - begin, h[new], row[new]


def least_overlap(n):
    """What a set of n must share with any partner: at least 80 % of the union is at least 80 % of n."""
    return -(-4 * n // 5)


def _sets(size: int, sent):
    """doc_id, mark, n, and for documents that may have a partner the set's digest, its shingles (rare first) and how many of them are unique."""
    kind = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("node", pa.binary()), ("alone", pa.int32()), ("tokens", pa.binary()), *((b, pa.int64()) for b in _BITS)])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = WordHasher(), sent()
        for batch in it:
            ids, marks = batch.column("doc_id"), batch.column("mark")
            for begin, rows, h, row in shingle_sets(batch, hasher, size):
                n = np.bincount(row, minlength=rows)
                often = sketch.repeated(h)
                alone = n - np.bincount(row[often], minlength=rows)
                live = (n > 0) & (n - alone >= least_overlap(n))
                mine = live[row]
                h, row, often = h[mine], row[mine], often[mine]
                lanes = [mix(h ^ U(k)) for k in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                edge = np.flatnonzero(np.concatenate([np.ones(1, bool), row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
                digest = np.stack([np.add.reduceat(x, edge) for x in lanes], axis=1) if len(row) else None
                order = np.lexsort((h, sketch.count(h), often, row))
                h = h[order]
                nodes, tokens = [None] * rows, [None] * rows
                bits = np.zeros((rows, _LONGS * 64), dtype=bool)
                bits[row, h >> U(64 - 9)] = True
                bits = np.packbits(bits, axis=1).view(np.int64)
                for i, (r, b) in enumerate(zip(row[edge].tolist(), edge.tolist(), strict=True)):
                    nodes[r], tokens[r] = digest[i].tobytes(), h[b : b + n[r]].tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(begin, rows), marks.slice(begin, rows), pa.array(n, pa.int32()), pa.array(nodes, pa.binary()), pa.array(alone, pa.int32()), pa.array(tokens, pa.binary()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(_LONGS))], schema=kind)

    return batches


def _postings(extra: tuple[str, ...]):
    """token, node, n, pos and the class's columns `extra`: each class's prefix without the shingles that no other document has."""

    def posted(out: list[np.ndarray], places: list[np.ndarray], batch: pa.RecordBatch, begin: int, end: int) -> pa.RecordBatch:
        row = np.repeat(np.arange(begin, end), [len(x) for x in out])
        own = batch.select(["node", "n", *extra]).take(pa.array(row))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64()), *own.columns, pa.array(np.concatenate(places), pa.int32())], names=["token", "node", "n", *extra, "pos"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, places, begin, held = [], [], 0, 0
            for i, (n, alone, tokens) in enumerate(zip(batch.column("n").to_pylist(), batch.column("alone").to_pylist(), batch.column("tokens"), strict=True)):
                end = n - least_overlap(n) + 1
                out.append(np.frombuffer(tokens.as_buffer(), dtype=np.int64)[alone:end]), places.append(np.arange(alone, end))
                held += len(out[-1])
                if held > 200_000:
                    yield posted(out, places, batch, begin, i + 1)
                    out, places, begin, held = [], [], i + 1, 0
            if out:
                yield posted(out, places, batch, begin, batch.num_rows)

    return batches


def fewest_apart(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """At least how many values only one of two ascending arrays has: the suffix filter, which cuts both at the middle of one and compares the sizes of the parts."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    found = int(at < len(x) and x[at] == y[middle])
    return fewest_apart(x[:at], y[:middle], depth - 1) + fewest_apart(x[at + found :], y[middle + 1 :], depth - 1) + 1 - found


def _verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keep = []
        for x, y in zip(batch.column("tx"), batch.column("ty"), strict=True):
            x, y = (np.sort(np.frombuffer(t.as_buffer(), dtype=np.int64)) for t in (x, y))
            total = len(x) + len(y)
            if 9 * fewest_apart(x, y, 3) > total:  # sets that link share 4 of 9 of their sizes' sum at least
                keep.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (total - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _may_reach(na, nb, a: list, b: list):
    """Whether two sets can reach the threshold, by sizes and bitmaps: each bit that only one of them has is a shingle at least that it doesn't share."""
    only = lambda x, y: sum((F.bit_count(p.bitwiseAND(F.bitwise_not(q))) for p, q in zip(x, y, strict=True)), F.lit(0))
    return 9 * F.least(na - only(a, b), nb - only(b, a)) >= 4 * (na + nb)


def _links(spark: SparkSession, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those that reach the threshold. `classes` is bucketed by node, so only pairs move, and of sets those of pairs left by the bitmaps."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), *[F.col(c).alias(s + c) for c in _BITS])
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_reach(F.col("na"), F.col("nb"), *([F.col(s + c) for c in _BITS] for s in "ab"))).select("a", "b")
    text = lambda s, t: classes.select(F.col("node").alias(s), F.col("tokens").alias(t))
    return written(spark, near.join(text("a", "tx"), "a").join(text("b", "ty"), "b").select("a", "b", "tx", "ty").mapInArrow(shrinking(_verified), "a binary, b binary"), "links")


def _long_enough(a: str, b: str):
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _possible(a: str, b: str):
    """Length and positional filter for two postings of a shingle. The latter is exact at the first that both sets have in their prefix, where each linked pair passes."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return _long_enough(a, b) & (9 * (F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))) >= 4 * (n + m))


def _star_pairs(spark: SparkSession, posted: DataFrame) -> DataFrame:
    """One pair for each class: with the class that, of those first under any of its shingles, has the smallest share of shingles of its own."""
    hub = F.struct((F.col("alone") / F.col("n")).alias("odd"), F.xxhash64("node").alias("any"), "node", "n", "pos")
    hubs = written(spark, posted.groupBy("token").agg(F.count("*").alias("k"), F.min(hub).alias("hub")).where("k > 1").drop("k"), "hubs")
    met = posted.alias("x").join(hubs, "token").where((F.col("x.node") != F.col("hub.node")) & _possible("x", "hub"))
    best = met.groupBy("node").agg(F.min("hub").alias("hub"))
    star = written(spark, best.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct(), "star")
    discard(spark, hubs)
    return star


def _all_pairs(open_: DataFrame, classes: DataFrame) -> DataFrame:
    full = open_.join(classes.select("node", *_BITS), "node")
    x, y = full.alias("x"), full.alias("y")
    near = _may_reach(F.col("x.n"), F.col("y.n"), *([F.col(f"{s}.{c}") for c in _BITS] for s in "xy"))
    both = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _possible("x", "y") & near)
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def similar_groups(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text).

    A-Z are lower-cased and words are `[^\\x20\\x09-\\x0D]+`. A set holds the distinct shingles of `size` words; with fewer
    words the whole sequence is the one shingle. Two documents link if their sets' intersection is at
    least 80 % of their union. component_id is the smallest doc_id that links lead to, the row's own
    included. Null, empty and blank texts have no shingles and link with nothing. A missing doc_id counts as
    smaller than any other, and as component_id shows as null. Each row is a document of its own: repeated
    rows link if they have words. Texts are read whole. An empty table gives an empty result; other columns
    don't matter.
    """
    out = _groups(spark, docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.lit(0).cast("long").alias("mark"), "text"), **how)
    shown = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(shown(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), shown(F.col("component_id")).alias("component_id"))


def _groups(spark: SparkSession, rows: DataFrame, size: int = 5, sketch_bits: int = 27) -> DataFrame:
    """doc_id, mark, n, component_id for each of `rows` (doc_id, mark, text), of which text alone may be null."""

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        hasher = WordHasher()
        for batch in it:
            for _, _, h, _ in shingle_sets(batch, hasher, size):
                yield h

    sent = build(rows.select("text"), keys, lambda: RaritySketch(sketch_bits), 4 * spark.sparkContext.defaultParallelism)  # 2^sketch_bits / 2 + 2^24 bytes at any size of the input
    sets = written(spark, rows.mapInArrow(shrinking(_sets(size, sent)), "doc_id long, mark long, n int, node binary, alone int, tokens binary, " + ", ".join(f"{b} long" for b in _BITS)), "sets")
    classes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "alone", "tokens", *_BITS)])
    classes = bucketed(spark, classes, "node", "classes")
    names = written(spark, sets.select("doc_id", "mark", "n", "node"), "names")
    discard(spark, sets)

    posted = written(spark, classes.select("node", "n", "alone", "tokens").mapInArrow(shrinking(_postings(("alone",))), "token long, node binary, n int, alone int, pos int"), "postings")
    star = _star_pairs(spark, posted)
    discard(spark, posted)
    links = _links(spark, star, classes)
    label = components(spark, links, rounds=2)  # needs to join only what is connected, not all that is
    of = classes.select("node", "n", "alone", "tokens").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    posted = written(spark, of.mapInArrow(shrinking(_postings(("component",))), "token long, node binary, n int, component binary, pos int"), "postings")
    mixed = posted.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("token")
    mixed = written(spark, mixed, "mixed")
    open_ = written(spark, posted.join(mixed, "token", "left_semi"), "open")
    discard(spark, posted, mixed)
    found = _links(spark, _all_pairs(open_, classes).join(star, ["a", "b"], "left_anti"), classes)
    discard(spark, open_)
    label = components(spark, links.unionByName(found))

    of = classes.select("node", "first_id").join(label, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    least = written(spark, of.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")  # a table of its own, so that the join may split a large component
    named = of.join(least, "component").select("node", "component_id")
    alone = names.where("node is null").select("doc_id", "mark", "n", F.col("doc_id").alias("component_id"))  # kept out of the join, whose one task they would all go to
    return names.join(named, "node").select("doc_id", "mark", "n", "component_id").unionByName(alone)


def one_of_each(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` whose doc_id is their component's, so one document of each group; all columns are kept.

    Rows without a doc_id stay. Rows that share one are judged each by its text; repeated rows (same doc_id and text) stay or go together.
    """
    mark = lambda text: F.xxhash64(F.coalesce(text, F.lit("")))
    out = _groups(spark, docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), mark(F.col("text")).alias("mark"), "text"), **how)
    at, of = fresh(docs, "gone_id"), fresh(docs, "gone_mark")
    gone = out.where("doc_id != component_id").select(F.col("doc_id").alias(at), F.col("mark").alias(of)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(at)) & (mark(F.col("text")) == F.col(of)), "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), reach(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(root) AS component_id FROM reach GROUP BY id) m USING (doc_id)
"""
