"""Variable-capacity best-fit packing of documents into training sequences.

Texts longer than the largest permitted length are cut into full pieces, each a sequence of its own, and a rest.
Rests are dealt to shards of about `shard_rows` by a hash of a stored row number and packed there, the
largest first: into the open bin that leaves the least room, else into a new bin of the size whose cost is
least after what its room is worth. At the end each bin shrinks to the smallest permitted length that
holds its contents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANK_CHARS, BLANKS, shrinking, table, written

LENGTHS = (512, 1024, 2048, 4096, 8192)
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("bin_id", pa.int64()), ("capacity", pa.int32()), ("place", pa.int32())])


def word_count(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{BLANKS}]+")))


def bin_cost(capacity: int, fixed: float = 64.0) -> float:
    """What a sequence costs: its length, and the same for each."""
    return capacity + fixed


def best_fit(sizes: list[int], lengths: tuple[int, ...], cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int]]:
    """Of each item, in descending order of size, the bin and the place in it; and each bin's final capacity.

    Of open bins with equally much room the one filled last is taken. A new bin's room is worth the least
    price of a token in any size, as far as items remain that fit into it; of equally cheap sizes the
    smallest is opened.
    """
    price = min(cost(c) / c for c in lengths)
    tokens = np.bincount(sizes, weights=sizes, minlength=max(lengths) + 1) if sizes else np.zeros(max(lengths) + 1)
    upto, left = np.cumsum(tokens), float(sum(sizes))
    room: list[list[int]] = [[] for _ in range(max(lengths) + 1)]
    free, used, bins, places = 0, [], [], []  # free: bit r is set while a bin with room r is open
    capacity: list[int] = []
    for size in sizes:
        if fits := free >> size:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            rest = left - size
            worth = lambda c: cost(c) - price * min(c - size, upto[c - size] if c - size < size else rest, rest)  # noqa: B023, E731
            r = min((c for c in lengths if c >= size), key=lambda c: (worth(c), c))
            b = len(capacity)
            capacity.append(r), used.append(0)
        bins.append(b), places.append(used[b])
        used[b] += size
        left -= size
        if r > size:
            if not room[r - size]:
                free |= 1 << (r - size)
            room[r - size].append(b)
    return bins, places, [min(c for c in lengths if c >= u) for u in used]


def _pack(lengths: tuple[int, ...], cost: Callable[[int], float]):
    """Rows come sorted by shard and descending size, all of a shard in one task."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for batch in it:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != shard and held:
                    yield done(shard, held)
                    held = []
                shard = int(shards[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done(shard, held)

    def done(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sizes = rows.column("n_tokens").to_pylist()
        bins, places, capacity = best_fit(sizes, lengths, cost)
        bins = np.asarray(bins, dtype=np.int64)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("piece"), rows.column("n_tokens"), pa.array((shard << 32) | bins), pa.array(np.asarray(capacity, np.int32)[bins]), pa.array(places, pa.int32())], schema=_PLACED)

    return batches


def pack(spark: SparkSession, docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = bin_cost, tokens: Callable[[Column], Column] = word_count, shard_rows: int = 20_000) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, capacity, place (tokens before it in its bin): a row for each piece of each document.

    Tokens are words `[^\\x20\\x09-\\x0D]+` unless `tokens` counts others. Piece k holds tokens k * longest to
    (k + 1) * longest - 1 of its text, so every token is placed once. Null, empty and blank texts have no tokens and no row. A
    missing doc_id stays null; repeated rows are packed each. Equal sizes go by row number. An empty table gives
    an empty result; other columns don't matter.
    """
    lengths, most = tuple(sorted(lengths)), max(lengths)
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).cast("long").alias("n"), F.monotonically_increasing_id().alias("rid")).where("n > 0")
    items = written(spark, items, "items")
    n_shards = max(1, -(-items.where(F.col("n") % most != 0).count() // shard_rows))
    whole = items.where(F.col("n") >= most).select("doc_id", "rid", F.explode(F.sequence(F.lit(0), (F.col("n") / most).cast("int") - 1)).alias("piece"))
    whole = whole.select("doc_id", "piece", F.lit(most).alias("n_tokens"), F.bitwise_not(F.monotonically_increasing_id()).alias("bin_id"), F.lit(most).alias("capacity"), F.lit(0).alias("place"))
    rest = items.where(F.col("n") % most != 0).select(
        F.pmod(F.xxhash64("rid"), F.lit(n_shards)).cast("int").alias("shard"), "doc_id", (F.col("n") / most).cast("int").alias("piece"), (F.col("n") % most).cast("int").alias("n_tokens"), "rid",
    )
    rest = rest.repartition(n_shards, "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "rid").drop("rid")
    return rest.mapInArrow(shrinking(_pack(lengths, cost)), "doc_id long, piece int, n_tokens int, bin_id long, capacity int, place int").unionByName(whole)


def sequences(docs: DataFrame, placed: DataFrame, longest: int = max(LENGTHS), joint: str = " ") -> DataFrame:
    """bin_id, capacity, n_tokens and text of each packed sequence of words. doc_id must be unique."""
    bare = F.trim(F.coalesce("text", F.lit("")), F.lit(BLANK_CHARS))
    parts = placed.join(docs.select("doc_id", F.split(bare, f"[{BLANKS}]+").alias("words")), "doc_id").select("bin_id", "capacity", "n_tokens", "place", F.concat_ws(" ", F.slice("words", F.col("piece") * longest + 1, F.col("n_tokens"))).alias("part"))
    bins = parts.groupBy("bin_id", "capacity").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts"))
    return bins.select("bin_id", "capacity", "n_tokens", F.concat_ws(joint, F.col("parts.part")).alias("text"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
