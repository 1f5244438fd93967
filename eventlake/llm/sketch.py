"""Sketches of fixed size that partitions build and executors merge.

Sketch tells 0, 1, and 2 or more, with two bits a cell. RaritySketch adds rough counts, by which keys
can be put in an order that has the rare ones first. Merging and collisions only ever raise an estimate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import discard, release, shrinking, written

U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_LOW = U(0x5555555555555555)
#: Parts of each row that are merged separately.
_PARTS = 32


class Sketch:
    """Two rows of 2^bits cells, bits at least 10: a count-min sketch that saturates at 2."""

    def __init__(self, bits: int):
        self.bits = bits
        self.rows = [np.zeros((1 << bits) // 4, dtype=np.uint8) for _ in range(2)]

    def _cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return ((keys * U(_ODD[row])) >> U(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for row in range(2):
            cells, n = np.unique(self._cells(keys, row), return_counts=True)
            held = self.rows[row]
            for k in range(4):
                mine = (cells & 3) == k
                at = cells[mine] >> 2
                now = held[at]
                more = np.minimum(((now >> (2 * k)) & 3) + np.minimum(n[mine], 2), 2).astype(np.uint8)
                held[at] = (now & np.uint8(~(3 << (2 * k)) & 255)) | (more << np.uint8(2 * k))

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is estimated to have been added more than once."""
        out = np.ones(len(keys), dtype=bool)
        for row in range(2):
            cells = self._cells(keys, row)
            out &= ((self.rows[row][cells >> 2] >> (2 * (cells & 3)).astype(np.uint8)) & 2) > 0
        return out

    def parts(self) -> Iterator[tuple[int, bytes]]:
        for r, row in enumerate(self.rows):
            size = len(row) // _PARTS
            for i in range(_PARTS):
                if (body := row[i * size : (i + 1) * size]).any():
                    yield r * _PARTS + i, pa.compress(body.tobytes(), "zstd", asbytes=True)

    def unpack(self, number: int, body: pa.Buffer) -> np.ndarray:
        row = self.rows[number // _PARTS]
        return np.frombuffer(pa.decompress(body, row.nbytes // _PARTS, "zstd", asbytes=True), dtype=row.dtype)

    def merged(self, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return saturating_sum(a.view(U), b.view(U)).view(np.uint8)

    def load(self, number: int, body: bytes) -> None:
        row = self.rows[number // _PARTS]
        size = len(row) // _PARTS
        at = number % _PARTS * size
        row[at : at + size] = self.unpack(number, pa.py_buffer(body))


def saturating_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of cells that hold 0 to 2, 32 in each word."""
    a1, b1 = a & _LOW, b & _LOW
    two = ((a >> U(1)) & _LOW) | ((b >> U(1)) & _LOW) | (a1 & b1)
    return (two << U(1)) | ((a1 ^ b1) & ~two)


class RaritySketch(Sketch):
    """Also counts keys in a row of 2^21 cells."""

    def __init__(self, bits: int):
        super().__init__(bits)
        self.rows.append(np.zeros(1 << 21, dtype=np.uint32))

    def _counted(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(_ODD[2])) >> U(43)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        super().add(keys)
        cells, n = np.unique(self._counted(keys), return_counts=True)
        self.rows[2][cells] += n.astype(np.uint32)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return self.rows[2][self._counted(keys)]

    def merged(self, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b if number >= 2 * _PARTS else super().merged(number, a, b)


def build(keys: DataFrame, batches_of_keys, make, tasks: int) -> Callable[[], Sketch]:
    """The merged sketch, `make()` when empty, of all keys that `batches_of_keys(iterator)` yields over each partition; as a function that loads it on an executor.

    At most `tasks` partitions build a sketch of fixed size each; their parts are merged on the executors, one
    part of 1/32 of a row at a time, into a table. Only the merged parts, compressed, come to the driver, a file's at
    a time, and are broadcast: no more than the sketch's size, which `make` bounds, whatever the input's.
    """

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = make()
        for k in batches_of_keys(it):
            sketch.add(k)
        for number, body in sketch.parts():
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "body": pa.array([body], pa.binary())})

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like, number, total = make(), None, None
        row = lambda: pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "body": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})
        for batch in it:
            for n, body in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
                if n != number and number is not None:
                    yield row()
                cells = like.unpack(n, body.as_buffer())
                number, total = n, cells if n != number else like.merged(n, total, cells)
        if number is not None:
            yield row()

    kind = "part int, body binary"
    merging = min(2 * _PARTS, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = keys.coalesce(tasks).mapInArrow(shrinking(own), kind).repartition(merging, "part").sortWithinPartitions("part").mapInArrow(shrinking(sums), kind)
    merged = written(keys.sparkSession, parts, "sketch")
    held = [(r.part, bytes(r.body)) for r in merged.toLocalIterator()]  # a few parts at a time
    discard(keys.sparkSession, merged)
    sent = keys.sparkSession.sparkContext.broadcast(held)
    del held
    release()

    def load() -> Sketch:
        out = make()
        for number, body in sent.value:
            out.load(number, body)
        return out

    return load
