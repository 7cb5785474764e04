"""A Bloom filter of 64-bit hashes, built by Spark, of bounded size.

Its size follows the number of hashes up to ``MAX_BITS``; beyond, it only
lets more through. Users must be right whatever passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MIN_BITS, MAX_BITS, PIECES = 1 << 20, 1 << 28, 64
_U = np.uint64


def bits_for(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, 16 * n - 1).bit_length()))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits in the piece that the top of the hash names."""
    piece = h >> _U(64 - 6)
    inside = _U(bits // PIECES - 1)
    base = piece * _U(bits // PIECES)
    return base + (h & inside), base + (h >> _U(29) & inside)


def build(hashes: DataFrame, n: int) -> np.ndarray:
    """uint8 bitmap of the one long column; each piece is built by one task, in one pass."""
    bits = bits_for(n)
    size = bits // PIECES // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False).view(_U)
            for p in np.unique(h >> _U(58)).tolist():
                part = found.setdefault(p, np.zeros(size, np.uint8))
                for place in _places(h[h >> _U(58) == _U(p)], bits):
                    place = place - _U(p) * _U(size * 8)
                    np.bitwise_or.at(part, (place >> _U(3)).astype(np.int64), (_U(1) << (place & _U(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["piece", "bits"])

    name = hashes.columns[0]
    dealt = hashes.select(F.expr(f"cast(shiftrightunsigned({name}, 58) as int)").alias("piece"), F.col(name).alias("h")).repartition(PIECES, "piece")
    out = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(fill, "piece int, bits binary").toLocalIterator():
        out[r.piece * size : (r.piece + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def contains(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for place in _places(h, len(bitmap) * 8):
        hit &= (bitmap[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
    return hit
