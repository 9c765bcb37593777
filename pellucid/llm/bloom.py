"""A Bloom filter over 64-bit hashes, built in tasks and broadcast.

Its size follows the number of hashes, up to 2 ** ``MOST_BITS`` bits. It only spares work: whoever uses it
has to be right for false positives too, of which there are more where more hashes share the largest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pellucid.llm.shingles import mix64

LEAST_BITS, MOST_BITS, HASHES = 19, 27, 3
#: Bits to a hash, about.
PER_HASH = 12
#: Bytes of the filter that travel as one row.
SEGMENT = 1 << 16


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    base = hashes.astype(np.uint64)
    return np.stack([(mix64(base + np.uint64(k + 1)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(HASHES)])


def _segments(filled: dict[int, np.ndarray]):
    if filled:
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in filled.values()], pa.binary())], names=["segment", "part"])


def _part(bits: int):
    def run(batches):
        whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for batch in batches:
            places = _places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(whole, places >> 3, (1 << (places & 7)).astype(np.uint8))
        yield from _segments({k: x for k, x in enumerate(whole.reshape(-1, SEGMENT)) if x.any()})

    return run


def _merge(batches):
    filled: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, part in zip(batch.column("segment").to_pylist(), batch.column("part").to_pylist(), strict=True):
            row = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
            filled[segment] = filled[segment] | row if segment in filled else row
    yield from _segments(filled)


def build(hashes: DataFrame) -> np.ndarray:
    """The bits of all values of the only column, a long, which is read twice; the filter alone reaches the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (PER_HASH * hashes.count()).bit_length()))
    whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
    schema = "segment int, part binary"
    for row in hashes.mapInArrow(_part(bits), schema).repartition("segment").mapInArrow(_merge, schema).collect():
        whole[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] |= np.frombuffer(zlib.decompress(row["part"]), dtype=np.uint8)
    return whole


def may_hold(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = _places(hashes, (8 * len(whole)).bit_length() - 1)
    return (whole[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool).all(axis=0)


def sieve(hashes: DataFrame, column: str):
    """A step for ``mapInArrow`` that keeps the rows whose ``column`` may be one of the hashes."""
    bits = hashes.sparkSession.sparkContext.broadcast(build(hashes))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits.value, batch.column(column).to_numpy())))

    return run


def sift(df: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be one of the hashes; what is kept is to be joined with them."""
    return df.mapInArrow(sieve(hashes, column), df.schema)
