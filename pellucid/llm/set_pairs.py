"""Comparing texts' sets of shingles in pairs: a hub against its members, and the sets of one component.

Texts come as rows ``(sig, ranges, packed)``: the set's name, the counts of its hashes in ``RANGES`` equal
ranges, and the compressed text, which takes a third of the room of the hashes that are made of it where
it arrives. Both ends of a pair are joined to it, the hub last: its many pairs arrive together, so that its
set is made once, and Spark splits the join where a hub has too many for one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm import bloom
from pellucid.llm.common import materialize
from pellucid.llm.shingles import shingle_sets

RANGES = 128
#: Texts that are made into sets at once.
TEXTS_AT_ONCE = 128
#: Sets of a component in a block and bytes of their differences, about, and columns of a block's matrices.
BLOCK_SETS, BLOCK_BYTES, COLUMNS = 1024, 1 << 23, 1024

_NO_HASHES = np.zeros(0, dtype="<u8")


def range_counts(tokens: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of RANGES equal ranges."""
    counts = np.bincount((tokens >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES)
    return counts.astype("<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def _counts(ranges: bytes) -> np.ndarray:
    return np.frombuffer(ranges, dtype="<u2" if len(ranges) == 2 * RANGES else "<u4").astype(np.int64)


def pack(text: bytes) -> bytes:
    """A compressed text, led by its length."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _pairs_of_sets(batch: pa.RecordBatch, width: int):
    """(hub's set, member's set) of each pair of a batch, some texts at a time."""
    last, hub = None, _NO_HASHES
    for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
        part = batch.slice(at, TEXTS_AT_ONCE)
        members = shingle_sets(map(_unpack, part.column("packed_sig").to_pylist()), width)
        for name, packed, member in zip(part.column("hub").to_pylist(), part.column("packed_hub"), members, strict=True):
            if name != last:
                last, hub = name, next(shingle_sets([_unpack(packed.as_py())], width))
            yield hub, member


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share; the smaller one is looked up in the other."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    place = np.searchsorted(y, x)
    return int((y[np.minimum(place, len(y) - 1)] == x).sum())


def _reaches(percent: int, sizes, common):
    return 100 * common >= percent * (sizes - common)


def _with_both(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """The pairs ``(hub, sig)`` with the ``column`` of either, and rows of one hub together."""
    side = side.select("sig", column)
    with_member = pairs.join(side.toDF("sig", f"{column}_sig"), "sig")
    return with_member.join(side.toDF("hub", f"{column}_hub"), "hub").select("hub", "sig", f"{column}_hub", f"{column}_sig")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs``, which are written rows, with both texts; a Bloom filter keeps most others at home."""
    ends = pairs.select("sig").unionAll(pairs.select("hub"))
    return _with_both(pairs, bloom.sift(texts.select("sig", "packed"), "sig", ends), "packed")


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs ``(hub, sig)`` whose sets reach the similarity, each verified once.

    Before whole texts travel, the counts by hash range bound a pair's overlap: each range adds its lesser
    count at most.
    """

    def may(batches):
        for batch in batches:
            hubs, members = ([_counts(v) for v in batch.column(f"ranges_{c}").to_pylist()] for c in ("hub", "sig"))
            keep = [bool(_reaches(percent, x.sum() + y.sum(), np.minimum(x, y).sum())) for x, y in zip(hubs, members, strict=True)]
            yield batch.select(["hub", "sig"]).filter(pa.array(keep, pa.bool_()))

    def does(batches):
        for batch in batches:
            keep = [bool(_reaches(percent, len(x) + len(y), _common(x, y))) for x, y in _pairs_of_sets(batch, width)]
            yield batch.select(["hub", "sig"]).filter(pa.array(keep, pa.bool_()))

    near = materialize(_with_both(pairs, texts, "ranges").mapInArrow(may, "hub long, sig long"))
    return materialize(_with_texts(near, texts).mapInArrow(does, "hub long, sig long"))


def _differences(width: int):
    """Of each member: its size, its hub's, the places of the hub's hashes that it lacks, and those it adds."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        for batch in batches:
            out = []
            for center, sig, (hub, own) in zip(batch.column("hub").to_pylist(), batch.column("sig").to_pylist(), _pairs_of_sets(batch, width), strict=True):
                lacks = np.flatnonzero(~np.isin(hub, own, assume_unique=True)).astype("<u4")
                adds = own[~np.isin(own, hub, assume_unique=True)]
                out.append((center, sig, len(own), len(hub), lacks.tobytes(), adds.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["hub", "sig", "n", "hub_n", "lacks", "adds"])

    return run


def _shared_entries(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Owner and column of the values that several parts have, by column, and the number of columns."""
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, column, uses = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = uses > 1
    owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    return owner[order], column[order], int(shared.sum())


def _add_common(common: np.ndarray, parts: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> None:
    """Add the numbers of values that the parts of rows and columns share, some matrix columns at a time."""
    owner, column, width = _shared_entries(parts)
    for at in range(0, width, COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(parts), min(COLUMNS, width - at)), dtype=np.float32)
        has[owner[low:high], column[low:high] - at] = 1
        common += (has[rows] @ has[columns].T).astype(np.int64)


def _count_links(percent: int):
    """Links of each set with the sets of the other block, or of its own where a block meets itself.

    With a hub of h hashes, sets that lack p and q of them have h - p - q in common, and those that both
    lack, and those that both add.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, sizes = table.column("block").to_numpy(), table.column("n").to_numpy()
        lacks = [np.frombuffer(v.as_buffer(), dtype="<u4") for v in table.column("lacks")]
        adds = [np.frombuffer(v.as_buffer(), dtype="<u8") for v in table.column("adds")]
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        rows, columns = np.flatnonzero(block == p), np.flatnonzero(block == q)
        lost = np.array([len(x) for x in lacks], dtype=np.int64)
        common = table.column("hub_n")[0].as_py() - lost[rows][:, None] - lost[columns][None]
        _add_common(common, lacks, rows, columns)
        _add_common(common, adds, rows, columns)
        links = _reaches(percent, sizes[rows][:, None] + sizes[columns][None], common)
        found = np.zeros(len(sizes), dtype=np.int64)
        if p == q:
            np.fill_diagonal(links, False)
        else:
            found[columns] += links.sum(0)
        found[rows] += links.sum(1)
        return pa.table([table.column("sig"), pa.array(found)], names=["sig", "k"])

    return run


def link_counts(texts: DataFrame, component: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """``(sig, n_links)`` of the ``(node, component)``: every pair of a component is held against each other.

    Sets are written down as what they lack and add to the member with the most links, so near copies
    take little room however large they are, and components are cut into blocks that meet in pairs.
    """
    ends = links.select(F.col("hub").alias("node")).unionAll(links.select(F.col("sig").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    hubs = component.join(degree, "node").groupBy("component").agg(F.max_by("node", F.struct("k", "node")).alias("hub"))
    members = materialize(component.join(hubs, "component").select("hub", F.col("node").alias("sig")))
    parts = materialize(_with_texts(members, texts).mapInArrow(_differences(width), "hub long, sig long, n long, hub_n long, lacks binary, adds binary"))
    weight = F.sum(F.octet_length("lacks") + F.octet_length("adds"))
    sizes = parts.groupBy("hub").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, weight / BLOCK_BYTES)).alias("blocks"))
    placed = parts.join(materialize(sizes), "hub").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("hub", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "sig", "n", "hub_n", "lacks", "adds")
    counts = placed.groupBy("hub", "p", "q").applyInArrow(_count_links(percent), "sig long, k long")
    return materialize(counts.groupBy("sig").agg(F.sum("k").alias("n_links")))
