"""Sharding by minimax contiguous partition.

All columns are Spark's own functions. Equal texts form a group that no cut may divide. Groups are
ordered by a hash of their text, and the order is cut into 2 ** ``ATOM_BITS`` ranges of the hash, the
atoms: a table of bounded size, and for small inputs hardly an atom has two groups. Over the atoms' sizes
a binary search finds the least capacity for which greedy filling needs no more than the shards there
are; the shards are cut by it. Shards differ by an atom at most, unless one group is larger than a
shard's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import broadcast_if_small, materialize

ATOM_BITS = 14
#: Halvings of the range of capacities: enough for sizes of up to 2 ** 62 bytes.
HALVINGS = 62
#: An atom's rows are numbered in so many parts, so that no large group is one window.
PARTS = 32


def _least_capacity(sizes: Column, shards: int) -> Column:
    """The least capacity with which the atoms, in order, fill no more than so many shards."""

    def fill(capacity: Column) -> Column:
        """Greedy filling: how many shards are begun, and how full the last is."""
        first = F.struct(F.lit(1).cast("long").alias("used"), F.lit(0).cast("long").alias("load"))

        def put(s: Column, size: Column) -> Column:
            fits = s["load"] + size <= capacity
            return F.struct(F.when(fits, s["used"]).otherwise(s["used"] + 1).alias("used"), F.when(fits, s["load"] + size).otherwise(size).alias("load"))

        return F.aggregate(sizes, first, put)

    def halve(r: Column, _: Column) -> Column:
        middle = r["low"] + F.floor((r["high"] - r["low"]) / 2).cast("long")
        done, feasible = r["low"] >= r["high"], F.when(r["low"] < r["high"], fill(middle)["used"] <= shards).otherwise(F.lit(True))
        return F.struct(F.when(done | feasible, r["low"]).otherwise(middle + 1).alias("low"), F.when(~done & feasible, middle).otherwise(r["high"]).alias("high"))

    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    # no capacity is below the largest atom or the mean
    least = F.greatest(F.array_max(sizes), F.ceil(total / shards).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(least.alias("low"), total.alias("high")), halve)["high"]


def _cuts(sizes: Column, capacity: Column, shards: int) -> Column:
    """The places at which the second and later shards begin, none filled above the capacity.

    Filling greedily from the end tells how many atoms at the end so many shards can take; as long as
    enough are left, a shard ends as near as it can to its share of the whole, and so the last one isn't
    short of what the others have over. The folds keep no more than a number for each shard.
    """
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")

    def back(s: Column, size: Column) -> Column:
        fits = s["load"] + size <= capacity
        return F.struct(
            F.when(fits, s["load"] + size).otherwise(size).alias("load"), (s["seen"] + 1).alias("seen"),
            F.when(fits, s["take"]).otherwise(F.concat(s["take"], F.array(s["seen"]))).alias("take"),
        )

    take = F.aggregate(F.reverse(sizes), F.struct(zero.alias("load"), zero.alias("seen"), none.alias("take")), back)["take"]

    def put(s: Column, size: Column) -> Column:
        begun = F.size(s["cuts"]) + 1
        left = shards - begun
        enough = (left >= 1) & (F.coalesce(F.get(s["take"], left - 1), s["n"]) >= s["n"] - s["seen"])
        ends = (s["load"] + size > capacity) | (enough & (s["before"] + size / 2 > begun * s["total"] / shards))
        return F.struct(
            F.when(ends, size).otherwise(s["load"] + size).alias("load"), (s["before"] + size).alias("before"), (s["seen"] + 1).alias("seen"),
            F.when(ends, F.concat(s["cuts"], F.array(s["seen"]))).otherwise(s["cuts"]).alias("cuts"), *(s[c].alias(c) for c in ("take", "n", "total")),
        )

    # a fold works out again, for each atom, whatever it doesn't carry along
    total = F.aggregate(sizes, zero, lambda a, x: a + x)
    start = F.struct(zero.alias("load"), zero.alias("before"), zero.alias("seen"), none.alias("cuts"), take.alias("take"), F.size(sizes).cast("long").alias("n"), total.alias("total"))
    return F.aggregate(sizes, start, put)["cuts"]


def minimax_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as empty. The law is ``bytes``: sizes
    of shards near equal, ``grown_shard`` null. Equal texts share a shard. Slots number a shard's rows
    from 0 without gaps. Null ids and repeated rows are placed like others; other columns are ignored;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    rows = rows.withColumn("atom", F.shiftrightunsigned("hash", 64 - ATOM_BITS).cast("int"))
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64("id", "hash"), F.lit(PARTS)).cast("int")).drop("hash"))

    parts = materialize(rows.groupBy("atom", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    # the atoms, at most 2 ** ATOM_BITS of them, meet in one row
    atoms = parts.groupBy("atom").agg(F.sum("size").alias("size"))
    one = atoms.agg(F.array_sort(F.collect_list(F.struct("atom", "size"))).alias("atoms")).where("size(atoms) > 0")
    sizes = F.transform("atoms", lambda a: a["size"])
    one = materialize(one.withColumn("capacity", _least_capacity(sizes, shards)))
    one = materialize(one.select("atoms", _cuts(sizes, F.col("capacity"), shards).alias("cuts")))
    one = one.select(F.posexplode("atoms").alias("place", "a"), "cuts")
    shard_of = one.select("a.atom", F.size(F.filter("cuts", lambda c: c <= F.col("place"))).alias("shard"))

    numbered = parts.select("atom", "part", "n").join(broadcast_if_small(shard_of), "atom")
    order = Window.partitionBy("shard").orderBy("atom", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = numbered.withColumn("before", F.sum("n").over(order) - F.col("n")).drop("n")
    inside = Window.partitionBy("atom", "part").orderBy("id", "size", "text_crc32")
    out = rows.withColumn("inside", F.row_number().over(inside) - 1).join(numbered, ["atom", "part"])
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
