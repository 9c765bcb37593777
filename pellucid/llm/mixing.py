"""Mixing sources to target weights with packed blocks.

All columns are Spark's own functions. The words of each source are packed, in a fixed order, into
blocks of ``block`` words. Every output shard of ``shard_slots`` slots draws its sources by stratified
multinomial sampling (one uniform number in each slot's stratum), so counts follow the weights closely.
The slots of one source, counted through all shards, run through its blocks by a pseudorandom
permutation of their indices, a new one for every pass over them, and slots and blocks meet in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import WORD_PATTERN, broadcast_if_small, materialize, shuffle_partitions

WEIGHTS = (5, 2, 1)
#: A source, and with it each of its blocks, is taken at most so often.
MOST = 3
BLOCK, SHARD_SLOTS = 64, 16384
ROUNDS = 24
#: Rows of one source that a window holds together, about.
STRETCH = 50_000


def _targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, blocks, target)``: shares by weight, none above MOST times its source.

    Sources are few against rows: one row each. Where some share is above its bound, the total left for
    the others is reshared by weight; in the order of bound by weight the capped ones come first, so
    running sums give the one level at which shares and bounds agree.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    rows = sizes.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    rows = rows.withColumn("bound", F.lit(float(MOST)) * F.col("source_size"))
    by_bound = Window.orderBy((F.col("bound") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("bound").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", (F.col("total") - capped) / open_weight)
    # the first source whose share at its own level is within its bound sets the level for all behind it
    settled = F.min(F.when(F.col("weight") * F.col("level") <= F.col("bound"), F.struct((F.col("bound") / F.col("weight")).alias("at"), "level"))).over(everything)
    share = F.when(F.col("bound") / F.col("weight") < settled["at"], F.col("bound")).otherwise(F.col("weight") * settled["level"])
    return rows.withColumn("target", F.coalesce(F.least(share, "bound"), F.lit(0.0))).select("source", "source_size", "blocks", "target")


def _uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _permuted(index: Column, n: Column, key: Column) -> Column:
    """The image of an index below n under a pseudorandom permutation that the key names.

    A swap-or-not shuffle (Hoang, Morris and Rogaway, 2012): each round pairs x with k - x modulo n and a
    hash of the pair decides whether to change places. It permutes any n without a table.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        pair = F.greatest(x, other)
        return F.when(F.pmod(F.xxhash64(key, r, pair), F.lit(2)) == 0, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def _offsets(rows: DataFrame) -> DataFrame:
    """Each row's first word among those of its source, by sums within and then across stretches.

    A stretch holds the rows of one source and one hash value, so that no source is one window.
    """
    stretch = Window.partitionBy("source", "stretch").orderBy("id", "tie")
    rows = rows.withColumn("inside", F.sum("size").over(stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    sums = rows.groupBy("source", "stretch").agg(F.sum("size").alias("sum"))
    across = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("before", F.sum("sum").over(across) - F.col("sum"))
    sums = sums.select(F.col("source").alias("s"), F.col("stretch").alias("t"), "before")
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t")))
    return joined.withColumn("first", F.col("before") + F.col("inside")).drop("s", "t", "before", "inside")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per row of ``docs``: id, ``source``, ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` counts the text's words (null: 0), ``taken`` the words that the mix takes of it, repeats
    counted: never more than MOST times ``size``. Sources in the order of their code points, null last,
    weigh 5, 2, 1, repeating; targets share the size of all sources. The result depends on the rows and
    the seed alone, not on their order or partitions; rows that are equal throughout may change places.
    Sources without words have target 0. Windows over all sources hold one row for each source. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))
    rows = materialize(rows)
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    totals = totals.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    stretches = totals.select(F.col("source").alias("s"), (F.ceil(F.col("n") / STRETCH)).cast("long").alias("stretches"))
    targets = materialize(_targets(totals.drop("n")))
    stretches = broadcast_if_small(materialize(stretches))

    # a slot of a source stands for its mean block, so that a short last block doesn't lower its share
    wants = targets.where("source_size > 0").withColumn("wish", F.col("target") * F.col("blocks") / F.col("source_size"))
    by_source = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wants = wants.withColumn("all", F.sum("wish").over(Window.partitionBy())).withColumn("upper", F.sum("wish").over(by_source) / F.col("all"))
    wants = wants.withColumn("lower", F.coalesce(F.lag("upper").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0.0)))
    wants = wants.withColumn("slots", F.round("all").cast("long"))

    # of a shard's slots a source can only get those whose stratum meets its share
    shards = F.explode(F.sequence(F.lit(0), F.ceil(F.col("slots") / shard_slots).cast("long") - 1))
    # a few rows stand for many slots, so they are dealt to all tasks before they are spread out
    tasks = shuffle_partitions(docs.sparkSession)
    draws = wants.where("slots > 0").withColumn("shard", shards).repartition(tasks, "source", "shard")
    draws = draws.withColumn("m", F.least(F.lit(shard_slots), F.col("slots") - F.col("shard") * shard_slots))
    low, high = F.floor(F.col("lower") * F.col("m")).cast("long"), F.least(F.floor(F.col("upper") * F.col("m")).cast("long"), F.col("m") - 1)
    draws = draws.withColumn("slot", F.explode(F.sequence(low, F.greatest(low, high))))
    point = (F.col("slot") + _uniform(seed, "shard", "slot")) / F.col("m")
    draws = draws.where((point >= F.col("lower")) & ((point < F.col("upper")) | (F.col("upper") >= 1) & (F.col("slot") == F.col("m") - 1))).select("source", "blocks", "shard", "slot")
    counts = draws.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("k"))
    across = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("before", F.sum("k").over(across) - F.col("k"))
    spread = counts.join(targets.select(F.col("source").alias("s"), "blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    turn = spread.repartition(tasks, "source", "shard").select("source", "blocks", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("k") - 1)).alias("turn"))
    # rounding may draw a slot more than MOST passes have: it stays empty
    turn = turn.where(F.col("turn") < MOST * F.col("blocks"))
    key = F.xxhash64(F.lit(seed), "source", F.floor(F.col("turn") / F.col("blocks")))
    uses = turn.select("source", _permuted(F.pmod("turn", "blocks"), F.col("blocks"), key).alias("block"))
    uses = uses.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))

    rows = rows.join(stretches, F.col("source").eqNullSafe(F.col("s"))).withColumn("stretch", F.pmod(F.xxhash64("id", "tie"), F.col("stretches")))
    rows = materialize(_offsets(rows.select("id", "source", "size", "tie", "stretch")))
    parts = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")))
    words = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("first"), F.col("block") * block)
    parts = parts.select("source", "block", "first", words.alias("words"))
    u = uses.select(F.col("source").alias("s"), F.col("block").alias("b"), "uses")
    # both sides of these joins grow with the table: neither may be broadcast, however few bytes its exchange takes
    met = parts.hint("merge").join(u.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    # a row's first word is its name within its source, if it has words
    taken = met.groupBy("source", "first").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    taken = taken.select(F.col("source").alias("s"), F.col("first").alias("f"), "taken")
    out = rows.hint("merge").join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("first") == F.col("f")) & (F.col("size") > 0), "left")
    t = broadcast_if_small(targets.select(F.col("source").alias("r"), "source_size", "target"))
    out = out.drop("s").join(t, F.col("source").eqNullSafe(F.col("r")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
