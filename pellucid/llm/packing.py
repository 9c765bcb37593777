"""Documents packed into sequences of bounded length with little padding, by cutting-stock patterns.

A document's ids are cut into full sequences and a remainder. Remainders are counted by width; column generation
(:mod:`cutting_stock`) says how many sequences to fill by which pattern of widths, and the documents of a width,
ranked, are dealt to the patterns' places in turn. One document in ``POOL`` is held back: its remainder is cut to
fill the few ids that patterns leave open, and what is left of these fills sequences of its own, the last
in powers of two. Only the histogram of widths and a few totals pass through the driver; ranks and places come from
counts per input task, so no width, however common, meets in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.bpe import PieceEncoder
from pellucid.llm.common import materialize
from pellucid.llm.cutting_stock import packing_patterns, width_classes
from pellucid.llm.word_ids import encode_texts

CAPACITY = 4096
#: One remainder in so many is held back to be cut.
POOL = 16
TEXTS_AT_ONCE = 1000
#: Pool documents and open places are joined by stretches of so many positions on one line.
STRETCH = 256
#: Sequences that are numbered together.
NUMBERED = 1 << 14

_ENCODED = [
    ("row", pa.int64()), ("task", pa.int32()), ("id", pa.int64()), ("doc_tokens", pa.int64()), ("chunks", pa.list_(pa.int64())), ("chunk_first", pa.int64()), ("rest", pa.int32()),
    ("rest_crc", pa.int64()), ("width", pa.int32()), ("rank", pa.int64()), ("pool_first", pa.int64()), ("pool_ids", pa.binary()),
]
_DDL = "row long, task int, id long, doc_tokens long, chunks array<long>, chunk_first long, rest int, rest_crc long, width int, rank long, pool_first long, pool_ids binary"


def _encode(path: str, end_id: int, capacity: int, pool: int):
    """Ids of each text, as checksums: of its full sequences and of its remainder; places are counted within the task."""
    widths = width_classes(capacity)

    def run(batches):
        encoder, end = PieceEncoder.of(path, drops_space=True), np.array([end_id], dtype="<u4").tobytes()
        task, rows, chunks, pooled = TaskContext.get().partitionId(), 0, 0, 0
        ranks = [0] * len(widths)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part, out = batch.slice(at, TEXTS_AT_ONCE), []
                every, edges = encode_texts(encoder, part.column("text"))
                for key, begin, behind in zip(part.column("id").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    ids = every[begin:behind].tobytes() + end
                    n = len(ids) // 4
                    full, rest = divmod(n, capacity)
                    sums = [zlib.crc32(ids[4 * capacity * k : 4 * capacity * (k + 1)]) for k in range(full)]
                    tail = ids[4 * capacity * full :]
                    width = rank = first = kept = None
                    if rest and rows % pool == pool - 1:
                        first, kept, pooled = pooled, tail, pooled + rest
                    elif rest:
                        width = int(np.searchsorted(widths, rest))
                        rank = ranks[width]
                        ranks[width] += 1
                    out.append((task << 33 | rows, task, key, n, sums, chunks, rest, zlib.crc32(tail), width, rank, first, kept))
                    rows, chunks = rows + 1, chunks + full
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _ENCODED, strict=True)], names=[c for c, _ in _ENCODED])

    return run


def _before(df: DataFrame, key: str, size: str, by: list[str] | None = None) -> DataFrame:
    """``df`` (a row for each input task, or for many sequences) with ``before``, the sum of ``size`` over smaller keys."""
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(size).over(over), F.lit(0)))


def _deal(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Ranges of a width's ranks that a pattern takes: (width, first, behind, first sequence, pieces in a sequence)."""
    widths = width_classes(capacity)
    histogram = np.zeros(len(widths), dtype=np.int64)
    for width, n in counts.items():
        histogram[width] = n
    dealt, at, sequences = [], np.zeros(len(widths), dtype=np.int64), 0
    for pattern, times in packing_patterns(widths, histogram, capacity):
        for k in np.nonzero(pattern)[0]:
            n = int(pattern[k] * times)
            dealt.append((int(k), int(at[k]), int(at[k]) + n, sequences, int(pattern[k])))
            at[k] += n
        sequences += times
    return dealt, sequences


def _cut(batches):
    """The pieces of held-back remainders at their places."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            base = row["doc_tokens"] - row["rest"]
            for place in row["places"]:
                ids = row["pool_ids"][4 * place["begin"] : 4 * place["behind"]]
                out.append((row["id"], base + place["begin"], place["behind"] - place["begin"], zlib.crc32(ids), row["doc_tokens"], place["sequence"], place["at"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=_PIECE)


_PIECE = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _stretches(df: DataFrame) -> DataFrame:
    """Rows at each stretch that their positions ``lo`` to ``hi`` touch; empty ones at none."""
    return df.where("hi > lo").withColumn("stretch", F.explode(F.sequence(F.expr(f"lo div {STRETCH}"), F.expr(f"(hi - 1) div {STRETCH}"))))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", pool: int = POOL) -> DataFrame:
    """One row per piece: id, ``start`` in its document, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    The vocabulary is one whose words white space parts. Each document's ids end with ``end_id``; a missing text has this id alone. A piece longer than no sequence lies
    at its offset in one; sequences have no gaps and hold at most ``capacity`` ids (a power of two). Full sequences come
    from long texts, of any length; repeated rows and null ids are packed like others; other columns, whatever their
    names, are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    encoded = materialize(rows.mapInArrow(_encode(tokenizer_path, end_id, capacity, pool), _DDL))

    # the patterns, from the histogram of widths, and each document's place in them
    by_task = encoded.where("width IS NOT NULL").groupBy("width", "task").agg(F.count(F.lit(1)).alias("n"))
    dealt, n_planned = _deal({r["width"]: r["n"] for r in by_task.groupBy("width").agg(F.sum("n").alias("n")).collect()}, capacity)
    # at most one range for each width of each pattern: bounded by the number of widths, not by the table
    ranges = F.broadcast(spark.createDataFrame(dealt, "width int, first long, behind long, sequence long, times long"))
    ranked = encoded.where("width IS NOT NULL").join(_before(by_task, "task", "n", ["width"]), ["width", "task"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).select("row", "id", "doc_tokens", "rest", "rest_crc", "width", "rank")
    placed = ranked.join(ranges, "width").where("rank >= first AND rank < behind").withColumn("sequence_id", F.expr("sequence + (rank - first) div times"))
    within = Window.partitionBy("sequence_id").orderBy(F.col("rest").desc(), "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("row", "id", "doc_tokens", "rest", "rest_crc", "sequence_id", F.coalesce(F.sum("rest").over(within), F.lit(0)).alias("offset"))
    placed = materialize(placed)

    # what they leave open, laid on one line, beside the held-back remainders on another
    open_ids = placed.groupBy("sequence_id").agg(F.sum("rest").alias("used")).select("sequence_id", "used", (F.lit(capacity) - F.col("used")).alias("open"), F.expr(f"sequence_id div {NUMBERED}").alias("shelf"))
    open_ids = materialize(open_ids)
    shelves = _before(open_ids.groupBy("shelf").agg(F.sum("open").alias("sum")), "shelf", "sum").select("shelf", F.col("before").alias("shelf_first"))
    slots = _before(open_ids, "sequence_id", "open", ["shelf"]).join(shelves, "shelf")
    slots = slots.select("sequence_id", F.col("used").alias("at"), (F.col("shelf_first") + F.col("before")).alias("lo"), (F.col("shelf_first") + F.col("before") + F.col("open")).alias("hi"))
    tasks = encoded.groupBy("task").agg(F.sum(F.size("chunks")).alias("chunks"), F.coalesce(F.sum(F.when(F.col("pool_first").isNotNull(), F.col("rest"))), F.lit(0)).alias("pooled"))
    tasks = _before(tasks.withColumnRenamed("chunks", "n"), "task", "n").withColumnRenamed("before", "chunks_before")
    tasks = materialize(_before(tasks, "task", "pooled").select("task", "pooled", "chunks_before", F.col("before").alias("pool_before")))
    n_open = open_ids.agg(F.sum("open")).first()[0] or 0
    rest = max(0, (tasks.agg(F.sum("pooled")).first()[0] or 0) - n_open)
    full, tail = rest // capacity, _powers(rest % capacity)
    more = spark.range(full).select((F.col("id") + n_planned).alias("sequence_id"), F.lit(0).alias("at"), (F.col("id") * capacity + n_open).alias("lo"), ((F.col("id") + 1) * capacity + n_open).alias("hi"))
    starts = [n_open + full * capacity + sum(tail[:k]) for k in range(len(tail))]
    last = spark.createDataFrame([(n_planned + full + k, 0, a, a + n) for k, (a, n) in enumerate(zip(starts, tail, strict=True))], "sequence_id long, at int, lo long, hi long")
    slots = _stretches(slots.unionByName(more).unionByName(last)).select("stretch", "sequence_id", "at", F.col("lo").alias("slot_lo"), F.col("hi").alias("slot_hi"))

    pool_rows = encoded.where("pool_first IS NOT NULL")
    line = pool_rows.select("row", "task", "pool_first", "rest").join(tasks, "task").withColumn("lo", F.col("pool_first") + F.col("pool_before")).withColumn("hi", F.expr("lo + rest"))
    met = _stretches(line.select("row", "lo", "hi")).join(slots, "stretch").select("row", "sequence_id", "at", "slot_lo", "lo", F.greatest("lo", "slot_lo").alias("a"), F.least("hi", "slot_hi").alias("b"), "stretch")
    met = met.where(f"b > a AND a div {STRETCH} = stretch")  # an overlap of several stretches counts in its first
    places = met.select("row", F.struct((F.col("a") - F.col("lo")).alias("begin"), (F.col("b") - F.col("lo")).alias("behind"), F.col("sequence_id").alias("sequence"), (F.col("at") + F.col("a") - F.col("slot_lo")).alias("at")).alias("place"))
    places = places.groupBy("row").agg(F.collect_list("place").alias("places"))  # at most one for each id of a remainder
    ddl = ", ".join(f"{c} long" for c in _PIECE)
    cut = pool_rows.select("row", "id", "doc_tokens", "rest", "pool_ids").join(places, "row").drop("row").mapInArrow(_cut, ddl)

    whole = placed.select("id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    long_ones = encoded.where("size(chunks) > 0").select("id", "doc_tokens", "task", "chunk_first", F.posexplode("chunks").alias("k", "ids_crc32")).join(tasks, "task")
    chunks = long_ones.select(
        "id", (F.col("k").cast("long") * capacity).alias("start"), F.lit(capacity).alias("length"), "ids_crc32", "doc_tokens",
        (F.col("chunks_before") + F.col("chunk_first") + F.col("k") + (n_planned + full + len(tail))).alias("sequence_id"), F.lit(0).alias("offset"),
    )
    out = [df.select(*(F.col(c).cast("long") for c in _PIECE)) for df in (whole, cut, chunks)]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumnRenamed("id", id_col)
