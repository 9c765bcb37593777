"""Fragments of pages as regions and windows under their limits.

Where a region ends depends on what it has taken so far, so candidates pass in order through a fold that holds three
counters; windows are then frames over each region's fragments of one source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits of a region, of a page's regions, and of windows.
REGION_CANDIDATES, REGION_FRAGMENTS, REGION_CHARACTERS, PAGE_REGIONS = 32, 64, 8_192, 200
WINDOW_REGIONS, WINDOW_CANDIDATES, WINDOW_STARTS, WINDOW_CHARACTERS, REGION_WINDOWS, PAGE_WINDOWS = 80, 16, 16, 4_096, 48, 1_000
# End of the fixed values.

_PLACED = "page_id long, node_id int, ord int, region_nr int, chunk int, place int"


def _placed(rows: DataFrame, *kept: str) -> DataFrame:
    """Rows of candidates with their regions: ``n`` and ``total`` are the number of their fragments and characters, ``first`` their order."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, node, anchor, number, chunks = None, None, None, 0, {}
        held = [0, 0, 0]
        for frame in frames:
            out = []
            for c in frame.itertuples(index=False):
                if c.page_id != page:
                    page, node, anchor, number, chunks = c.page_id, None, None, 0, {}
                if (c.node_id, c.region) != node:
                    node = c.node_id, c.region
                    joined = [held[0] + 1, held[1] + c.n, held[2] + c.total]
                    if anchor != c.region or joined[0] > REGION_CANDIDATES or joined[1] > REGION_FRAGMENTS or joined[2] > REGION_CHARACTERS:
                        anchor, number, joined = c.region, number + 1, [1, c.n, c.total]
                        chunks[c.region] = chunks.get(c.region, -1) + 1
                    held = joined
                out.append((number, chunks[c.region], held[0] - 1) if number <= PAGE_REGIONS else (None, None, None))
            made = pd.DataFrame(out, columns=["region_nr", "chunk", "place"], index=frame.index)
            made = pd.concat([frame[["page_id", "node_id", "ord", *kept]], made.astype("Int32")], axis=1)
            yield made[[c.split()[0] for c in ddl.split(", ")]]

    ddl = ", ".join([_PLACED, *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)])
    ordered = rows.repartition("page_id").sortWithinPartitions("page_id", "first", "node_id", "region", "ord")
    return ordered.mapInPandas(fold, ddl)


def page_regions(fragments: DataFrame) -> DataFrame:
    """Candidates with ``region_nr`` on their page (from 1), ``chunk`` of its element (from 0) and ``place`` in it (from 0).

    ``fragments``: ``page_id, node_id, ord, region, text``. A region is a run of candidates of one dividing element; a new one
    begins where the next candidate would exceed 32 candidates, 64 fragments or 8,192 characters. Beyond 200 regions a
    page's candidates have none: ``region_nr`` is null.
    """
    candidates = fragments.groupBy("page_id", "node_id", "region").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("total"))
    return _placed(candidates.withColumn("first", F.col("ord")))


def page_windows(fragments: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Two to four neighbouring candidates of a region with fragments of one source: ``start`` and ``last`` places, ``size``, ``chars``, ``transitions``.

    ``fragments`` as above with ``boundary`` and ``source``; ``regions``: their candidates placed, which is done here in the same
    pass unless they are given. Of a page the first 80 regions count, of a region the first 16 candidates, 48 windows and of a
    page 1,000 windows: by region, source in the order of appearance, start and size.
    """
    # windows have no texts, so none goes further than here
    lengths = fragments.select("page_id", "node_id", "ord", "region", "source", "boundary", F.length("text").alias("chars"))
    if regions is None:
        own = Window.partitionBy("page_id", "node_id", "region")
        told = lengths.repartition("page_id").withColumns({"first": F.min("ord").over(own), "n": F.count(F.lit(1)).over(own), "total": F.sum("chars").over(own)})
        placed = _placed(told, "source", "boundary", "chars")
    else:
        placed = lengths.join(regions.select("page_id", "node_id", "region_nr", "place"), ["page_id", "node_id"])
    # dealt by page, as all windows below are within a page
    rows = placed.where((F.col("region_nr") <= WINDOW_REGIONS) & (F.col("place") < WINDOW_CANDIDATES)).select("page_id", "region_nr", "place", "source", "boundary", "ord", "chars").repartition("page_id")
    first = Window.partitionBy("page_id", "region_nr", "source")
    rows = rows.withColumn("source_ord", F.min("ord").over(first))
    ahead = first.orderBy("place").rowsBetween(0, 3)
    rows = rows.withColumn("next", F.collect_list(F.struct("place", "chars", "boundary")).over(ahead))
    rows = rows.where((F.size("next") > 1) & (F.col("place") < WINDOW_STARTS)).select("page_id", "region_nr", "source", "source_ord", F.col("place").alias("start"), "next", F.explode(F.sequence(F.lit(2), F.size("next"))).alias("size"))
    rows = rows.withColumn("taken", F.slice("next", F.lit(1), F.col("size"))).where(F.element_at("taken", -1)["place"] == F.col("start") + F.col("size") - 1)
    rows = rows.withColumns({
        "chars": F.aggregate("taken", F.lit(0), lambda n, x: n + x["chars"]),
        "transitions": F.expr("size(filter(sequence(1, size - 1), i -> taken[i].boundary <> taken[i - 1].boundary))"),
    }).where(F.col("chars") <= WINDOW_CHARACTERS)
    order = ["source_ord", "start", "size"]
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "region_nr").orderBy(*order))).where(F.col("k") <= REGION_WINDOWS)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("region_nr", *order))).where(F.col("k") <= PAGE_WINDOWS)
    return rows.select("page_id", "region_nr", "source", "start", (F.col("start") + F.col("size") - 1).alias("last"), "size", "chars", "transitions")
