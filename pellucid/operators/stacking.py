"""Which layers lie over what, from captured boxes (V24, V25): points meet boxes by grid cell, not all boxes of a page each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The view, the least visible part of a layer, and the shares of it that sample points are inset by.
VIEW_WIDTH, VIEW_HEIGHT, LEAST_WIDTH, LEAST_HEIGHT, INSET, LEAST_INSET = 1280, 720, 32, 24, 0.25, 4
HIGH_Z, WEAK_OPACITY = 20, 0.35
LAYERED = ("fixed", "absolute", "sticky")
# End of the fixed values.

#: Side of a cell in pixels: a box of the whole view lies in sixty.
CELL = 128


def visible(boxes: DataFrame) -> DataFrame:
    """Boxes (``x, y, width, height``) with what of them lies in the view: ``left, top, right, bottom``; others go."""
    clipped = boxes.withColumns({
        "left": F.greatest(F.lit(0.0), "x"), "top": F.greatest(F.lit(0.0), "y"), "right": F.least(F.lit(float(VIEW_WIDTH)), F.col("x") + F.col("width")), "bottom": F.least(F.lit(float(VIEW_HEIGHT)), F.col("y") + F.col("height")),
    })
    return clipped.where("right > left AND bottom > top")


def sample_points(boxes: DataFrame) -> DataFrame:
    """Five points of each visible box, in order, equal ones once: ``point_nr, px, py``: its centre and a quarter in from each corner."""
    wide, high = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    rounded = lambda c: F.floor(c + 0.5)  # noqa: E731  halves go up
    inset_x, inset_y = (F.greatest(F.lit(LEAST_INSET), rounded(size * INSET)) for size in (wide, high))
    west, east, north, south = F.col("left") + inset_x, F.col("right") - inset_x, F.col("top") + inset_y, F.col("bottom") - inset_y
    corners = [(F.col("left") + wide / 2, F.col("top") + high / 2), (west, north), (east, north), (west, south), (east, south)]
    held = lambda c, most: F.least(F.greatest(rounded(c), F.lit(0)), F.lit(most - 1)).cast("int")
    points = F.array(*(F.struct(held(x, VIEW_WIDTH).alias("px"), held(y, VIEW_HEIGHT).alias("py")) for x, y in corners))
    rows = boxes.select("*", F.posexplode(F.array_distinct(points)).alias("point_nr", "p"))
    return rows.select("*", "p.px", "p.py").drop("p")


def _cells(low: str, high: str) -> F.Column:
    return F.sequence(F.floor(F.col(low) / CELL).cast("int"), F.floor(F.col(high) / CELL).cast("int"))


def stacks(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """What lies at each point (``page_id, layer_id, point_nr, px, py``), the top one first: ``depth`` from 1, ``node_id`` and the boxes' columns.

    A box covers its left and top edges but not the others; of equal ``z`` the later element is above. Boxes that let
    pointers through are not there.
    """
    hit = visible(boxes.where("pointer")).withColumn("cx", F.explode(_cells("left", "right"))).withColumn("cy", F.explode(_cells("top", "bottom")))
    at = points.withColumns({"cx": F.floor(F.col("px") / CELL).cast("int"), "cy": F.floor(F.col("py") / CELL).cast("int")})
    # a cell's boxes are those of one page
    met = at.join(hit, ["page_id", "cx", "cy"]).where("left <= px AND px < right AND top <= py AND py < bottom")
    order = Window.partitionBy("page_id", "layer_id", "point_nr").orderBy(F.desc("z"), F.desc("node_id"))
    return met.withColumn("depth", F.row_number().over(order)).drop("cx", "cy")


def click_captures(elements: DataFrame) -> DataFrame:
    """Layers that take the clicks of an interactive element beneath (V25): ``page_id, layer_id, target_id, px, py, severity``.

    ``elements``: boxes with ``node_id, z, position, pointer, opacity, is_target, is_critical``. A layer is positioned, takes
    pointers, shows 32 by 24 pixels and is above others, fixed or weak. Its first sample point counts at which it is on
    top and a target lies beneath; the uppermost target is told. High: a critical target under a high or weak layer.
    """
    weak = F.col("opacity") <= WEAK_OPACITY
    layers = visible(elements.where(F.col("position").isin(*LAYERED) & F.col("pointer") & ((F.col("z") >= 1) | weak | (F.col("position") == "fixed"))))
    layers = layers.where((F.col("right") - F.col("left") >= LEAST_WIDTH) & (F.col("bottom") - F.col("top") >= LEAST_HEIGHT))
    points = sample_points(layers.select("page_id", F.col("node_id").alias("layer_id"), "left", "top", "right", "bottom", F.col("z").alias("layer_z"), weak.alias("weak")))
    points = points.select("page_id", "layer_id", "point_nr", "px", "py", "layer_z", "weak")
    found = stacks(points, elements.select("page_id", "node_id", "x", "y", "width", "height", "z", "pointer", "is_target", "is_critical"))
    own = F.max((F.col("depth") == 1) & (F.col("node_id") == F.col("layer_id"))).alias("on_top")
    below = F.min(F.when(F.col("is_target") & (F.col("node_id") != F.col("layer_id")), F.struct("depth", F.col("node_id").alias("target_id"), "is_critical"))).alias("target")
    at_points = found.groupBy("page_id", "layer_id", "layer_z", "weak", "point_nr", "px", "py").agg(own, below).where("on_top AND target IS NOT NULL")
    chosen = at_points.groupBy("page_id", "layer_id", "layer_z", "weak").agg(F.min(F.struct("point_nr", "px", "py", "target")).alias("p"))
    severity = F.when(F.col("p.target.is_critical") & ((F.col("layer_z") >= HIGH_Z) | F.col("weak")), "high").otherwise("medium")
    return chosen.select("page_id", "layer_id", "p.target.target_id", "p.px", "p.py", severity.alias("severity"))
