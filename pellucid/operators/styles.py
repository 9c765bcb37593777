"""What a captured style says of an element and of all in it: who hides it (V04, V06) and what lies behind it.

Styles come as texts of declarations beside the labelled nodes of a page (:mod:`pellucid.sources.dom`), so ancestors are found by
containment; what lies behind an element is a chain of translucent layers, followed twice as far in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid.functions import css
from pellucid.plans.shared import written
from pellucid.sources import dom

#: The canvas where nothing opaque lies behind.
WHITE = 255.0


def _parsed(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own, so that what was read from styles is not read again wherever it is asked for."""
    return rows.sparkSession.read.parquet(written(rows, name))


def outermost(rows: DataFrame, **sets: F.Column) -> DataFrame:
    """``rows`` with a column for each named set: the farthest element of it that is the node or contains it, or null."""
    marked = rows.withColumns({f"{name}__of": test for name, test in sets.items()})
    alone = dom.covered(marked, strictly=True, **{f"{name}__in": F.col(f"{name}__of") for name in sets})
    so_far = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    for name in sets:
        top = F.col(f"{name}__of") & ~F.col(f"{name}__in")
        # the last of those that no other contains is the one around a node, if it reaches the node
        last = F.last(F.when(top, F.struct("node_id", "last_id")), ignorenulls=True).over(so_far)
        alone = alone.withColumn(f"{name}__last", last).withColumn(name, F.when(F.col(f"{name}__last.last_id") >= F.col("node_id"), F.col(f"{name}__last.node_id")))
    return alone.drop(*(f"{name}__{x}" for name in sets for x in ("of", "in", "last")))


def hiding(rows: DataFrame) -> DataFrame:
    """Text nodes that a style hides: ``why`` (none, visibility, opacity: the first that holds), its nearest and its outermost element.

    ``rows``: labelled nodes with ``style``. Visibility is what the nearest element that sets it says; the others hide all inside.
    """
    style = F.coalesce("style", F.lit(""))
    visibility = css.declared(style, "visibility")
    sets = {"none": F.coalesce(css.declared(style, "display") == "none", F.lit(False)), "opacity": F.coalesce(css.pixels(css.declared(style, "opacity")) <= 0.0, F.lit(False))}
    named = rows.withColumns({"sets_visibility": visibility.isNotNull(), "hides": F.coalesce(visibility.isin("hidden", "collapse"), F.lit(False)), **{f"is_{k}": v for k, v in sets.items()}})
    near = dom.nearest(named, none=F.col("is_none"), opacity=F.col("is_opacity"), setter=F.col("sets_visibility"))
    near = outermost(near, none_top=F.col("is_none"), opacity_top=F.col("is_opacity"))
    setters = named.where("sets_visibility").select("page_id", F.col("node_id").alias("setter"), F.col("hides").alias("setter_hides"))
    texts = near.where(F.col("tag").isNull() & F.regexp_like("text", F.lit(r"\S"))).join(setters, ["page_id", "setter"], "left")
    why = F.when(F.col("none").isNotNull(), "none").when(F.col("setter_hides"), "visibility").when(F.col("opacity").isNotNull(), "opacity")
    by = lambda none, other, opacity: F.when(F.col("why") == "none", F.col(none)).when(F.col("why") == "visibility", F.col(other)).otherwise(F.col(opacity))
    texts = texts.withColumn("why", why).where("why IS NOT NULL")
    return texts.select("page_id", "node_id", "why", by("none", "setter", "opacity").alias("nearest"), by("none_top", "setter", "opacity_top").alias("outermost"), F.length("text").alias("chars"))


def hidden_containers(rows: DataFrame) -> DataFrame:
    """One finding for each outermost element that is not displayed and has text in it (V06): how many texts and characters."""
    found = hiding(rows).where("why = 'none'")
    return found.groupBy("page_id", F.col("outermost").alias("container")).agg(F.count(F.lit(1)).alias("n_texts"), F.sum("chars").alias("chars"), F.lit("medium").alias("severity"))


def backdrops(rows: DataFrame) -> DataFrame:
    """The colour behind each element, itself included (V16): ``red, green, blue``, null where an image comes before an opaque colour.

    A layer maps what lies behind it to alpha x its colour + (1 - alpha) x that; a chain of layers is one such map again, so
    chains are joined pairwise until each ends at an opaque layer, or at the white canvas.
    """
    style = F.coalesce("style", F.lit(""))
    image = F.coalesce(css.declared(style, "background-image"), F.lit("none")) != "none"
    ground = css.colour(css.declared(style, "background-color"))
    elements = rows.withColumns({"ground": ground, "image": image & F.col("tag").isNotNull()})
    elements = _parsed(elements.select("page_id", "node_id", "parent_id", "last_id", "tag", "ground", "image"), "grounds")
    elements = elements.withColumn("is_layer", F.col("tag").isNotNull() & (F.col("image") | F.coalesce(F.col("ground.alpha") > 0, F.lit(False))))
    placed = dom.nearest(elements, layer=F.col("is_layer")).where("tag IS NOT NULL").select("page_id", "node_id", "parent_id", "layer", "ground", "image", "is_layer")
    above = placed.select("page_id", F.col("node_id").alias("parent_id"), F.col("layer").alias("up"))
    alpha = F.coalesce(F.when(F.col("image"), 1.0).otherwise(F.col("ground.alpha")), F.lit(1.0))
    own = {c: F.coalesce(F.col(f"ground.{c}"), F.lit(0.0)) * alpha for c in ("red", "green", "blue")}
    layers = placed.where("is_layer").join(above, ["page_id", "parent_id"], "left").select("page_id", "node_id", *(e.alias(c) for c, e in own.items()), (1 - alpha).alias("through"), F.col("image").alias("unknown"), "up")
    layers = layers.withColumn("up", F.when(F.col("through") > 0, F.col("up")))
    spark = rows.sparkSession
    while True:
        layers = spark.read.parquet(written(layers, "layers"))
        if layers.where("up IS NOT NULL").isEmpty():
            break
        behind = layers.select("page_id", F.col("node_id").alias("up"), *(F.col(c).alias(f"behind_{c}") for c in ("red", "green", "blue", "through", "unknown")), F.col("up").alias("next"))
        # written tables pack so well that their file sizes would call for a broadcast
        met = layers.join(behind.hint("merge"), ["page_id", "up"], "left")
        mixed = {c: F.col(c) + F.col("through") * F.coalesce(f"behind_{c}", F.lit(0.0)) for c in ("red", "green", "blue")}
        met = met.select("page_id", "node_id", *(e.alias(c) for c, e in mixed.items()), (F.col("through") * F.coalesce("behind_through", F.lit(1.0))).alias("through"), (F.col("unknown") | F.coalesce("behind_unknown", F.lit(False))).alias("unknown"), F.col("next").alias("up"))
        layers = met.withColumn("up", F.when(F.col("through") > 0, F.col("up")))
    shown = {c: F.when(~F.coalesce("unknown", F.lit(False)), F.floor(F.coalesce(F.col(c) + F.col("through") * WHITE, F.lit(WHITE)) + 0.5).cast("int")) for c in ("red", "green", "blue")}
    layers = layers.drop("up").withColumnRenamed("node_id", "layer")
    return placed.select("page_id", "node_id", "layer").join(layers.hint("merge"), ["page_id", "layer"], "left").select("page_id", "node_id", *(e.alias(c) for c, e in shown.items()))


# Levels above an element that count, scales and values that suppress, parts of names that tell a benign use.
LEVELS = {"semantic-visibility-mismatch": 4, "filter-blend-manipulation": 3, "transform-suppression": 3, "clipping-hiding": 3}
LEAST_SCALE, LEAST_FILTER, BLUR, STRONG_BLUR, LEAST_BOX = 0.02, 0.15, 1.0, 4.0, 2.0
BENIGN = "sr-only|visually-hidden|screen-reader|a11y|avatar|badge|icon|thumbnail|hero|media|background|image|photo"
# End of the fixed values.

_NUMBER = r"(-?[0-9]*\.?[0-9]+)"


def filter_reason(value: F.Column) -> F.Column:
    """Why a filter makes its element hard to read; null if it does not."""
    def said(name: str) -> F.Column:
        at = rf"{name}\(\s*{_NUMBER}(%)?\s*\)"
        n = F.regexp_extract(value, at, 1).try_cast("double")
        return F.when(F.regexp_extract(value, at, 2) == "%", n / 100).otherwise(n)

    blur = F.abs(F.regexp_extract(value, rf"blur\(\s*{_NUMBER}(px|rem|em)?\s*\)", 1).try_cast("double"))
    weak = [F.when(said(name) <= LEAST_FILTER, reason) for name, reason in (("brightness", "low-brightness"), ("contrast", "low-contrast"), ("opacity", "filter-opacity"))]
    shifted = F.when(F.regexp_like(value, F.lit(r"\b(?:grayscale|invert)\(\s*(?:1|100%)\s*\)")), "color-shift")
    return F.coalesce(F.when(blur >= STRONG_BLUR, "strong-blur").when(blur >= BLUR, "blur"), *weak, shifted)


def clip_reason(path: F.Column, legacy: F.Column, overflow: F.Column, width: F.Column, height: F.Column) -> F.Column:
    """How little a clip leaves of its element."""
    points = F.array_distinct(F.transform(F.regexp_extract_all(path, F.lit("(-?[0-9]*\\.?[0-9]+%?)"), F.lit(1)), lambda p: F.regexp_replace(p, r"\.0+(?=%|$)", "")))
    many = F.size(F.regexp_extract_all(path, F.lit("(-?[0-9]*\\.?[0-9]+%?)"), F.lit(1))) >= 4
    gone = F.when(F.regexp_like(path, F.lit(r"^inset\(\s*(50|100)%|^(circle|ellipse)\(\s*0(?:px|%|em|rem)?")), "zero-area").when(path.startswith("polygon(") & many & (F.size(points) <= 2), "near-zero-area")
    rect = F.when(F.regexp_like(legacy, F.lit(r"^rect\(\s*0(?:px)?(?:[,\s]+0(?:px)?){3}\s*\)$")), "zero-area")
    small = F.when(overflow.isin("hidden", "clip") & ((width <= LEAST_BOX) | (height <= LEAST_BOX)), "overflow-clipped")
    return F.coalesce(gone, rect, small)


def obfuscations(rows: DataFrame) -> DataFrame:
    """Elements whose content a style, or what they tell a reader's machine, suppresses (V30-V34): kind, reason, its element, severity.

    Of the kinds in the order of ``LEVELS`` the first counts, by the nearest element of it at most so many levels above.
    Only elements with text, controls or links in them count; a benign name makes a finding low.
    """
    style = F.coalesce("style", F.lit(""))
    get = lambda name: css.declared(style, name)
    attribute = lambda name: F.lower(F.try_element_at("attributes", F.lit(name)))
    blend = F.when(get("mix-blend-mode").isin("difference", "exclusion", "hue", "luminosity"), "blend-mode")
    reasons = {
        "semantic-visibility-mismatch": F.when(attribute("aria-hidden") == "true", "aria-hidden").when(attribute("role").isin("none", "presentation"), "role"),
        "filter-blend-manipulation": F.coalesce(filter_reason(get("filter")), blend),
        "transform-suppression": F.when(css.smallest_scale(get("transform")) <= LEAST_SCALE, "near-zero-scale"),
        "clipping-hiding": clip_reason(get("clip-path"), get("clip"), get("overflow"), css.pixels(get("width")), css.pixels(get("height"))),
    }
    kinds = list(reasons)
    element = F.col("tag").isNotNull()
    clickable = F.col("tag").isin("button", "label", "iframe") | ((F.col("tag") == "a") & attribute("href").isNotNull()) | attribute("tabindex").isNotNull()
    told = rows.select(
        "page_id", "node_id", "last_id", element.alias("element"), *(F.when(element, why).alias(f"reason{k}") for k, why in enumerate(reasons.values())),
        F.coalesce(~element & F.regexp_like("text", F.lit(r"\S")), F.lit(False)).alias("is_text"), F.coalesce(dom.private() | clickable, F.lit(False)).alias("is_control"),
        F.regexp_like(F.concat_ws(" ", attribute("class"), attribute("id")), F.lit(BENIGN)).alias("benign"),
    )
    full = dom.contents(_parsed(told, "reasons"), texts=F.col("is_text"), controls=F.col("is_control"))
    placed = dom.with_depth(full.where("element").drop("element", "is_text", "is_control"))
    # the nearest source comes with its depth and reason, so that it need not be joined
    source = F.struct("node_id", "depth", *(f"reason{k}" for k in range(len(kinds))))
    placed = dom.nearest(placed, source, **{f"source{k}": F.col(f"reason{k}").isNotNull() for k in range(len(kinds))})
    found = [
        F.when(F.col("depth") - F.col(f"source{k}.depth") <= LEVELS[kind], F.struct(F.lit(kind).alias("kind"), F.col(f"source{k}.reason{k}").alias("reason"), F.col(f"source{k}.node_id").alias("source_id")))
        for k, kind in enumerate(kinds)
    ]
    chosen = F.coalesce(*found)
    out = placed.withColumn("f", chosen).where("f IS NOT NULL AND (texts > 0 OR controls > 0)")
    return out.select("page_id", "node_id", "f.*", F.when(F.col("benign"), "low").otherwise("medium").alias("severity"))
