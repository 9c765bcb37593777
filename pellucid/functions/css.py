"""Values of style declarations as columns: colours (V15), lengths (V20) and transforms (V19), with Spark's own functions.

A value that cannot be read gives null. Keywords and functions are read in either case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The view, and how far or small a transform has to be.
VIEW_WIDTH, VIEW_HEIGHT = 1280, 720
FAR_SHARE, FAR_VIEW, FAR_PERCENT, SMALLEST_SCALE = 0.75, 75, 120, 0.05
# End of the fixed values.

_NUMBER = r"[+-]?[0-9]*\.?[0-9]+"
_GAP = r"(?:\s*,\s*|\s+)"
_ALPHA = r"(?:\s*[,/]\s*([0-9.]+%?)\s*)?"
_RGB = rf"rgba?\(\s*([0-9.]+){_GAP}([0-9.]+){_GAP}([0-9.]+){_ALPHA}\)"
_HSL = rf"^hsla?\(\s*({_NUMBER})(deg|rad|turn)?{_GAP}([0-9]*\.?[0-9]+)%{_GAP}([0-9]*\.?[0-9]+)%{_ALPHA}\)$"
_HEX = "^#([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$"
_LAB = rf"^(oklab|lab|oklch|lch)\(\s*({_NUMBER})(%?)"


def declared(style: Column, name: str) -> Column:
    """The value of a property in the text of a style, the last one if there are several; null if there is none."""
    found = F.regexp_extract_all(F.concat(F.lit(";"), style), F.lit(rf"(?i);\s*{name}\s*:([^;]*)"), F.lit(1))
    return F.lower(F.trim(F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"(?i)\s*!important\s*$", "")))


def _part(value: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(value, pattern, k)


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _within(c: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), c))


def _alpha(text: Column) -> Column:
    plain = _number(F.regexp_replace(text, "%", ""))
    return F.coalesce(_within(F.when(text.endswith("%"), plain / 100).otherwise(plain), 1), F.lit(1.0))


def _colour(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    return F.struct(red.cast("double").alias("red"), green.cast("double").alias("green"), blue.cast("double").alias("blue"), alpha.cast("double").alias("alpha"))


def _hsl(value: Column) -> Column:
    """Each channel falls off linearly with its distance from its own hue."""
    hue = _number(_part(value, _HSL, 1))
    unit = _part(value, _HSL, 2)
    degrees = F.when(unit == "rad", hue * (180 / math.pi)).when(unit == "turn", hue * 360).otherwise(hue)
    turned = F.pmod(degrees, F.lit(360.0))
    full, light = (_within(_number(_part(value, _HSL, k)), 100) / 100 for k in (3, 4))
    reach = full * F.least(light, 1 - light)

    def channel(offset: int) -> Column:
        k = F.pmod(F.lit(float(offset)) + turned / 30, F.lit(12.0))
        return F.floor((light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255 + 0.5)

    return _colour(channel(0), channel(8), channel(4), _alpha(_part(value, _HSL, 5)))


def colour(value: Column) -> Column:
    """A colour as ``red, green, blue`` (0 to 255) and ``alpha`` (0 to 1); of lab and its kin the lightness alone counts."""
    v = F.lower(F.trim(value))
    digits = _part(v, _HEX, 1)
    wide = F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    pair = lambda at: F.conv(F.substring(wide, at, 2), 16, 10).try_cast("double")
    light, model = _number(_part(v, _LAB, 2)), _part(v, _LAB, 1)
    grey = F.floor(_within(F.when(model.startswith("ok") & (_part(v, _LAB, 3) == ""), light * 255).otherwise(light / 100 * 255), 255) + 0.5)
    is_like = lambda pattern: F.regexp_like(v, F.lit(pattern))
    return (
        F.when(v == "transparent", _colour(*(F.lit(0.0) for _ in range(4))))
        .when(is_like(_RGB), _colour(*(_within(_number(_part(v, _RGB, k)), 255) for k in (1, 2, 3)), _alpha(_part(v, _RGB, 4))))
        .when(is_like(_HEX), _colour(pair(1), pair(3), pair(5), F.when(F.length(wide) == 8, pair(7) / 255).otherwise(1.0)))
        .when(is_like(_HSL), _hsl(v))
        .when(is_like(_LAB), _colour(grey, grey, grey, F.lit(1.0)))
    )


def pixels(value: Column, font: Column | float = 16.0, container: Column | float = 0.0, root_font: float = 16.0) -> Column:
    """A length in pixels; a number without a unit that is known is taken as it stands."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    v = F.lower(F.trim(value))
    n = _number(_part(v, rf"^({_NUMBER})", 1))
    unit = F.when(v.endswith("px"), 1.0).when(v.endswith("rem"), root_font).when(v.endswith("em"), as_column(font)).when(v.endswith("ch"), as_column(font) * 0.5)
    unit = unit.when(v.endswith("%"), as_column(container) / 100).when(v.endswith("vw"), VIEW_WIDTH / 100).when(v.endswith("vh"), VIEW_HEIGHT / 100).otherwise(1.0)
    return n * unit


def _arguments(value: Column, name: str, whole: bool = False) -> Column:
    """The numbers of a function's arguments, or an empty array."""
    at = rf"^{name}\(([^)]+)\)$" if whole else rf"(?:^|[^a-z0-9]){name}\(([^)]+)\)"
    return F.transform(F.split(_part(value, at, 1), ","), lambda x: F.trim(x).try_cast("double"))


def smallest_scale(value: Column) -> Column:
    """The smaller scale of a transform, if it is small enough to suppress an element."""
    v = F.lower(F.trim(value))
    scale = r"(-?[0-9]*\.?[0-9]+)"
    both = rf"scale\(\s*{scale}(?:\s*[,\s]\s*{scale})?\s*\)"
    x, y = (F.abs(_number(_part(v, both, k))) for k in (1, 2))
    length = lambda a, *at: F.sqrt(sum(F.pow(F.try_element_at(a, F.lit(k + 1)), 2) for k in at))
    flat, deep = _arguments(v, "matrix", True), _arguments(v, "matrix3d", True)
    # a matrix with something that is no number says nothing
    of_matrix = lambda a, n, first, second: F.when((F.size(a) >= n) & F.forall(a, lambda e: e.isNotNull()), F.least(length(a, *first), length(a, *second)))
    one = lambda axis: F.least(F.abs(_number(_part(v, rf"scale{axis}\(\s*{scale}\s*\)", 1))), F.lit(1.0))
    found = F.when(F.regexp_like(v, F.lit(both)), F.least(x, F.coalesce(y, x))).when(F.regexp_like(v, F.lit(rf"scalex\(\s*{scale}\s*\)")), one("x")).when(F.regexp_like(v, F.lit(rf"scaley\(\s*{scale}\s*\)")), one("y"))
    found = F.coalesce(found, of_matrix(flat, 6, (0, 1), (2, 3)), of_matrix(deep, 16, (0, 1, 2), (4, 5, 6)))
    return F.when(found <= SMALLEST_SCALE, found)


def far_translation(value: Column) -> Column:
    """Whether a transform moves an element about out of the view: by pixels, shares of the view or of itself, or by a matrix."""
    v = F.lower(F.trim(value))
    calls = F.regexp_extract_all(v, F.lit(r"translate(?:3d|x|y)?\(([^)]+)\)"), F.lit(1))
    arguments = F.flatten(F.transform(calls, lambda c: F.slice(F.filter(F.split(c, r"\s*,\s*|\s+"), lambda t: ~t.isin("", "/")), 1, 3)))

    def far(token: Column) -> Column:
        n = F.abs(_number(F.regexp_extract(token, rf"^({_NUMBER})", 1)))
        pixel = token.endswith("px") | F.regexp_like(token, F.lit(r"^-?[0-9]*\.?[0-9]+$"))
        limit = F.when(pixel, FAR_SHARE * max(VIEW_WIDTH, VIEW_HEIGHT)).when(token.endswith("vw") | token.endswith("vh"), float(FAR_VIEW)).when(token.endswith("%"), float(FAR_PERCENT))
        return F.coalesce(n >= limit, F.lit(False))

    moved = lambda a, n, x: F.coalesce((F.size(a) >= n) & ((F.abs(F.try_element_at(a, F.lit(x))) >= FAR_SHARE * VIEW_WIDTH) | (F.abs(F.try_element_at(a, F.lit(x + 1))) >= FAR_SHARE * VIEW_HEIGHT)), F.lit(False))
    return F.coalesce(F.exists(arguments, far) | moved(_arguments(v, "matrix"), 6, 5) | moved(_arguments(v, "matrix3d"), 16, 13), F.lit(False))
