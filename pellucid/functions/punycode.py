"""Host labels in their characters (RFC 3492), as one SQL expression: a fold over a label's digits.

The fold's state is the next code point ``n``, the place ``i``, the weight ``w`` and threshold base ``k`` of the
number being read, the ``bias``, where the last number began (``old``), the code points so far, and ``bad``.
"""

from __future__ import annotations

from pellucid.functions.dialect import Spark

# Fixed values of the RFC: base, least and greatest threshold, skew, damp, initial bias and code point.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
# End of the fixed values.

#: No label of 63 characters that means something needs a larger number.
MOST = 1 << 40
FIELDS = ("x", "n", "i", "w", "k", "bias", "old", "points", "bad")


def _digit(c: str) -> str:
    return f"CAST(CASE WHEN {c} >= 'a' THEN ascii({c}) - 97 ELSE ascii({c}) - 22 END AS BIGINT)"


def _state(d: Spark, **values: str) -> str:
    return d.struct({f: values[f] for f in FIELDS})


def _adapted(d: Spark, delta: str) -> str:
    """The bias after a number: its delta is divided until it is small; five times are enough below ``MOST``."""
    most = ((BASE - T_MIN) * T_MAX) // 2
    cases, small = "", "0"
    for k in range(6):
        by = (BASE - T_MIN) ** k
        value = d.div("v.delta", str(by)) if k else "v.delta"
        made = f"{BASE * k} + {d.div(f'{BASE} * {value}', f'({value} + {SKEW})')}"
        cases += f" WHEN {value} <= {most} THEN {made}"
        small = made
    return d.let(d.struct({"delta": delta}), "v", f"CASE{cases} ELSE {small} END")


def _step(d: Spark) -> str:
    """The state after a digit; a stands for the state and b for an element that carries the digit as x."""
    t = f"greatest({T_MIN}, least({T_MAX}, a.k - a.bias))"
    place, size = "(a.i + b.x * a.w)", f"({d.size('a.points')} + 1)"
    delta = f"({d.div(f'({place} - a.old)', f'(CASE WHEN a.old = 0 THEN {DAMP} ELSE 2 END)')})"
    at = f"({place} % {size})"
    n = f"(a.n + {d.div(place, size)})"
    ended = _state(
        d, x="b.x", n=n, i=f"{at} + 1", w=d.long(1), k=d.long(BASE), bias=f"CAST({_adapted(d, f'{delta} + {d.div(delta, size)}')} AS BIGINT)", old=f"{at} + 1",
        points=d.inserted("a.points", at, n), bad=f"{n} > 1114111 OR ({n} BETWEEN 55296 AND 57343)",
    )
    more = _state(d, x="b.x", n="a.n", i=place, w=f"a.w * ({BASE} - {t})", k=f"a.k + {BASE}", bias="a.bias", old="a.old", points="a.points", bad=f"{place} > {MOST} OR a.w > {MOST}")
    return f"CASE WHEN a.bad THEN a WHEN b.x < {t} THEN {ended} ELSE {more} END"


def decoded(d: Spark, label: str) -> str:
    """The label's characters; it stays as it is unless it begins with ``xn--`` and can be decoded."""
    form = "^xn--(?:([a-z0-9-]*)-)?([a-z0-9]+)$"
    basic = d.apply(d.chars(d.extract(label, form, 1)), "CAST(ascii(x) AS BIGINT)")
    start = dict(n=d.long(FIRST), i=d.long(0), w=d.long(1), k=d.long(BASE), bias=d.long(BIAS), old=d.long(0), bad="false")
    # every element has the fold's first state, and its digit
    digits = d.let(d.struct({"points": basic, "chars": d.chars(d.extract(label, form, 2))}), "s", d.apply("s.chars", _state(d, x=_digit("x"), points="s.points", **start)))
    first = d.let(d.struct({"points": basic}), "s", _state(d, x=d.long(0), points="s.points", **start))
    folded = d.fold(digits, first, "a", "b", _step(d))
    made = d.let(folded, "r", f"CASE WHEN r.bad OR r.k <> {BASE} THEN {label} ELSE {d.from_points('r.points')} END")
    return f"CASE WHEN {d.matches(label, form)} THEN {made} ELSE {label} END"
