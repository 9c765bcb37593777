"""Values of styles, who hides a text and what lies behind an element, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from pellucid.functions import css
from pellucid.operators import styles
from pellucid.sources import dom

# Colours as they are written, and what they are.
COLOURS = [
    ("rgb(1, 2, 3)", (1, 2, 3, 1)), ("RGBA(300 0 10 / 50%)", (255, 0, 10, 0.5)), ("rgba(1,2,3,0.25)", (1, 2, 3, 0.25)), ("rgba(1,2,3,7)", (1, 2, 3, 1)), ("#fff", (255, 255, 255, 1)), ("#0f08", (0, 255, 0, 136 / 255)),
    (" #102030 ", (16, 32, 48, 1)), ("#10203040", (16, 32, 48, 64 / 255)), ("transparent", (0, 0, 0, 0)), ("hsl(0, 100%, 50%)", (255, 0, 0, 1)), ("hsl(120deg 100% 25%)", (0, 128, 0, 1)), ("hsla(240, 50%, 50%, .5)", (64, 64, 191, 0.5)),
    ("hsl(0.5turn 100% 50%)", (0, 255, 255, 1)), ("hsl(-60, 100%, 50%)", (255, 0, 255, 1)), ("hsl(45, 0%, 20%)", (51, 51, 51, 1)), ("lab(50% 10 10)", (128, 128, 128, 1)), ("oklch(0.5 0.1 20)", (128, 128, 128, 1)), ("lch(25 0 0)", (64, 64, 64, 1)),
    ("", None), (None, None), ("red-ish", None), ("#12345", None), ("inherit", None),
]
LENGTHS = [("10px", 10), ("-2.5PX", -2.5), ("2rem", 32), ("2em", 40), ("4ch", 40), ("50%", 150), ("10vw", 128), ("10vh", 72), ("7", 7), (".5px", 0.5), ("auto", None), ("", None), (None, None)]
SCALES = [
    ("scale(0)", 0), ("scale(0.04, 1)", 0.04), ("scale(1 0.01)", 0.01), ("scale(-0.02)", 0.02), ("scale(0.06)", None), ("rotate(1deg) scaleX(0.05)", 0.05), ("scaley(.01)", 0.01), ("matrix(0.01, 0, 0, 1, 5, 5)", 0.01), ("matrix(0.03, 0.04, 0, 1, 0, 0)", 0.05),
    ("matrix3d(1,0,0,0, 0,0.01,0,0, 0,0,1,0, 0,0,0,1)", 0.01), ("matrix(1,0,0,1,0)", None), ("matrix(a,0,0,0,0,0)", None), ("none", None), (None, None),
]
MOVES = [
    ("translate(-960px)", True), ("translate(959px, 10px)", False), ("translatex(-80vw)", True), ("translateY(74vh)", False), ("translate(0, 120%)", True), ("translate3d(0,0,1000)", True), ("translate(1px 2px / 3px)", False), ("matrix(1,0,0,1,960,0)", True),
    ("matrix(1,0,0,1,0,540)", True), ("matrix(1,0,0,1,900,500)", False), ("matrix3d(1,0,0,0,0,1,0,0,0,0,1,0,2000,0,0,1)", True), ("scale(0)", False), ("", False), (None, False),
]
# End of the fixed values.


@pytest.mark.parametrize("make, cases", [
    (lambda v: css.colour(v), COLOURS), (lambda v: css.pixels(v, font=20.0, container=300.0), LENGTHS), (css.smallest_scale, SCALES), (css.far_translation, MOVES),
], ids=["colours", "lengths", "scales", "moves"])
def test_values(spark, make, cases):
    frame = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k int, v string")
    got = {r["k"]: r["x"] for r in frame.select("k", make(F.col("v")).alias("x")).collect()}
    for k, (value, expected) in enumerate(cases):
        found = tuple(got[k]) if isinstance(expected, tuple) else got[k]
        assert found == (pytest.approx(expected) if expected is not None and not isinstance(expected, bool) else expected), value


def test_declarations(spark):
    cases = [("color:red; COLOR : Blue !important", "blue"), ("background-color: red", None), ("", None), (";;color:;", ""), ("color : a b ;", "a b")]
    frame = spark.createDataFrame([(s,) for s, _ in cases], "s string")
    assert [r[0] for r in frame.select(css.declared(F.col("s"), "color")).collect()] == [v for _, v in cases]


STYLES = [
    "display:none", "display:block", "visibility:hidden", "visibility:visible", "opacity:0", "opacity:0.5", "background-color:rgba(10,20,30,.5)", "background-color:#ffffff", "background-color:rgba(200,0,0,.25)",
    "background-image:url(x)", "background-color:transparent", "background-color:rgb(9,9,9); background-image:url(y)", None, None, None, None,
]


def _tree(rng, n):
    """A page of ``n`` nodes: (parent, last, tag, text, style) in document order."""
    nodes, last_path = [], []
    for k in range(n):
        path = last_path[: rng.randint(0, len(last_path))] if rng.random() < 0.5 else last_path
        if not path:
            path = [0] if k else []
        text = k > 0 and rng.random() < 0.3
        nodes.append([path[-1] if path else None, k, None if text else "div", rng.choice(("t", "text", " ")) if text else None, None if text else rng.choice(STYLES)])
        for a in path:
            nodes[a][1] = k
        last_path = path if text else [*path, k]
    return nodes


def _up(nodes, k):
    while k is not None:
        yield k
        k = nodes[k][0]


def _says(style, name):
    found = [d.split(":", 1)[1].strip() for d in (style or "").split(";") if d.strip().startswith(name + ":")]
    return found[-1] if found else None


@pytest.fixture(scope="module")
def trees(spark):
    rng = random.Random(8)
    pages = {p: _tree(rng, rng.choice((1, 5, 40, 150))) for p in range(30)}
    rows = [(p, k, parent, last, tag, text, {}, style) for p, nodes in pages.items() for k, (parent, last, tag, text, style) in enumerate(nodes)]
    return pages, spark.createDataFrame(rows, "page_id long, node_id int, parent_id int, last_id int, tag string, text string, attributes map<string,string>, style string").repartition(4)


def test_who_hides_a_text(trees):
    pages, frame = trees
    expected = set()
    for p, nodes in pages.items():
        for k, (_, _, tag, text, _) in enumerate(nodes):
            if tag or not text.strip():
                continue
            up = list(_up(nodes, k))[1:]
            none = [a for a in up if _says(nodes[a][4], "display") == "none"]
            clear = [a for a in up if _says(nodes[a][4], "opacity") == "0"]
            setter = next((a for a in up if _says(nodes[a][4], "visibility")), None)
            if none:
                expected.add((p, k, "none", none[0], none[-1], len(text)))
            elif setter is not None and _says(nodes[setter][4], "visibility") == "hidden":
                expected.add((p, k, "visibility", setter, setter, len(text)))
            elif clear:
                expected.add((p, k, "opacity", clear[0], clear[-1], len(text)))
    got = [tuple(r) for r in styles.hiding(frame).collect()]
    assert set(got) == expected and len(got) == len(expected) and {g[2] for g in got} == {"none", "visibility", "opacity"} and any(g[3] != g[4] for g in got)
    containers = {(p, o): 0 for p, _, why, _, o, _ in expected if why == "none"}
    for p, _, why, _, o, chars in expected:
        if why == "none":
            containers[p, o] += chars
    assert {(r["page_id"], r["container"]): r["chars"] for r in styles.hidden_containers(frame).collect()} == containers


def test_what_lies_behind(trees):
    pages, frame = trees
    colours = {"rgba(10,20,30,.5)": (10, 20, 30, 0.5), "#ffffff": (255, 255, 255, 1), "rgba(200,0,0,.25)": (200, 0, 0, 0.25), "transparent": (0, 0, 0, 0), "rgb(9,9,9)": (9, 9, 9, 1)}
    expected = {}
    for p, nodes in pages.items():
        for k, (_, _, tag, _, _) in enumerate(nodes):
            if not tag:
                continue
            layers, base = [], (255, 255, 255)
            for a in _up(nodes, k):
                if _says(nodes[a][4], "background-image"):
                    base = None
                    break
                c = colours.get(_says(nodes[a][4], "background-color"))
                if c and c[3] >= 1:
                    base = c[:3]
                    break
                if c and c[3] > 0:
                    layers.append(c)
            for c in reversed(layers):
                base = base and tuple(x * c[3] + y * (1 - c[3]) for x, y in zip(c, base))
            expected[p, k] = base
    got = {(r["page_id"], r["node_id"]): (r["red"], r["green"], r["blue"]) for r in styles.backdrops(frame).collect()}
    assert set(got) == set(expected)
    for key, base in expected.items():
        # halves may fall either way, as sums are taken in another order
        assert got[key] == (None, None, None) if base is None else all(abs(x - y) <= 0.5 + 1e-6 for x, y in zip(got[key], base)), key
    assert any(v is None for v in expected.values()) and len({v for v in expected.values() if v}) > 4


# Filters and clips as they are written, and why they hide.
FILTERS = [("blur(4px)", "strong-blur"), ("blur(1.5rem)", "blur"), ("blur(.5px) brightness(10%)", "low-brightness"), ("contrast(0.15)", "low-contrast"), ("opacity(0)", "filter-opacity"), ("opacity(50%)", None), ("grayscale(100%)", "color-shift"), ("invert(1)", "color-shift"), ("grayscale(.5)", None), ("none", None), (None, None)]
CLIPS = [
    (("inset(50%)", None, None, None, None), "zero-area"), (("inset(10%)", None, None, None, None), None), (("circle(0px at 0 0)", None, None, None, None), "zero-area"), (("polygon(0 0, 0 0, 0.0 0)", None, None, None, None), "near-zero-area"),
    (("polygon(0 0, 100% 0, 50% 50%)", None, None, None, None), None), ((None, "rect(0, 0, 0, 0)", None, None, None), "zero-area"), ((None, "rect(1px,0,0,0)", None, None, None), None), ((None, None, "hidden", 1.0, 50.0), "overflow-clipped"), ((None, None, "visible", 1.0, 1.0), None),
]
# End of the fixed values.


def test_reasons(spark):
    frame = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(FILTERS)], "k int, v string")
    assert [r[0] for r in frame.orderBy("k").select(styles.filter_reason(F.col("v"))).collect()] == [why for _, why in FILTERS]
    frame = spark.createDataFrame([(k, *v) for k, (v, _) in enumerate(CLIPS)], "k int, a string, b string, c string, d double, e double")
    assert [r[0] for r in frame.orderBy("k").select(styles.clip_reason(*(F.col(c) for c in "abcde"))).collect()] == [why for _, why in CLIPS]


def test_obfuscations_by_the_nearest_source(spark):
    rng = random.Random(11)
    made = {"filter:blur(9px)": (1, "strong-blur"), "transform:scale(0)": (2, "near-zero-scale"), "transform:scale(0.04)": None, "clip-path:inset(100%)": (3, "zero-area"), "overflow:hidden;width:2px": (3, "overflow-clipped"), None: None, "color:red": None}
    kinds, pages, rows = list(styles.LEVELS), {}, []
    for p in range(25):
        nodes = _tree(rng, rng.choice((3, 60, 120)))
        for n in nodes:
            n[4] = rng.choice([*made, None, None]) if n[2] else None
            n[2] = n[2] and rng.choice(("div", "div", "a", "button", "input"))
            n.append({} if not n[2] else rng.choice(({}, {}, {}, {"aria-hidden": "true"}, {"role": "none"}, {"class": "My-Icon"}, {"href": "/"}, {"aria-hidden": "false"})))
        pages[p] = nodes
        rows += [(p, k, *n[:4], n[5], n[4]) for k, n in enumerate(nodes)]
    frame = spark.createDataFrame(rows, "page_id long, node_id int, parent_id int, last_id int, tag string, text string, attributes map<string,string>, style string").repartition(4)
    expected = set()
    for p, nodes in pages.items():
        def own(k, kind):
            at = nodes[k][5]
            if kind == 0:
                return "aria-hidden" if at.get("aria-hidden") == "true" else "role" if at.get("role") in ("none", "presentation") else None
            return made[nodes[k][4]][1] if made.get(nodes[k][4]) and made[nodes[k][4]][0] == kind else None

        for k, n in enumerate(nodes):
            if not n[2]:
                continue
            inside = nodes[k : n[1] + 1]
            if not any((x[2] is None and x[3].strip()) or x[2] in ("button", "input") or (x[2] == "a" and "href" in x[5]) for x in inside):
                continue
            for kind in range(4):
                near = next((a for a in _up(nodes, k) if own(a, kind)), None)
                if near is not None and list(_up(nodes, k)).index(near) <= styles.LEVELS[kinds[kind]]:
                    expected.add((p, k, kinds[kind], own(near, kind), near, "low" if "icon" in n[5].get("class", "").lower() else "medium"))
                    break
    got = [tuple(r) for r in styles.obfuscations(frame).collect()]
    assert set(got) == expected and len(got) == len(expected) and {g[2] for g in got} == set(kinds) and any(g[1] != g[4] for g in got)
