"""Hidden, suppressed and overlaid elements (V), over captured styles and boxes."""

from __future__ import annotations

from pellucid.functions.dialect import Spark
from pellucid.sources.seeds import seeded_elements

#: Doubles, written so in both dialects.
VIEW_WIDTH, VIEW_HEIGHT, VIEW_AREA = "1280.0e0", "720.0e0", "921600.0e0"
CANDIDATES, SHORT_TEXT, OFF_SCREEN = 250, 20, "24.0e0"


def elements(d: Spark) -> str:
    """Elements with the number of visible characters, contrast and share of the view."""
    def luminance(c: str) -> str:
        return f"(CASE WHEN {c} <= 10 THEN {c} / 255.0 / 12.92 ELSE power(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"

    wide = f"greatest(0.0e0, least(x + width, {VIEW_WIDTH}) - greatest(x, 0.0))"
    high = f"greatest(0.0e0, least(y + height, {VIEW_HEIGHT}) - greatest(y, 0.0))"
    a, b = luminance("color"), luminance("background")
    return f"""(SELECT e.*, length({d.replace('text', r'\s')}) AS chars, (greatest({a}, {b}) + 0.05) / (least({a}, {b}) + 0.05) AS contrast, 3 * abs(color - background) AS distance,
        {wide} * {high} / {VIEW_AREA} AS coverage FROM {seeded_elements(d)} e)"""


def candidates(d: Spark) -> str:
    """By priority (inputs, short texts, other texts) under the page's budget."""
    ranked = f"(SELECT e.*, CASE WHEN is_input THEN 3 WHEN chars > 0 AND chars <= 40 THEN 2 WHEN chars > 0 OR z >= 20 THEN 1 ELSE 0 END AS priority FROM {elements(d)} e)"
    return f"(SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, node_id) AS k FROM {ranked} r WHERE priority > 0) x WHERE k <= {CANDIDATES})"


#: (type, test, severity): strategies in order, the first that holds is reported.
STRATEGIES = [
    ("display-none", "display = 'none'", "medium"),
    ("visibility-hidden", "visibility = 'hidden'", "medium"),
    ("opacity-zero", "opacity = 0.0", "low"),
    ("tiny-font", "font_px <= 1.0", "medium"),
    ("small-font", "font_px <= 2.5 AND chars >= 80", "medium"),
    ("contrast", "distance <= 18 OR contrast <= 1.15", "medium"),
    ("low-contrast", "(distance <= 36 OR contrast <= 2.2) AND font_px <= 2.5", "medium"),
    ("off-screen", f"position <> 'static' AND (x + width < -{OFF_SCREEN} OR x > {VIEW_WIDTH} + {OFF_SCREEN} OR y + height < -{OFF_SCREEN})", "low"),
]


_KIND = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test, _ in STRATEGIES) + " END"
_BASE = "CASE " + " ".join(f"WHEN {test} THEN {2 if severity == 'medium' else 1}" for _, test, severity in STRATEGIES) + " END"
_LOWERED = f"greatest(1, base_rank - CASE WHEN chars <= {SHORT_TEXT} THEN 1 ELSE 0 END)"


def hidden(d: Spark) -> str:
    """One finding per hidden text; short texts are a step lower."""
    told = f"(SELECT c.*, {_KIND} AS type, {_BASE} AS base_rank FROM {candidates(d)} c WHERE chars > 0)"
    return f"(SELECT t.*, {_LOWERED} AS rank FROM {told} t WHERE type IS NOT NULL)"


_OVERLAY = "position IN ('fixed', 'absolute') AND coverage >= 0.45"
_OVERLAY_RANK = "CASE WHEN coverage >= 0.65 AND z >= 100 AND pointer AND opacity < 0.15 THEN 3 WHEN pointer THEN 2 ELSE 1 END"


def overlays(d: Spark) -> str:
    """Layers over most of the view."""
    return f"""(SELECT c.*, {_OVERLAY_RANK} AS rank
        FROM {candidates(d)} c WHERE {_OVERLAY})"""


def findings(d: Spark) -> str:
    """All findings; an element's overlay is kept although its text is hidden, equal keys once."""
    every = f"""(SELECT page_id, node_id, type, rank, concat(type, '|', CAST(node_id AS VARCHAR(20))) AS dedupe_key FROM {hidden(d)} h
        UNION ALL SELECT page_id, node_id, 'full-screen-overlay', rank, concat('overlay|', CAST(z AS VARCHAR(20))) FROM {overlays(d)} o)"""
    if d.name == "spark":  # both from one pass over the candidates, which pages are read and searched for
        told = f"(SELECT c.*, {_KIND} AS hidden, {_BASE} AS base_rank FROM {candidates(d)} c)"
        mine = d.struct({"type": "hidden", "rank": _LOWERED, "dedupe_key": "concat(hidden, '|', CAST(node_id AS VARCHAR(20)))"})
        over = d.struct({"type": "'full-screen-overlay'", "rank": _OVERLAY_RANK, "dedupe_key": "concat('overlay|', CAST(z AS VARCHAR(20)))"})
        found = d.unnest(told, d.array(f"CASE WHEN chars > 0 AND hidden IS NOT NULL THEN {mine} END", f"CASE WHEN {_OVERLAY} THEN {over} END"), "u.val IS NOT NULL")
        every = f"(SELECT page_id, node_id, val.type AS type, val.rank AS rank, val.dedupe_key AS dedupe_key FROM {found} f)"
    return f"(SELECT page_id, node_id, type, rank, dedupe_key FROM (SELECT e.*, row_number() OVER (PARTITION BY page_id, dedupe_key ORDER BY node_id) AS rn FROM {every} e) x WHERE rn = 1)"


def _of(name: str):
    test = next(t for n, t, _ in STRATEGIES if n == name)
    return lambda d: f"SELECT page_id, node_id, chars FROM {candidates(d)} c WHERE chars > 0 AND ({test})"


def _points(d: Spark) -> str:
    """Five sample points of a box, equal ones once."""
    points = [("x + width / 2", "y + height / 2"), ("x", "y"), ("x + width", "y"), ("x", "y + height"), ("x + width", "y + height")]
    return "SELECT DISTINCT page_id, node_id, px, py FROM (" + " UNION ALL ".join(f"SELECT page_id, node_id, {a} AS px, {b} AS py FROM {candidates(d)} c{k} WHERE is_input" for k, (a, b) in enumerate(points)) + ") p"


def _covered(d: Spark) -> str:
    """Layers over an input of the same page: stacking and click capture."""
    c = candidates(d)
    return f"""SELECT b.page_id, b.node_id, o.node_id AS layer_id, CASE WHEN o.opacity < 0.15 OR o.z >= 20 THEN 'high' ELSE 'medium' END AS severity
        FROM {c} b JOIN {c} o ON b.page_id = o.page_id AND b.is_input AND o.node_id <> b.node_id AND o.position <> 'static' AND o.z > b.z AND o.pointer
        AND o.x <= b.x + b.width / 2 AND b.x + b.width / 2 <= o.x + o.width AND o.y <= b.y + b.height / 2 AND b.y + b.height / 2 <= o.y + o.height"""


QUERIES = {
    "v01_priority": lambda d: f"SELECT page_id, node_id, priority FROM {candidates(d)} c",
    "v02_budget": lambda d: f"SELECT page_id, CAST(count(*) AS BIGINT) AS n, max(k) = {CANDIDATES} AS budget_reached FROM {candidates(d)} c GROUP BY page_id",
    "v03_text_probe": lambda d: f"SELECT page_id, node_id, chars >= 1 AS has_text FROM {elements(d)} e",
    "v05_hidden_text": lambda d: f"SELECT page_id, node_id, type, rank FROM {hidden(d)} h",
    "v06_display_none": _of("display-none"),
    "v07_visibility_hidden": _of("visibility-hidden"),
    "v08_opacity_zero": _of("opacity-zero"),
    "v10_font_size": _of("tiny-font"),
    "v11_contrast": _of("contrast"),
    "v13_off_screen": _of("off-screen"),
    "v17_colour_signals": lambda d: f"SELECT page_id, node_id, round(contrast, 4) AS contrast, distance FROM {elements(d)} e",
    "planted_lengths": lambda d: f"SELECT page_id, node_id, font_px * 1.5e0 AS em_px, width / {VIEW_WIDTH} * 100.0e0 AS vw FROM {elements(d)} e",
    "v21_viewport_coverage": lambda d: f"SELECT page_id, node_id, round(coverage, 6) AS coverage FROM {elements(d)} e",
    "v24_covered_inputs": _covered,
    "v26_full_screen_overlay": lambda d: f"SELECT page_id, node_id, rank FROM {overlays(d)} o",
    "v28_sample_points": _points,
    "v36_severity_algebra": lambda d: f"SELECT page_id, max(rank) AS worst, min(greatest(1, rank - 1)) AS least_lowered FROM {hidden(d)} h GROUP BY page_id",
    "v37_dedupe": lambda d: f"SELECT * FROM {findings(d)} f",
    "v38_gates": lambda d: f"SELECT h.page_id, h.node_id, h.type FROM {hidden(d)} h WHERE NOT EXISTS (SELECT 1 FROM {overlays(d)} o WHERE o.page_id = h.page_id AND o.node_id = h.node_id)",
}
